"""The core query: texts to typed, grounded, de-duplicated rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import normalize_rows, parse_rows
from ..functions.text import BLANK_CELL
from ..operators import ground
from ..operators.quality import canonical_cells, downgrade_by_warning
from ..operators.segment import PROFILES, chunk_passes
from ..providers import Chat, RuleProvider, prompt_column, with_answers


def extract_rows(texts: DataFrame, key: str = "doc_id", text: str = "text", columns: list[dict] | None = None, profile: str = "balanced", mode: str = "balanced", factory: Callable[[], Chat] = RuleProvider, threshold: float = ground.DEFAULT_FUZZY) -> DataFrame:
    """(key, ordinal, values, cells, classification, typed, error_code) of every text, in the order passes, answers, normal
    form, grounding, distinct rows, filter, typed cells.

    Each step is narrow but one: rows of a text are made distinct by its key.  Failed answers come out as a row with their code."""
    columns = columns or [{"name": "email", "type": "email"}, {"name": "label", "type": "string"}]
    parse_mode = PROFILES[profile][3]
    passes = chunk_passes(texts.select(key, text), text, profile)
    asked = passes.withColumn("messages", prompt_column(F.col("chunk"), F.col("pass_index"), F.col("total_passes"), "rows of the text", [[c["name"] for c in columns]]))
    answered = with_answers(asked.select(key, F.col(text).alias("source_text"), "pass_index", "messages"), "messages", factory)
    parsed = answered.withColumn("payload", parse_rows(F.col("answer"), parse_mode))
    rows = parsed.select(key, "source_text", "pass_index", F.posexplode(normalize_rows(F.col("payload.rows"), len(columns))).alias("row_index", "values"))
    grounded = ground.ground_cells(rows, "values", "source_text", threshold).drop("source_text")
    keyed = grounded.withColumn("row_key", ground.row_key(F.col("values")))
    distinct = ground.distinct_on_aggregated(keyed, [key, "row_key"], ground.status_rank("classification"), ["pass_index", "row_index"])
    kept = distinct.where(ground.passes_grounding(F.col("cells"), F.col("classification"), mode))
    typed = kept.withColumn("typed", canonical_cells(F.col("values"), columns))
    return typed.withColumn("cells", downgrade_by_warning(F.col("cells"), F.col("typed"))).select(key, "position", "values", "cells", "classification", "typed")


def wide(rows: DataFrame, columns: list[dict], key: str = "doc_id") -> DataFrame:
    """One typed column for each template column beside its raw text."""
    out = [F.col(key)]
    for i, c in enumerate(columns):
        cell = F.get("typed", F.lit(i))
        kind = {"number": "num", "date": "dt"}.get(c["type"], "text")
        out += [cell[kind].alias(c["name"]), F.coalesce(cell["raw"], F.lit(BLANK_CELL)).alias(f"{c['name']}_raw")]
    return rows.select(*out)


def with_fallback(pages: DataFrame, recognised: DataFrame, extract: Callable[[DataFrame], DataFrame], key: str = "page_id") -> DataFrame:
    """Pages whose text layer gives no rows are taken again from their recognised text; what is still empty stays empty."""
    first = extract(pages)
    again = pages.select(key).join(first.select(key).distinct(), key, "left_anti").join(recognised, key)
    return first.unionByName(extract(again))

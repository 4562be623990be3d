"""Error rates and agreement.  Distances of characters use the built-in function; words are mapped to single characters first,
so that the same function counts them."""

from __future__ import annotations

import operator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import _dedupe_key, is_blank, strip_u


def character_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def words_of(c: Column) -> Column:
    return F.filter(F.split(strip_u(F.coalesce(c, F.lit(""))), r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")


def word_distance(a: Column, b: Column) -> Column:
    """Edits between word sequences: each distinct word of the pair becomes one character above the basic plane (room for a million different words)."""
    x, y = words_of(a), words_of(b)
    all_words = F.array_distinct(F.concat(x, y))
    sign = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x10000).cast("int") + F.array_position(all_words, w).cast("int")), 8, "0")), "UTF-32")
    coded = lambda ws: F.array_join(F.transform(ws, sign), "")
    return F.levenshtein(coded(x), coded(y))


def accuracy_by_phase(samples: DataFrame) -> DataFrame:
    """Micro-averaged rates from samples (phase, truth, prediction, truth_fields map, predicted_fields map).

    Emits exact integer totals and unrounded ratios; references that are empty add their distance but nothing to the denominator."""
    truth, said = F.coalesce("truth", F.lit("")), F.coalesce("prediction", F.lit(""))
    keys = F.map_keys("truth_fields")
    hits = F.size(F.filter(keys, lambda k: strip_u(F.col("truth_fields")[k]) == strip_u(F.coalesce(F.col("predicted_fields")[k], F.lit("")))))
    per = samples.select("phase", character_distance(truth, said).alias("cd"), F.length(truth).alias("cn"), word_distance(truth, said).alias("wd"), F.size(words_of(truth)).alias("wn"), F.coalesce(F.greatest(hits, F.lit(0)), F.lit(0)).alias("fh"), F.coalesce(F.greatest(F.size(keys), F.lit(0)), F.lit(0)).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), F.lit(0.0))
    return per.groupBy("phase").agg(F.sum("cd").alias("char_edits"), F.sum("cn").alias("chars"), F.sum("wd").alias("word_edits"), F.sum("wn").alias("words"), F.sum("fh").alias("fields_right"), F.sum("fn").alias("fields"), ratio("cd", "cn").alias("cer"), ratio("wd", "wn").alias("wer"), ratio("fh", "fn").alias("field_accuracy"))


def compare_to_baseline(phases: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Relative gains in error rates and the absolute gain in fields against one phase; the baseline is one row."""
    base = phases.where(F.col("phase") == baseline).select(F.col("cer").alias("c0"), F.col("wer").alias("w0"), F.col("field_accuracy").alias("f0"))
    gain = lambda now, then: F.coalesce((F.col(then) - F.col(now)) / F.nullif(F.col(then), F.lit(0)), F.lit(0.0))
    return phases.crossJoin(F.broadcast(base)).select("phase", gain("cer", "c0").alias("cer_improvement"), gain("wer", "w0").alias("wer_improvement"), (F.col("field_accuracy") - F.col("f0")).alias("field_gain"))


def agreement(candidate: list[list[str]], reference: list[list[str]]) -> tuple[int, int]:
    """(cells that agree, cells compared).

    Each reference row takes the free candidate row of the same first cell that agrees in most cells (the first of equals); reference rows without one take
    the candidate rows left over, in order.  Compared are the columns of the first reference row, over as many rows as the longer side has."""
    rows = [[tuple(_dedupe_key(c or "") or "" for c in row) for row in side] for side in (candidate, reference)]
    if not any(rows):
        return 0, 0
    free: dict[int, tuple] = dict(enumerate(rows[0]))
    by_key: dict[str, list[int]] = {}
    for n, row in free.items():
        by_key.setdefault(row[0] if row else "", []).append(n)
    equal = lambda x, y: sum(map(operator.eq, x, y))
    matched, rest = 0, []
    for row in rows[1]:
        pool = [n for n in by_key.get(row[0], ()) if n in free] if row and row[0] else []
        if pool:
            matched += equal(free.pop(max(pool, key=lambda n: (equal(free[n], row), -n))), row)
        else:
            rest.append(row)
    matched += sum(equal(x, y) for x, y in zip(free.values(), rest))
    return matched, max(map(len, rows)) * len((rows[1] or rows[0])[0])


def agreement_scores(samples: DataFrame, candidate: str = "candidate_rows", reference: str = "reference_rows") -> DataFrame:
    """``matched`` and ``compared`` cells added to each sample."""
    kind = T.StructType([T.StructField("matched", T.IntegerType()), T.StructField("compared", T.IntegerType())])

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        lists = lambda x: [list(r) for r in x] if x is not None else []
        return pd.DataFrame([agreement(lists(x), lists(y)) for x, y in zip(a, b)], columns=["matched", "compared"])

    return samples.withColumn("__a", run(candidate, reference)).select("*", "__a.matched", "__a.compared").drop("__a")


def aggregate_agreement(scored: DataFrame) -> DataFrame:
    return scored.agg(F.coalesce(F.sum("matched") / F.nullif(F.sum("compared"), F.lit(0)), F.lit(0.0)).alias("agreement"))


def canonical_cells(values: Column, specs: list[dict]) -> Column:
    """Typed cells: array of struct(raw, num, dt, text, kind, warning).  A cell that does not fit its type keeps its text and a warning; blanks stay blank.

    ``specs``: dicts with name, type and the parse options thousands, decimal, formats, placeholder."""
    from ..functions.text import is_valid_email, is_valid_phone, normalize_company, normalize_email, normalize_phone, parse_date, parse_number

    cells = []
    none = lambda t: F.lit(None).cast(t)
    for i, spec in enumerate(specs):
        raw = F.coalesce(F.get(values, F.lit(i)), F.lit(" "))
        kind = spec.get("type", "string")
        blank = is_blank(raw) | (F.lit(False) if spec.get("placeholder") is None else strip_u(raw) == spec["placeholder"])
        num, dt, text, ok, code = none("double"), none("date"), none("string"), F.lit(True), None
        if kind == "number":
            num = parse_number(raw, spec.get("thousands", ","), spec.get("decimal", "."))
            ok, code = num.isNotNull(), "W_NORM_NUM"
        elif kind == "date":
            dt = parse_date(raw, spec.get("formats", ["%Y-%m-%d"]))
            ok, code = dt.isNotNull(), "W_NORM_DATE"
        elif kind == "phone":
            ok, code = is_valid_phone(raw), "W_NORM_PHONE"
            text = F.when(ok, normalize_phone(raw))
        elif kind == "email":
            ok, code = is_valid_email(raw), "W_NORM_EMAIL"
            text = F.when(ok, normalize_email(raw))
        elif kind == "company":
            text = normalize_company(raw)
        cells.append(
            F.struct(raw.alias("raw"), F.when(~blank, num).alias("num"), F.when(~blank, dt).alias("dt"), F.when(blank, raw).otherwise(F.coalesce(text, raw)).alias("text"), F.lit(kind).alias("kind"), (F.when(~blank & ~ok, F.lit(code)) if code else none("string")).alias("warning"))
        )
    return F.array(*cells)


def downgrade_by_warning(cells: Column, typed: Column) -> Column:
    """Cells whose phone or email did not fit become UNCERTAIN; the row's class stays."""
    zipped = F.arrays_zip(cells.alias("c"), typed.alias("t"))
    return F.transform(zipped, lambda z: F.when(z["t"]["warning"].isin("W_NORM_PHONE", "W_NORM_EMAIL"), z["c"].withField("status", F.lit("UNCERTAIN"))).otherwise(z["c"]))

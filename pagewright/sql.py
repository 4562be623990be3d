"""SQL names of the engine's functions for a session.

Column functions that Catalyst has are registered as SQL functions (``CREATE TEMPORARY FUNCTION``), so they stay in generated code;
the others as vectorised or table functions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text as X
from .functions.payload import decode_rows
from .operators import markup, segment
from .operators.ground import CELL, ground_value

_SPACE = r"[\\s\\x1c-\\x1f]"
NATIVE = {
    "pw_strip": ("s STRING", "STRING", rf"regexp_replace(s, '(?U)^{_SPACE}+|{_SPACE}+$', '')"),
    "pw_digits": ("s STRING", "STRING", r"regexp_replace(s, '(?U)\\D+', '')"),
    "normalize_phone": ("s STRING", "STRING", "concat(if(startswith(pw_strip(s), '+'), '+', ''), pw_digits(s))"),
    "is_valid_phone": ("s STRING", "BOOLEAN", "length(pw_digits(s)) between 7 and 18"),
    "normalize_email": ("s STRING", "STRING", "lower(pw_strip(s))"),
    "repair_json": ("s STRING", "STRING", r"regexp_replace(translate(s, '，：；｛｝［］（）“”', ',:;{}[]()\"\"'), ',\\s*([\\]}])', '$1')"),
}


@F.udtf(returnType="pass_index int, start int, `end` int, chunk string")
class SplitPasses:
    def eval(self, text: str, passes: int, limit: int, step: int):
        for i, (chunk, a, b) in enumerate(segment.split_passes(text or "", passes, limit, step), 1):
            yield i, a, b, chunk


@F.udtf(returnType="pass_index int, chunk string")
class SplitMarkdown:
    def eval(self, text: str, limit: int):
        for i, chunk in enumerate(segment.split_markdown(text or "", limit), 1):
            yield i, chunk


@F.udtf(returnType="block_index int, row_index int, fields string")
class LineRows:
    def eval(self, text: str, rules: str):
        found = segment.line_rows(text or "", segment.LineRules.from_json(rules))
        if found.matched:
            for i, block in enumerate(found.blocks):
                for j, row in enumerate(block):
                    yield i, j, json.dumps(row, ensure_ascii=False)


@F.udtf(returnType="table_no int, row_no int, column_no int, text string")
class HtmlTables:
    def eval(self, html: str):
        tables = [p for p in markup._parts(html or "") if not isinstance(p, str)]
        for n, grid in enumerate(tables, 1):
            for i, row in enumerate(grid, 1):
                for j, cell in enumerate(row, 1):
                    yield n, i, j, cell


def register(spark: SparkSession) -> None:
    for name, (arguments, result, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def parse_rows(raw: pd.Series) -> pd.Series:
        return pd.Series([decode_rows(t)[0] for t in raw])

    @F.pandas_udf(CELL)
    def ground_cell(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for values, texts in batches:
            yield pd.DataFrame([ground_value(v, t) for v, t in zip(values, texts)], columns=CELL.names)

    for name, f in {"dedupe_key": X.dedupe_key, "parse_rows": parse_rows, "ground_cell": ground_cell, "md_normalize": markup.normalize_markdown, "md_to_text": markup.markdown_to_text}.items():
        spark.udf.register(name, f)
    for name, f in {"split_passes": SplitPasses, "split_markdown": SplitMarkdown, "line_rules": LineRows, "html_tables": HtmlTables}.items():
        spark.udtf.register(name, f)

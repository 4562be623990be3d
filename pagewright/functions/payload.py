"""Rows out of model answers: candidates, repair and strict decoding.

``parse_rows`` is an Arrow-batched UDF because decoding "the first complete JSON value in a text" has no
built-in; it returns a struct and never raises, so one bad answer fails one row of data, not a task."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_ROWS, ROW_NOT_ARRAY = "E_LLM_002", "E_LLM_007"
# Full-width and typographic signs with the ASCII signs that JSON needs.
_WIDE, _NARROW = "，：；｛｝［］（）“”„‟‘’", ',:;{}[]()""""' + "''"
_PAYLOAD = T.StructType([T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("error_code", T.StringType())])
_OBJECTS = T.StructType([T.StructField("rows", T.ArrayType(T.MapType(T.StringType(), T.StringType()))), T.StructField("error_code", T.StringType())])


def strip_thoughts(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<think>.*?</think>", "")


def strip_fence(c: Column) -> Column:
    """Without the lines of an enclosing code fence."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)^```[^\n]*\n?", ""), r"\n?```\s*$", "")


def repair_json(c: Column) -> Column:
    """Typographic signs as ASCII ones and commas before closing brackets removed."""
    return F.regexp_replace(F.translate(c, _WIDE, _NARROW), r",\s*([\]}])", "$1")


def _repaired(text: str, quotes: bool) -> str:
    text = re.sub(r",\s*([\]}])", r"\1", text.translate(str.maketrans(_WIDE, _NARROW)))
    return re.sub(r"'((?:[^'\\]|\\.)*)'", lambda m: json.dumps(m[1].replace("\\'", "'"), ensure_ascii=False), text) if quotes else text


def _first_value(text: str) -> str | None:
    """The first list or object in the text that decodes completely, as written."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text):
        try:
            value, end = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(value, (list, dict)):
            return text[m.start() : end]
    return None


def candidates(raw: str, mode: str) -> list[str]:
    """Readings of an answer in the order they are tried; modes strict, balanced, aggressive (which also takes single quotes)."""
    text = re.sub(r"(?is)<think>.*?</think>", "", raw).strip()
    bare = re.sub(r"\n?```\s*$", "", re.sub(r"^```[^\n]*\n?", "", text)).strip() if text.startswith("```") else text
    base = [text, bare, _first_value(bare)]
    if mode != "strict":
        fixed = [_repaired(x, mode == "aggressive") for x in base if x]
        base += [y for x in fixed for y in (x, _first_value(x))]
    return list(dict.fromkeys(x for x in base if x))


def _cell(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else str(value)


def decode_rows(raw: str | None, mode: str = "balanced") -> tuple[list[list[str | None]] | None, str | None]:
    """(rows, None) or (None, error code)."""
    failed = NO_ROWS
    for text in candidates(raw or "", mode):
        try:
            value = json.loads(text)
        except ValueError:
            continue
        if isinstance(value, dict):
            value = value.get("rows")
        if isinstance(value, list):
            if all(isinstance(r, list) for r in value):
                return [[_cell(x) for x in r] for r in value], None
            failed = ROW_NOT_ARRAY
    return None, failed


def decode_objects(raw: str | None, mode: str = "balanced") -> tuple[list[dict[str, str | None]] | None, str | None]:
    for text in candidates(raw or "", mode):
        try:
            value = json.loads(text)
        except ValueError:
            continue
        if isinstance(value, dict) and "rows" in value:
            value = value["rows"]
        if isinstance(value, list) and all(isinstance(r, dict) for r in value):
            return [{str(k): _cell(x) for k, x in r.items()} for r in value], None
    return None, NO_ROWS


def parse_rows(raw: Column, mode: str = "balanced") -> Column:
    """struct(rows, error_code) of model answers with two-dimensional arrays."""

    @F.pandas_udf(_PAYLOAD)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_rows(t, mode) for t in texts], columns=["rows", "error_code"])

    return run(raw)


def parse_object_rows(raw: Column, mode: str = "balanced") -> Column:
    """struct(rows, error_code) of model answers with lists of objects."""

    @F.pandas_udf(_OBJECTS)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_objects(t, mode) for t in texts], columns=["rows", "error_code"])

    return run(raw)


def objects_to_arrays(rows: Column, header: list[str]) -> Column:
    """Object rows as arrays in the header's order; what is missing becomes a blank cell."""
    return F.transform(rows, lambda m: F.array(*[F.coalesce(m[h], F.lit(" ")) for h in header]))


def normalize_rows(rows: Column, width: int) -> Column:
    """Cells stripped, blanks as one space, each row cut or padded to ``width`` cells."""
    from .text import strip_u

    pad = F.array_repeat(F.lit(" "), width)
    cell = lambda x: F.when(F.coalesce(strip_u(x), F.lit("")) == "", " ").otherwise(strip_u(x))
    return F.transform(rows, lambda r: F.slice(F.concat(F.transform(F.coalesce(r, F.array().cast("array<string>")), cell), pad), 1, width))

"""Grounding of extracted values in their source text, classification, de-duplication and filters."""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import _dedupe_key, digits_of, is_blank, strip_u

ASSIGNED, PARTIAL, INFERRED, FUZZY, UNCERTAIN = "ASSIGNED", "ASSIGNED_PARTIAL", "INFERRED", "INFERRED_FUZZY", "UNCERTAIN"
RANK = {ASSIGNED: 5, PARTIAL: 4, INFERRED: 3, FUZZY: 2, UNCERTAIN: 1}
DEFAULT_FUZZY = 0.75
#: Segments shorter than this are not looked for one by one; values with fewer letters and digits are not compared by pairs.
LEAST_SEGMENT, LEAST_FUZZY = 2, 4
_LIST_MARKS = re.compile(r"[；;、，,\n]")
_EDGES = "。，；！？\n,:：;"
CELL = T.StructType([T.StructField("value", T.StringType()), T.StructField("source_text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("status", T.StringType())])


def status_rank(status: Column | str) -> Column:
    """5 (assigned) to 1 (uncertain); 0 for anything else."""
    s = F.col(status) if isinstance(status, str) else status
    out = F.lit(0)
    for name, rank in RANK.items():
        out = F.when(s == name, rank).otherwise(out)
    return out


def value_segments(c: Column) -> Column:
    """The parts of a value between list marks, blank ones left out, not stripped."""
    return F.filter(F.split(c, r"[；;、，,\n]", -1), lambda x: ~is_blank(x))


def exact_status(value: Column, text: Column) -> Column:
    """ASSIGNED where the first occurrence stands alone between blanks or sentence marks, ASSIGNED_PARTIAL where it is part of
    more, null where it does not occur.  Stays in the JVM: the join of cells and texts needs no Python for this step."""
    at = F.instr(text, value)
    before = F.when(at > 1, F.substr(text, at - 1, F.lit(1))).otherwise("")
    after = F.substr(text, at + F.length(value), F.lit(1))
    edge = lambda c: (c == "") | c.rlike(r"(?U)[\s\x1c-\x1f]") | c.isin(*_EDGES)
    whole = edge(before) & edge(after)
    return F.when((F.coalesce(value, F.lit("")) == "") | (at == 0), F.lit(None)).when(whole, ASSIGNED).otherwise(PARTIAL)


def compact_status(value: Column, text: Column) -> Column:
    """ASSIGNED where the value occurs in the text when blanks (or all signs) and case do not count, else null."""
    def squeezed(c: Column, pattern: str) -> Column:
        return F.lower(F.regexp_replace(c, pattern, ""))

    blanks, signs = r"(?U)[\s\x1c-\x1f]+", r"[^\p{L}\p{N}]+"
    v1, v2 = squeezed(value, blanks), squeezed(value, signs)
    return F.when(((v1 != "") & (F.instr(squeezed(text, blanks), v1) > 0)) | ((v2 != "") & (F.instr(squeezed(text, signs), v2) > 0)), ASSIGNED)


@functools.lru_cache(32)
def _squeezed(text: str, signs: bool) -> tuple[str, list[int]]:
    """The characters of a text in lower case, without blanks or (``signs``) without all but letters and digits, and where each stands; the rows of
    a text follow each other, so the last texts are remembered."""
    low = text.lower()
    if len(low) == len(text) and "Σ" not in text:  # its lower form in a word depends on what follows
        at = [i for i, c in enumerate(low) if c.isalnum()] if signs else [i for i, c in enumerate(low) if not c.isspace()]
        return "".join(map(low.__getitem__, at)), at
    pairs = [(x, i) for i, c in enumerate(text) if (c.isalnum() if signs else not c.isspace()) for x in c.lower()]
    return "".join(x for x, _ in pairs), [i for _, i in pairs]


def _exact(value: str, text: str) -> tuple[int, int, str] | None:
    at = text.find(value)
    if at < 0:
        return None
    stop = lambda c: c.isspace() or c in _EDGES
    a, b = at, at + len(value)
    while a > 0 and not stop(text[a - 1]):
        a -= 1
    while b < len(text) and not stop(text[b]):
        b += 1
    return (a, b, PARTIAL) if text[a:b] != value else (at, at + len(value), ASSIGNED)


def _compact(value: str, text: str) -> tuple[int, int, str] | None:
    for signs in (False, True):
        v, (t, at) = _squeezed(value, signs)[0], _squeezed(text, signs)
        if v and (k := t.find(v)) >= 0:
            return at[k], at[k + len(v) - 1] + 1, ASSIGNED
    return None


def _pairs(s: str) -> set[str]:
    return {s[i : i + 2] for i in range(len(s) - 1)} or {s} - {""}


def _fuzzy(value: str, text: str, threshold: float) -> tuple[int, int, str] | None:
    """The window of the value's length with the best Jaccard similarity of pairs of letters and digits, at least the threshold; the earliest of equals."""
    v, n = _squeezed(value, True)[0], len(value)
    if len(v) < LEAST_FUZZY or len(text) < n:
        return None
    pairs = _pairs(v)
    t, at = _squeezed(text, True)
    if sum(p in t for p in pairs) < threshold * len(pairs):
        return None  # a window that is near enough has at least this part of the value's pairs
    step = min(4, max(1, n // 8))
    starts = np.array(sorted({*range(0, len(text) - n + 1, step), len(text) - n}))
    low, high = np.searchsorted(at, starts), np.searchsorted(at, starts + n)
    hits = np.concatenate([[0], np.cumsum([t[i : i + 2] in pairs for i in range(len(t) - 1)], dtype=np.int64), [0]])
    likely = np.flatnonzero(hits[np.maximum(high - 1, low)] - hits[low] >= threshold * len(pairs))
    scored = []
    for k in likely.tolist():
        own = _pairs(t[low[k] : high[k]])
        scored.append((len(own & pairs) / max(1, len(own | pairs)), -int(starts[k])))
    score, start = max(scored, default=(0.0, 0))
    return (-start, -start + n, FUZZY) if scored and score >= threshold else None


def ground_value(value: str | None, text: str | None, threshold: float = DEFAULT_FUZZY) -> tuple[str, str, int, int, str]:
    """(value, source text, start, end, status) of one cell.

    A value of several segments is as good as its worst one, and uncertain if one of them is found nowhere; a single value that is found
    nowhere is inferred.  Blank values are uncertain."""
    value, text = value or "", text or ""
    parts = [p for p in _LIST_MARKS.split(value) if p.strip()]
    if not parts and not value.strip():
        return value, "", -1, -1, UNCERTAIN
    whole = len(parts) < 2 or min(len(p.strip()) for p in parts) < LEAST_SEGMENT
    found = [_exact(p, text) or _compact(p, text) or _fuzzy(p, text, threshold or DEFAULT_FUZZY) for p in ([value] if whole else parts)]
    if None in found:
        return value, "", -1, -1, INFERRED if whole else UNCERTAIN
    start, end, status = min(found, key=lambda f: RANK[f[2]])
    return value, text[start:end], start, end, status


def ground_cells(df: DataFrame, values: str = "values", text: str = "source_text", threshold: float = DEFAULT_FUZZY) -> DataFrame:
    """``cells`` (array of value, source_text, start, end, status) and ``classification`` added to rows with an array of values and their text."""

    @F.pandas_udf(T.ArrayType(CELL))
    def run(rows: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [dict(zip(CELL.names, ground_value(v, t, threshold))) for v in r] for r, t in zip(rows, texts)])

    made = df.withColumn("cells", run(F.col(values), F.col(text)))
    return made.withColumn("classification", classify_row(F.col("cells")))


def _filled(cell: Column) -> Column:
    return ~is_blank(cell["value"])


def classify_row(cells: Column) -> Column:
    """UNCERTAIN without a value among the first two cells; ASSIGNED if all filled cells are assigned, wholly or partly; else INFERRED."""
    keys = F.exists(F.slice(cells, 1, 2), _filled)
    assigned = F.forall(F.filter(cells, _filled), lambda x: x["status"].isin(ASSIGNED, PARTIAL))
    return F.when(~keys, UNCERTAIN).when(assigned, ASSIGNED).otherwise(INFERRED)


def passes_grounding(cells: Column, classification: Column, mode: str) -> Column:
    """off: all; strict: assigned rows; balanced: a filled key cell, and all filled cells assigned, partly assigned or fuzzily inferred."""
    if mode == "off":
        return F.lit(True)
    if mode == "strict":
        return classification == ASSIGNED
    return F.exists(F.slice(cells, 1, 2), _filled) & F.forall(F.filter(cells, _filled), lambda x: x["status"].isin(ASSIGNED, PARTIAL, FUZZY))


def row_key(values: Column) -> Column:
    """Key of a row of cells: each in compatibility form without blanks, in lower case."""

    @F.pandas_udf(T.StringType())
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else "\x1f".join(_dedupe_key(v) or "" for v in r) for r in rows])

    return run(values)


def distinct_on(df: DataFrame, keys: list[str], rank: Column, order: list[str]) -> DataFrame:
    """One row for each key: the highest rank, the first of equals; ``position`` is the first occurrence's place.

    Two window functions over one partitioning and no collecting; a hot key is one window group, so the key should be
    pre-aggregated where it is known to be hot (see ``distinct_on_aggregated``)."""
    best = Window.partitionBy(*keys).orderBy(rank.desc(), *order)
    return df.withColumn("__n", F.row_number().over(best)).withColumn("position", F.min(F.struct(*order)).over(Window.partitionBy(*keys))).where("__n = 1").drop("__n")


def distinct_on_aggregated(df: DataFrame, keys: list[str], rank: Column, order: list[str]) -> DataFrame:
    """As ``distinct_on``, by aggregation with map-side combining: for keys that may hold a large part of all rows."""
    whole = F.struct(*df.columns)
    best = F.min_by(whole, F.struct((-rank).alias("r"), *order))
    return df.groupBy(*keys).agg(best.alias("__b"), F.min(F.struct(*order)).alias("position")).select("__b.*", "position")


def near_duplicate_contacts(df: DataFrame, key: str, order: str, values: str = "values", rank: str = "rank") -> DataFrame:
    """Contact rows (name, company, title, phone, mobile, email, address) merged in order within a key and name: compatible companies and
    addresses, and equal emails where both have one, else phones one edit apart.  A later row replaces the kept one if it ranks higher, or has more
    filled cells at the same rank.  The fold depends on the order, so it runs per (key, name) group, which is a handful of rows."""

    def same(a: list[str], b: list[str]) -> bool:
        clean = [_dedupe_key(x) or "" for x in a], [_dedupe_key(x) or "" for x in b]
        (x, y) = clean
        if x[0] != y[0] or any(x[i] and y[i] and x[i] != y[i] for i in (1, 6)):
            return False
        if x[5] and y[5]:
            return x[5] == y[5]
        from_digits = lambda v: re.sub(r"\D", "", v)
        return any(_near(from_digits(x[i]), from_digits(y[i])) for i in (3, 4))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in rows.sort_values(order).to_dict("records"):
            for i, k in enumerate(kept):
                if same(list(k[values]), list(r[values])):
                    filled = lambda z: sum(bool((v or "").strip()) for v in z[values])
                    if r[rank] > k[rank] or (r[rank] == k[rank] and filled(r) > filled(k)):
                        kept[i] = r | {order: k[order]}
                    break
            else:
                kept.append(r)
        return pd.DataFrame(kept, columns=rows.columns)

    name = F.lower(strip_u(F.get(F.col(values), F.lit(0))))
    return df.withColumn("__name", name).groupBy(key, "__name").applyInPandas(fold, df.withColumn("__name", name).schema).drop("__name")


def _near(a: str, b: str) -> bool:
    """Equal or one edit apart, both filled."""
    if not a or not b or abs(len(a) - len(b)) > 1:
        return False
    if a == b:
        return True
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def same_phone(a: Column, b: Column) -> Column:
    return (digits_of(a) == digits_of(b)) | (F.levenshtein(digits_of(a), digits_of(b), 1) >= 0)

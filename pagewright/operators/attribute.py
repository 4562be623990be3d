"""Which of two regions of a page a value belongs to (buyer or seller), and correction of values that were crossed.

The anchors' search and the division are joins and arithmetic on small per-page tables; locating a value in blocks
by fragments needs a search over tilings and runs in Python, per page."""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How far anchors lie apart, how slim a vertical word is, how long a fragment must be.
DIRECTION, AXIS_PART, SLIM, LEAST_HAN, LEAST_OTHER = 1.5, 0.20, 0.6, 4, 8


def normal(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text or "") if not c.isspace()).lower()


@dataclass(frozen=True)
class Group:
    name: str
    fields: tuple[str, ...]
    keywords: tuple[str, ...]


def find_anchors(blocks: DataFrame, groups: list[Group], page: str = "page_id") -> DataFrame:
    """(page, group_name, cx, cy) of the one block of a page that shows a group's keyword and no other group's.

    Keywords are a literal array: a containment test per block, no join.  The full keyword must hit once; the short one only counts
    in a narrow tall block.  Pages with several hits have no anchor."""
    from .layout import box_edges

    text = F.lower(F.regexp_replace("text", r"(?U)\s+", ""))
    e = box_edges(F.col("box"))
    boxed = blocks.where("text is not null").select(page, text.alias("t"), e.alias("e")).where("e is not null")
    rows = None
    for g in groups:
        others = [k for o in groups if o.name != g.name for k in o.keywords]
        excluded = F.lit(False)
        for k in others:
            excluded = excluded | F.contains("t", F.lit(normal(k)))
        full, short = normal(g.keywords[0]), [normal(k) for k in g.keywords[1:]]
        slim = (F.col("e.right") - F.col("e.left")) <= SLIM * (F.col("e.bottom") - F.col("e.top"))
        by_short = F.lit(False)
        for k in short:
            by_short = by_short | F.contains("t", F.lit(k))
        kind = F.when(F.contains("t", F.lit(full)), 1).when(by_short & slim, 2)
        hit = boxed.where(~excluded).select(page, F.lit(g.name).alias("group_name"), kind.alias("k"), ((F.col("e.left") + F.col("e.right")) / 2).alias("cx"), ((F.col("e.top") + F.col("e.bottom")) / 2).alias("cy")).where("k is not null")
        rows = hit if rows is None else rows.unionByName(hit)
    per = rows.groupBy(page, "group_name").agg(F.count_if(F.col("k") == 1).alias("n1"), F.count_if(F.col("k") == 2).alias("n2"), F.min(F.when(F.col("k") == 1, F.struct("cx", "cy"))).alias("p1"), F.min(F.when(F.col("k") == 2, F.struct("cx", "cy"))).alias("p2"))
    chosen = F.when(F.col("n1") == 1, F.col("p1")).when((F.col("n1") == 0) & (F.col("n2") == 1), F.col("p2"))
    return per.select(page, "group_name", chosen.alias("p")).where("p is not null").select(page, "group_name", "p.cx", "p.cy")


def divide(ax: Column, ay: Column, bx: Column, by: Column, width: Column, height: Column, a: str, b: str) -> Column:
    """struct(mode, split, low, high): top and bottom before left and right; null where the anchors lie neither way clearly."""
    dx, dy = F.abs(ax - bx), F.abs(ay - by)
    vertical = (dy >= DIRECTION * dx) & (dy >= AXIS_PART * height)
    horizontal = (dx >= DIRECTION * dy) & (dx >= AXIS_PART * width)
    side = lambda mode, p, q: F.struct(F.lit(mode).alias("mode"), ((p + q) / 2).alias("split"), F.when(p < q, a).otherwise(b).alias("low"), F.when(p < q, b).otherwise(a).alias("high"))
    return F.when(vertical, side("top_bottom", ay, by)).when(horizontal, side("left_right", ax, bx))


def page_divisions(anchors: DataFrame, sizes: DataFrame, a: str, b: str, page: str = "page_id") -> DataFrame:
    """(page, division) for the pages that have both anchors; ``sizes`` has (page, width, height)."""
    pick = lambda g, p: anchors.where(F.col("group_name") == g).select(page, F.col("cx").alias(f"{p}x"), F.col("cy").alias(f"{p}y"))
    both = pick(a, "a").join(pick(b, "b"), page).join(sizes, page)
    return both.select(page, divide(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("width"), F.col("height"), a, b).alias("division")).where("division is not null")


def region_of(cx: Column, cy: Column, division: Column) -> Column:
    at = F.when(division["mode"] == "top_bottom", cy).otherwise(cx)
    return F.when(at < division["split"], division["low"]).otherwise(division["high"])


def tiles(value: str, fragments: list[str]) -> bool:
    """Whether the fragments, each used once, put end to end in some order are the value."""
    if sum(map(len, fragments)) != len(value):
        return False
    kinds = sorted(set(fragments))
    counts = Counter(fragments)

    @lru_cache(maxsize=None)
    def fits(at: int, left: tuple[int, ...]) -> bool:
        if at == len(value):
            return not any(left)
        return any(n and value.startswith(k, at) and fits(at + len(k), left[:i] + (n - 1,) + left[i + 1 :]) for i, (k, n) in enumerate(zip(kinds, left)))

    return fits(0, tuple(counts[k] for k in kinds))


def _long_enough(s: str) -> bool:
    han = sum("一" <= c <= "鿿" for c in s)
    return han >= LEAST_HAN or sum(c.isalnum() and not "一" <= c <= "鿿" for c in s) >= LEAST_OTHER


def locate(value: str, blocks: list[tuple[str, str]]) -> str | None:
    """The region of a value: of the one block that contains it, else of fragments that make it up and lie in one region."""
    v = normal(value)
    if not v:
        return None
    whole = [r for t, r in blocks if v in normal(t)]
    if whole:
        return whole[0] if len(whole) == 1 else None
    parts: list[tuple[str, str]] = []
    for t, r in blocks:
        n = normal(t)
        if n and n in v and _long_enough(n):
            parts.append((n, r))
        else:
            tail = next((n[i:] for i in range(1, len(n)) if n[i:] in v), "")
            if _long_enough(tail):
                parts.append((tail, r))
    return parts[0][1] if parts and len({r for _, r in parts}) == 1 and tiles(v, [p for p, _ in parts]) else None


_FIXED = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("verdict", T.StringType())])


def correct_pair(a_value: Column, b_value: Column, blocks: Column, a: str, b: str) -> Column:
    """struct(a, b, verdict) of two values of exclusive groups, from the page's blocks (array of struct(text, region)).

    Both in the other's region: swapped; both in their own: kept; else uncertain.  Pairs with a blank side are kept."""

    @F.pandas_udf(_FIXED)
    def run(x: pd.Series, y: pd.Series, pages: pd.Series) -> pd.DataFrame:
        out = []
        for p, q, page in zip(x, y, pages):
            if not (p or "").strip() or not (q or "").strip():
                out.append((p, q, "kept"))
                continue
            own = [(e["text"] or "", e["region"]) for e in (page if page is not None else [])]
            rp, rq = locate(p, own), locate(q, own)
            out.append((q, p, "swapped") if (rp, rq) == (b, a) else (p, q, "kept") if (rp, rq) == (a, b) else (p, q, "uncertain"))
        return pd.DataFrame(out, columns=["a", "b", "verdict"])

    return run(a_value, b_value, blocks)


def rescue_candidates(cells: DataFrame, regions: DataFrame, budget: int = 5, key: str = "task_id") -> DataFrame:
    """The uncertain cells (key, row_ordinal, column_ordinal, field_name, status) with a configured region, in row order, as many as the budget of a task
    allows; the region's rectangle is joined for the recognition that follows."""
    from pyspark.sql.window import Window

    eligible = cells.where("status = 'UNCERTAIN'").join(regions, "field_name")
    numbered = eligible.withColumn("attempt", F.row_number().over(Window.partitionBy(key).orderBy("row_ordinal", "column_ordinal")))
    return numbered.where(F.col("attempt") <= budget)


def has_resolvable_pair(header: list[str], pairs: list[tuple[str, str]], groups: list[Group], values: Column) -> Column:
    """Whether some exclusive pair has both columns in the header and both cells filled."""
    from ..functions.text import is_blank

    at = {h: i for i, h in enumerate(header)}
    by = {g.name: g for g in groups}
    out = F.lit(False)
    for a, b in pairs:
        for x, y in zip(by[a].fields, by[b].fields):
            if x in at and y in at:
                out = out | (~is_blank(F.get(values, F.lit(at[x]))) & ~is_blank(F.get(values, F.lit(at[y]))))
    return out

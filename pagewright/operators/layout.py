"""Reading order, paragraphs and regions of recognised blocks.

A page's blocks are an array; every operator works on that array inside one row, so pages are never grouped or
shuffled again.  Geometry that Catalyst can express (boxes, centres, areas, filters) is expressed there; the
sequential parts run in one Arrow-batched function per page."""

from __future__ import annotations

import bisect
import math
import unicodedata
from dataclasses import dataclass
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = T.StructType([T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("box", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("end", T.StringType())])
# How wide a gap is a word's, a column's; how much a paragraph's lines may differ.
WORD_GAP, WORD_GAP_PIXELS, COLUMN_GAP, ALIGN = 0.35, 4.0, 2.5, 1.2
SKEW_DEGREES = 3.0
PARSERS = {"none", "multi_none", "multi_line", "multi_para", "single_none", "single_line", "single_para", "single_code"}
ALIASES = {"auto": "multi_para", "multi_column": "multi_para", "single_column": "single_para"}


@dataclass
class Block:
    text: str
    score: float | None
    points: list[list[float]]
    l: float = 0.0
    t: float = 0.0
    r: float = 0.0
    b: float = 0.0
    end: str = ""

    @property
    def h(self) -> float:
        return max(0.0, self.b - self.t)

    @property
    def boxed(self) -> bool:
        return bool(self.points)

    @property
    def order(self) -> tuple[float, float]:
        return self.t, self.l


def levelled(blocks: list[Block]) -> None:
    """Give each block its box; a page that is turned by more than a few degrees is turned back first."""
    angles = []
    for b in blocks:
        if len(b.points) >= 4:
            edges = [(b.points[i], b.points[(i + 1) % 4]) for i in range(4)]
            (x1, y1), (x2, y2) = (p[:2] for p in max(edges, key=lambda e: math.dist(e[0][:2], e[1][:2])))
            a = math.degrees(math.atan2(y2 - y1, x2 - x1))
            angles.append((a + 90) % 180 - 90)
    turn = median(angles) if angles else 0.0
    if abs(turn) <= SKEW_DEGREES:
        turn = 0.0
    c, s = math.cos(math.radians(-turn)), math.sin(math.radians(-turn))
    turned = [[(p[0] * c - p[1] * s, p[0] * s + p[1] * c) if turn else (p[0], p[1]) for p in b.points if len(p) >= 2] for b in blocks]
    dx = -min((x for ps in turned for x, _ in ps), default=0.0) if turn else 0.0
    dy = -min((y for ps in turned for _, y in ps), default=0.0) if turn else 0.0
    for b, ps in zip(blocks, turned):
        if ps:
            b.l, b.t = min(x for x, _ in ps) + max(dx, 0), min(y for _, y in ps) + max(dy, 0)
            b.r, b.b = max(x for x, _ in ps) + max(dx, 0), max(y for _, y in ps) + max(dy, 0)


def _shares_line(top, bottom, row_top, row_bottom):
    """Whether heights overlap by more than half of the lower one; of numbers or of arrays."""
    low = np.minimum(np.maximum(0.0, bottom - top), row_bottom - row_top)
    return (low > 0) & (np.minimum(bottom, row_bottom) - np.maximum(top, row_top) > 0.5 * low)


def rows_of(blocks: list[Block], last_only: bool = False) -> list[list[Block]]:
    """Blocks put into the first row (or only the last one) that they overlap by more than half of the lower height: a sweep from the top over the
    rows' bounds as one array."""
    ordered = sorted(blocks, key=lambda x: x.order)
    bounds = np.zeros((len(ordered), 2))
    row_of: list[int] = []
    n = 0
    for b in ordered:
        since = max(0, n - 1) if last_only else 0
        fits = np.flatnonzero(_shares_line(b.t, b.b, bounds[since:n, 0], bounds[since:n, 1]))
        row = since + int(fits[0]) if len(fits) else n
        bounds[row] = (min(bounds[row, 0], b.t), max(bounds[row, 1], b.b)) if row < n else (b.t, b.b)
        n = max(n, row + 1)
        row_of.append(row)
    members: list[list[Block]] = [[] for _ in range(n)]
    for b, row in zip(ordered, row_of):
        members[row].append(b)
    return sorted((sorted(r, key=lambda x: (x.l, x.t)) for r in members), key=lambda r: r[0].order)


def column_cuts(rows: list[list[Block]]) -> list[tuple[float, float]]:
    """Vertical gaps that go through at least two neighbouring rows with gaps, overlapping ones as their common part.

    A table of strips (left, right, first row, last row) is intersected with each row's gaps at once."""
    strips, ended = np.zeros((0, 4)), []
    for n, row in enumerate(rows):
        gaps = np.array([(x.r, y.l) for x, y in zip(row, row[1:]) if y.l > x.r]).reshape(-1, 2)
        left, right = np.maximum.outer(strips[:, 0], gaps[:, 0]), np.minimum.outer(strips[:, 1], gaps[:, 1])
        meet = right > left
        ended.append(strips[~meet.any(axis=1)])
        of = np.nonzero(meet)[0]
        longer = np.column_stack([left[meet], right[meet], strips[of, 2], np.full(len(of), n)])
        fresh = gaps[~meet.any(axis=0)]
        strips = np.concatenate([longer, np.column_stack([fresh, np.full((len(fresh), 2), n)])])
    out: list[tuple[float, float]] = []
    for a, b, top, bottom in sorted(map(tuple, np.concatenate([*ended, strips]).tolist())):
        if bottom > top:
            common = (max(out[-1][0], a), min(out[-1][1], b)) if out else (0.0, 0.0)
            if common[1] > common[0]:
                out[-1] = common
            else:
                out.append((a, b))
    return out


def reading_order(blocks: list[Block]) -> list[Block]:
    """Blocks over several columns first, then the columns from left to right; without columns from top to bottom."""
    if len(blocks) < 2:
        return list(blocks)
    cuts = column_cuts(rows_of(blocks))
    if not cuts:
        return sorted(blocks, key=lambda x: x.order)
    middles = [(a + b) / 2 for a, b in cuts]
    spanning, columns = [], [[] for _ in range(len(cuts) + 1)]
    for b in blocks:
        if any(b.l < x and b.r > y for x, y in cuts):
            spanning.append(b)
        else:
            columns[bisect.bisect_left(middles, (b.l + b.r) / 2)].append(b)
    return [b for part in (spanning, *columns) for b in sorted(part, key=lambda x: x.order)]


def _wide(c: str) -> bool:
    return bool(c) and (0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF or 0xF900 <= ord(c) <= 0xFAFF or 0x3000 <= ord(c) <= 0x303F or 0xFF00 <= ord(c) <= 0xFFEF)


def word_separator(left: str, right: str) -> str:
    """What stands between two texts that touch, from their neighbouring characters."""
    if not left or not right or (_wide(left) and _wide(right)) or left == "-" or unicodedata.category(right[0])[0] == "P":
        return ""
    return " "


def block_separator(a: Block, b: Block) -> str:
    """A tab over a column gap, a blank over a word gap, else by the characters."""
    if a.boxed and b.boxed and (gap := b.l - a.r) > 0:
        widths = [w for x in (a, b) if (n := len("".join(x.text.split()))) and (w := max(0.0, x.r - x.l) / n) > 0]
        width = min(widths) if widths else None
        if gap >= max(WORD_GAP_PIXELS, (width or 0) * WORD_GAP):
            return "\t" if width and gap >= width * COLUMN_GAP else " "
    return word_separator(a.text.strip()[-1:], b.text.strip()[:1])


@dataclass
class _Shape:
    """Mean edges, height and spacing of a paragraph's lines, and its first top and last bottom."""

    left: float
    right: float
    height: float
    space: float
    top: float
    bottom: float

    @staticmethod
    def of(lines: list[Block]) -> _Shape:
        edges = np.array([(b.l, b.r, b.h, b.t, b.b) for b in lines])
        left, right, height = edges[:, :3].mean(axis=0).tolist()
        return _Shape(left, right, height, float((edges[1:, 3] - edges[:-1, 4]).mean()) if len(lines) > 1 else 0.0, edges[0, 3], edges[-1, 4])


def _homes(out: list[list[Block]], i: int) -> list[tuple[float, int]]:
    """(distance, side) of the neighbouring paragraphs that a single line aligns with: -1 for the one above, 1 for the one below."""
    line, found = out[i][0], []
    if i:
        above = _Shape.of(out[i - 1])
        gap = line.t - above.bottom
        if abs(line.l - above.left) <= line.h and line.r <= above.right and gap <= above.space + 0.5 * line.h:
            found.append((gap, -1))
    if i + 1 < len(out):
        below = _Shape.of(out[i + 1])
        indent = line.l - below.left
        if (indent >= line.h or abs(indent) <= line.h) and (len(out[i + 1]) == 1 or line.r <= below.right):
            found.append((below.top - line.b, 1))
    return found


def paragraphs_of(blocks: list[Block]) -> list[list[Block]]:
    """Consecutive blocks with like edges and line spacing; single lines join the neighbour they align with, the nearer one of two."""
    out: list[list[Block]] = []
    for b in blocks:
        shape = _Shape.of(out[-1]) if out else None
        if shape and max(abs(shape.left - b.l), abs(shape.right - b.r)) <= shape.height * ALIGN and b.t - shape.bottom <= shape.space + 0.5 * shape.height:
            out[-1].append(b)
        else:
            out.append([b])
    i = 0
    while i < len(out):
        homes = _homes(out, i) if len(out[i]) == 1 else []
        if homes:
            _, side = min(homes)
            out[min(i, i + side) : max(i, i + side) + 1] = [out[i - 1] + out[i] if side < 0 else out[i] + out[i + 1]]
        else:
            i += 1
    return out


def arrange(blocks: list[Block], parser: str) -> list[Block]:
    """The blocks in the parser's order, each with what stands behind it."""
    key = ALIASES.get(parser, parser)
    if key not in PARSERS or key == "none" or not blocks:
        for b, more in zip(blocks, [*([True] * (len(blocks) - 1)), False]):
            b.end = b.end or ("\n" if more else "")
        return blocks
    levelled(blocks)
    columns, what = key.split("_")
    if columns == "multi":
        ordered = reading_order(blocks)
        rows = rows_of_order(ordered)
    else:
        rows = rows_of(blocks, last_only=True)
        ordered = [b for r in rows for b in r]
    if what == "none":
        for b in ordered:
            b.end = "\n"
    else:
        for n, row in enumerate(rows):
            for x, y in zip(row, row[1:]):
                x.end = block_separator(x, y)
            row[-1].end = "\n"
        if what == "para":
            lines = [Block("".join(x.text + (x.end if x is not r[-1] else "") for x in r), None, [[0, 0]], min(x.l for x in r), min(x.t for x in r), max(x.r for x in r), max(x.b for x in r)) for r in rows]
            of = {id(line): r for line, r in zip(lines, rows)}
            paragraphs = paragraphs_of(lines)
            for p in paragraphs:
                for x, y in zip(p, p[1:]):
                    of[id(x)][-1].end = word_separator(x.text[-1:], y.text[:1])
                of[id(p[-1])][-1].end = "\n\n"
            ordered = [b for p in paragraphs for line in p for b in of[id(line)]]
    ordered[-1].end = ""
    return ordered


def rows_of_order(ordered: list[Block]) -> list[list[Block]]:
    """Rows of blocks that follow each other in reading order, from left to right, and overlap vertically."""
    rows: list[list[Block]] = []
    for b in ordered:
        last = rows[-1] if rows else []
        if last and b.l >= last[-1].l and _shares_line(b.t, b.b, min(x.t for x in last), max(x.b for x in last)):
            last.append(b)
        else:
            rows.append([b])
    return rows


_LAID = T.StructType([T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("text", T.StringType())])


def layout(blocks: Column, parser: Column) -> Column:
    """struct(blocks in order with their ends, assembled text) of an array of blocks and a parser's name; empty and null arrays give no text."""

    @F.pandas_udf(_LAID)
    def run(pages: pd.Series, parsers: pd.Series) -> pd.DataFrame:
        out = []
        for page, name in zip(pages, parsers):
            own = [Block((x["text"] or "").strip(), x["score"], [list(p) for p in x["box"]] if x["box"] is not None else [], end=x.get("end") or "") for x in (page if page is not None else [])]
            laid = arrange([b for b in own if b.text], name or "none")
            out.append(([{"text": b.text, "score": b.score, "box": b.points or None, "end": b.end} for b in laid], "".join(b.text + b.end for b in laid).strip()))
        return pd.DataFrame(out, columns=["blocks", "text"])

    return run(blocks, parser)


# --- geometry in Catalyst -------------------------------------------------------------------------


def box_edges(box: Column) -> Column:
    """struct(left, top, right, bottom) of a polygon; null for none."""
    xs, ys = F.transform(box, lambda p: F.get(p, F.lit(0))), F.transform(box, lambda p: F.get(p, F.lit(1)))
    return F.when(F.size(box) > 0, F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom")))


def inside_any(box: Column, areas: list[tuple[float, float, float, float]]) -> Column:
    """Whether the box's centre is in one of the rectangles (edges count, corners in any order); a block without a box is in none."""
    e = box_edges(box)
    x, y = (e["left"] + e["right"]) / 2, (e["top"] + e["bottom"]) / 2
    hit = F.lit(False)
    for x1, y1, x2, y2 in areas:
        hit = hit | (x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return F.coalesce(hit, F.lit(False))


def shift_box(box: Column, dx: Column, dy: Column) -> Column:
    return F.transform(box, lambda p: F.array(F.get(p, F.lit(0)) + dx, F.get(p, F.lit(1)) + dy))


def union_area(rectangles: list[tuple[float, float, float, float]]) -> float:
    """Area of the union of rectangles: strips between neighbouring edges, merged lengths in each."""
    xs = sorted({x for l, _, r, _ in rectangles for x in (l, r)})
    area = 0.0
    for a, b in zip(xs, xs[1:]):
        spans = sorted((t, e) for l, t, r, e in rectangles if l <= a and r >= b and e > t)
        reach = -math.inf
        for t, e in spans:
            if e > reach:
                area += (b - a) * (e - max(t, reach))
                reach = e
    return area


def uncovered(images: list, texts: list, width: float, height: float, least: float = 0.05, most: float = 0.2) -> list:
    """Image boxes of a good part of the page that text covers little of; boxes are (left, bottom, right, top)."""
    out = []
    for l, b, r, t in images:
        size = max(0.0, r - l) * max(0.0, t - b)
        if size <= 0 or size < least * width * height:
            continue
        parts = [(max(l, x[0]), max(b, x[1]), min(r, x[2]), min(t, x[3])) for x in texts]
        if union_area([p for p in parts if p[2] > p[0] and p[3] > p[1]]) < most * size:
            out.append((l, b, r, t))
    return out


def uncovered_regions(images: Column, texts: Column, width: Column, height: Column) -> Column:
    """The image boxes of a page that a second recognition should look at."""
    kind = T.ArrayType(T.ArrayType(T.DoubleType()))

    @F.pandas_udf(kind)
    def run(i: pd.Series, t: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([[list(map(float, b)) for b in uncovered([] if a is None else list(a), [] if c is None else list(c), x or 0.0, y or 0.0)] for a, c, x, y in zip(i, t, w, h)])

    return run(images, texts, width, height)


def merge_fragments(*parts: Column) -> Column:
    """Texts of fragments (array of struct(top, left, text), top growing upwards) by reading order, joined by line feeds; blanks left out."""
    every = F.filter(F.concat(*[F.coalesce(p, F.array().cast("array<struct<top:double,left:double,text:string>>")) for p in parts]), lambda x: F.trim(x["text"]) != "")
    numbered = F.transform(every, lambda x, i: F.struct((-x["top"]).alias("a"), x["left"].alias("b"), i.alias("n"), x["text"].alias("text")))
    return F.array_join(F.transform(F.array_sort(numbered), lambda x: x["text"]), "\n")


def page_confidence(scores: Column) -> Column:
    """struct(avg, min) over the scores that are there; null where none is."""
    real = F.filter(scores, lambda s: s.isNotNull())
    return F.struct((F.aggregate(real, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(real), F.lit(0))).alias("avg"), F.array_min(real).alias("min"))


def needs_retry(scores: Column, threshold: Column | float = 0.55, low_blocks: int = 6, low_average: float = 0.7) -> Column:
    """Many low scores; or at least two, half of all, and a low average."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    real = F.filter(scores, lambda s: s.isNotNull())
    low = F.size(F.filter(real, lambda s: s < limit))
    total = F.size(real)
    average = F.aggregate(real, F.lit(0.0), lambda a, x: a + x) / F.nullif(total, F.lit(0))
    return F.coalesce((total > 0) & ((low >= low_blocks) | ((low >= 2) & (low / F.nullif(total, F.lit(0)) >= 0.5) & (average < low_average))), F.lit(False))


def second_is_better(first_blocks: Column, first_min: Column, first_avg: Column, second_blocks: Column, second_min: Column, second_avg: Column, most_lost: int = 2, gain: float = 0.03) -> Column:
    """Whether a second recognition replaces the first."""
    return F.coalesce((second_blocks >= first_blocks - most_lost) & (0.5 * second_min + 0.5 * second_avg > 0.5 * first_min + 0.5 * first_avg + gain), F.lit(False))


def page_blocks(blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """One row a page with its blocks as an array in line order; repeated blocks count once."""
    rows = blocks.select(page, "line_no", "block_id", F.struct("text", "score", "box", F.col("end_sep").alias("end")).alias("block")).dropDuplicates([page, "block_id"])
    return rows.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "block_id", "block"))), lambda x: x["block"]).alias("blocks"))

"""Splitting of oversized texts into overlapping pieces at natural boundaries.

Every position of a text has one successor: the farthest legal end of the piece that
follows it, overlap included.  The successors of all positions of all texts of a batch are
one array, and the greedy cuts of all texts are the orbits of their first ends under it.
The orbits are found by pointer doubling: each round marks the successors of all marks
and squares the successor array, so the number of rounds is the logarithm of the number of
pieces, not the number of pieces.

Legal ends, best first: paragraph break, line break or sentence end, clause mark, blank,
and between any two characters that are not one printed character.  A piece takes the farthest
end of the best kind found in the second half of its room; when no kind is found there it
takes the farthest blank in its room, and when there is none it is filled to the limit.

Defined results: null texts give no piece; empty texts give one empty piece; a limit of 0 or
less, or no text over the limit, gives one piece; the project's default limit stands for a null
limit and for units whose config is not known.  An overlap of the limit or more is lowered to
limit - 1, so that every piece makes progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_LIMIT = 2200
# Marks after which a text may be cut.
SENTENCE_ENDS = ".!?…。！？；"
CLAUSE_ENDS = ",;:，、：)]）】」』”"
CLOSERS = "\"'”’)]）】」』»"

#: Arrow batches are worked on in groups of at most so many characters (a longer text is a group of its own).
GROUP_CHARS = 2_000_000
PARAGRAPH, SENTENCE, CLAUSE, WORD, ANY = 4, 3, 2, 1, 0


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _in(points: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(points, np.array([ord(c) for c in chars], dtype=np.uint32))


def boundary_kinds(points: np.ndarray) -> np.ndarray:
    """kind[p] for p in 0..n: how good a cut between code points p-1 and p is; -1 where none is legal."""
    n = len(points)
    kind = np.zeros(n + 1, dtype=np.int8)
    if n < 2:
        return kind
    blank = _in(points, " \t\r\n\x0b\x0c\x85\xa0     　") | ((points >= 0x2000) & (points <= 0x200A))
    line = points == 10
    before, after = points[:-1], points[1:]  # around the inner position p = index + 1
    inner = kind[1:n]
    inner[_in(before, CLAUSE_ENDS)] = CLAUSE
    ends = _in(before, SENTENCE_ENDS)
    # a closing mark right behind a sentence end belongs to the sentence; a Latin full stop needs a blank behind it
    closes = np.zeros(n - 1, dtype=bool)
    closes[1:] = _in(before[1:], CLOSERS) & ends[:-1]
    latin = _in(before, ".!?,;:")
    inner[ends | closes] = SENTENCE
    inner[latin & ~blank[1:]] = ANY
    inner[blank[:-1] & (inner < WORD)] = WORD
    # behind a sentence end and its blank is as good as right at it, and keeps the blank with its sentence
    behind = np.zeros(n - 1, dtype=bool)
    behind[1:] = blank[:-2] | False
    sentence_blank = np.zeros(n - 1, dtype=bool)
    sentence_blank[1:] = blank[1:-1] & (ends | closes)[:-1]
    inner[sentence_blank] = SENTENCE
    inner[line[:-1]] = SENTENCE
    # the last line feed of two or more, with only blanks between them, ends a paragraph
    if n > 2:
        at = np.flatnonzero(line)
        nonblank = np.concatenate([[0], np.cumsum(~blank)])
        paragraph = at[1:][(nonblank[at[1:]] - nonblank[at[:-1]]) == 0]
        inner[paragraph[paragraph < n - 1]] = PARAGRAPH
    # a run of blanks is cut behind its end, never inside
    inner[blank[:-1] & blank[1:] & (inner < PARAGRAPH)] = ANY
    glued = ((after >= 0x300) & (after <= 0x36F)) | ((after >= 0xFE00) & (after <= 0xFE0F)) | (after == 0x200D) | (before == 0x200D) | ((before == 13) & (after == 10))
    inner[glued] = -1
    return kind


def cut_ends(kinds: np.ndarray, starts: np.ndarray, lengths: np.ndarray, limits: np.ndarray, overlaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, end) of every piece, in order.  ``kinds``: the kinds of boundary of all texts one after another
    (length + 1 entries a text); ``starts``: where each text's entries start; the other arrays: one value a text."""
    total = len(kinds)
    owner = np.repeat(np.arange(len(starts)), lengths + 1)
    base, limit, overlap = starts[owner], limits[owner], overlaps[owner]
    here = np.arange(total)
    last = base + lengths[owner]
    begin = np.maximum(base, here - overlap)
    begin[starts] = starts  # the first piece starts at the text's start
    room = np.minimum(begin + limit, last)
    half = np.maximum(here + 1, np.minimum(begin + (limit + 1) // 2, last))
    index = np.arange(total)
    best = np.full(total, -1)
    for kind in (PARAGRAPH, SENTENCE, CLAUSE, WORD):
        farthest = np.maximum.accumulate(np.where(kinds >= kind, index, -1))[room]
        best = np.where((best < 0) & (farthest >= half), farthest, best)
    word = np.maximum.accumulate(np.where(kinds >= WORD, index, -1))[room]
    best = np.where((best < 0) & (word > here), word, best)
    legal = np.maximum.accumulate(np.where(kinds >= ANY, index, -1))[room]
    best = np.where((best < 0) & (legal > here), legal, best)
    best = np.where(best < 0, room, best)
    step = np.where(room >= last, last, best)
    marked = np.zeros(total, dtype=bool)
    frontier = step[starts]
    marked[frontier] = True
    while True:  # pointer doubling
        more = step[np.flatnonzero(marked)]
        if marked[more].all():
            break
        marked[more] = True
        step = step[step]
    ends = np.flatnonzero(marked)
    return owner[ends], ends - starts[owner[ends]]


def split_text(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int]]:
    """(start, end) of each piece of one text."""
    overlap = max(0, min(overlap, limit - 1))
    if limit <= 0 or len(text) <= limit:
        return [(0, len(text))]
    _, ends = cut_ends(boundary_kinds(_points(text)), np.array([0]), np.array([len(text)]), np.array([limit]), np.array([overlap]))
    return [(max(0, a - overlap) if i else 0, b) for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist()))]


def split_units(units: DataFrame, configs: DataFrame, key: str = "unit_id", text: str = "text", config: str = "config_id", limit: str = "extraction_max_char_buffer", increment: str = "extraction_passes_increment", default_limit: int = DEFAULT_LIMIT, keep_text: bool = True) -> DataFrame:
    """``key``, ``piece_no`` (from 1), ``n_pieces``, ``start_pos``, ``end_pos`` and ``piece`` of every text.

    The limit and the overlap (limit - increment, none for a null increment) come from the text's config by an ordinary
    left join; whether the configs are broadcast is left to the optimizer, which knows their size.  A config that is there twice counts
    once (its smallest row).  The cutting is one narrow pass.  Repeated rows each give their pieces.
    """
    settings = configs.where(F.col(config).isNotNull()).groupBy(F.col(config).alias("__config")).agg(F.min(F.struct(F.col(limit).alias("l"), F.col(increment).alias("i"))).alias("__s"))
    size = F.coalesce(F.col("__s.l"), F.lit(default_limit)).cast("int")
    joined = units.select(F.col(key), F.col(text).alias("__text"), F.col(config).alias("__config")).where(F.col(text).isNotNull()).join(settings, "__config", "left").select(key, "__text", size.alias("__limit"), F.greatest(F.lit(0), size - F.col("__s.i")).cast("int").alias("__overlap"))
    fields = [T.StructField(key, units.schema[key].dataType)] + [T.StructField(n, T.IntegerType(), False) for n in ("piece_no", "n_pieces", "start_pos", "end_pos")]
    if keep_text:
        fields.append(T.StructField("piece", T.StringType(), False))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            limits = np.array(batch.column(2).to_pylist(), dtype=np.int64)
            overlaps = np.array([x or 0 for x in batch.column(3).to_pylist()], dtype=np.int64)
            a = 0
            while a < len(texts):
                b, chars = a, 0
                while b < len(texts) and (b == a or chars + len(texts[b]) <= GROUP_CHARS):
                    chars += len(texts[b])
                    b += 1
                lengths = np.array([len(t) for t in texts[a:b]], dtype=np.int64)
                room = np.where((limits[a:b] <= 0) | (lengths <= limits[a:b]), np.maximum(lengths, 1), limits[a:b])
                over = np.minimum(overlaps[a:b], room - 1)
                starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
                kinds = np.concatenate([boundary_kinds(_points(t)) if lengths[i] > room[i] else np.zeros(lengths[i] + 1, dtype=np.int8) for i, t in enumerate(texts[a:b])])
                owner, ends = cut_ends(kinds, starts, lengths, room, over)
                first = np.concatenate([[True], owner[1:] != owner[:-1]])
                begins = np.where(first, 0, np.concatenate([[0], ends[:-1]]) - over[owner])
                begins = np.maximum(begins, 0)
                counts = np.bincount(owner, minlength=b - a)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
                columns = [batch.column(0).slice(a, b - a).take(pa.array(owner))] + [pa.array(x.astype(np.int32)) for x in (number, counts[owner], begins, ends)]
                if keep_text:
                    columns.append(pa.array([texts[a + o][x:y] for o, x, y in zip(owner.tolist(), begins.tolist(), ends.tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type, f.nullable) for f, c in zip(fields, columns)]))
                a = b

    return joined.mapInArrow(run, schema)


def oversized_units(units: DataFrame, configs: DataFrame, **names: str) -> DataFrame:
    """Keys of the units that had to be cut, one row each: those of which the splitting made more than one piece."""
    key = names.get("key", "unit_id")
    return split_units(units, configs, keep_text=False, **names).where("n_pieces > 1 and piece_no = 1").select(key).distinct()

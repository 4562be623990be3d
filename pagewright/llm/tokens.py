"""Encoding of texts by a public byte-level BPE vocabulary.

Pre-tokenisation uses no regular expression.  Each code point gets a class from a table
(with one or two code points of look-ahead folded in by shifted comparisons); a class
is a transition function of a small automaton, and the functions that can arise by
composition form a finite monoid.  A doubling scan over the monoid's multiplication table
gives the state before every code point of a whole batch at once, and with it the
places where a piece starts.  Pieces are looked up in a cache; a piece that is not in
it is merged pair by pair with the vocabulary's ranks.

Defined results: null and empty texts give an empty list of ids (and of offsets).
Special tokens are never produced; their strings are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_FOLDER = os.environ.get("PAGEWRIGHT_TOKENIZERS", "/opt/tokenizers")
#: Pieces that one worker keeps with their ids; the cache is emptied when it is full, which changes no result.
CACHE_PIECES = 400_000

# classes of code points, after look-ahead
LETTER, NUMBER, OTHER, SPACE_BEFORE, BLANK_BEFORE, BLANK, QUOTE_1, QUOTE_2 = range(8)
# states: what the last code point left behind
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)

# next state by class (row) and state (column)
_NEXT = np.array(
    [
        [IN_LETTERS, IN_LETTERS, IN_LETTERS, IN_LETTERS, IN_LETTERS, IN_LETTERS, FRESH, ONE_MORE],
        [IN_NUMBERS] * 8,
        [IN_OTHERS] * 8,
        [AFTER_SPACE] * 8,
        [IN_BLANKS] * 8,
        [IN_BLANKS] * 8,
        [ONE_MORE, ONE_MORE, ONE_MORE, IN_OTHERS, IN_OTHERS, ONE_MORE, ONE_MORE, ONE_MORE],
        [TWO_MORE, TWO_MORE, TWO_MORE, IN_OTHERS, IN_OTHERS, TWO_MORE, TWO_MORE, TWO_MORE],
    ],
    dtype=np.uint8,
)


def _joins() -> np.ndarray:
    """joins[state, class]: the code point belongs to the piece before it."""
    j = np.zeros((8, 8), dtype=bool)
    j[IN_LETTERS, LETTER] = j[AFTER_SPACE, LETTER] = j[ONE_MORE, LETTER] = j[TWO_MORE, LETTER] = True
    j[IN_NUMBERS, NUMBER] = j[AFTER_SPACE, NUMBER] = True
    for other in (OTHER, QUOTE_1, QUOTE_2):
        j[IN_OTHERS, other] = j[AFTER_SPACE, other] = True
    j[IN_BLANKS, BLANK] = True
    return j


_JOINS = _joins()


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, product table, value of constant elements or 255)."""
    elements = [tuple(row) for row in _NEXT]
    index = {e: i for i, e in reversed(list(enumerate(elements)))}
    i = 0
    while i < len(elements):
        for c in range(8):
            composed = tuple(_NEXT[c][s] for s in elements[i])
            if composed not in index:
                index[composed] = len(elements)
                elements.append(composed)
        i += 1
    table = np.array([[index[tuple(b[s] for s in a)] for b in elements] for a in elements], dtype=np.uint8)
    return np.array([index[tuple(row)] for row in _NEXT], dtype=np.uint8), table, np.array([e[0] if len(set(e)) == 1 else 255 for e in elements], dtype=np.uint8)


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            table[c] = LETTER
        elif major == "N":
            table[c] = NUMBER
    for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[a : b + 1] = BLANK
    return table


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a piece starts.  ``points``: the code points of all texts, one after another;
    ``text_starts``: where each non-empty text starts."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=bool)
    plain = _classes()[points]
    kind = plain.copy()
    last = np.zeros(n, dtype=bool)
    last[text_starts[1:] - 1] = True
    last[-1] = True
    following = np.empty_like(plain)
    following[:-1], following[-1] = plain[1:], BLANK
    following[last] = BLANK
    before_text = (plain == BLANK) & (following != BLANK)
    kind[before_text] = BLANK_BEFORE
    kind[before_text & (points == 32)] = SPACE_BEFORE
    quotes = np.flatnonzero((points == 39) & ~last)
    if len(quotes):
        one = points[quotes + 1]
        kind[quotes[np.isin(one, [ord(x) for x in "stmd"])]] = QUOTE_1
        two_ok = (quotes + 2 < n) & ~last[np.minimum(quotes + 1, n - 1)]
        two = np.where(two_ok, points[np.minimum(quotes + 2, n - 1)], 0)
        for a, b in ("re", "ve", "ll"):
            kind[quotes[(one == ord(a)) & (two == ord(b))]] = QUOTE_2
    of_class, product, constant = _monoid()
    prefix = of_class[kind]
    # at a text's start the state is known, so the function there becomes the constant one
    at = {int(constant[e]): e for e in range(len(constant) - 1, -1, -1) if constant[e] != 255}
    known = np.array([at.get(s, 255) for s in range(8)], dtype=np.uint8)
    first = known[_NEXT[kind[text_starts], FRESH]]
    unknown = first == 255
    prefix[text_starts[~unknown]] = first[~unknown]
    held = {}
    if unknown.any():  # states that no constant function has: carried by hand below
        held = {int(p): int(_NEXT[kind[p], FRESH]) for p in text_starts[unknown]}
    open_at = np.flatnonzero(constant[prefix] == 255)
    open_at = open_at[open_at > 0]
    begins = np.zeros(n, dtype=bool)
    begins[text_starts] = True
    step = 1
    state = constant[prefix]
    for p, s in held.items():
        state[p] = s
    open_at = open_at[~begins[open_at]]
    if held:  # few: walk them forward until the state is a constant's
        for p, s in sorted(held.items()):
            q = p + 1
            while q < n and not begins[q] and constant[prefix[q]] == 255:
                s = int(_NEXT[kind[q], s])
                state[q] = s
                q += 1
        open_at = open_at[state[open_at] == 255]
    while len(open_at):
        back = open_at - step
        done = state[back] != 255
        closed = open_at[done]
        # the element reaches back to a known state: apply it
        values = _elements()[prefix[closed], state[back[done]]]
        new = product[prefix[back[~done]], prefix[open_at[~done]]]
        state[closed] = values
        rest = open_at[~done]
        prefix[rest] = new
        solved = constant[new] != 255
        state[rest[solved]] = constant[new[solved]]
        open_at = rest[~solved]
        step *= 2
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = FRESH, state[:-1]
    starts = ~_JOINS[before, kind]
    starts[text_starts] = True
    return starts


@functools.cache
def _elements() -> np.ndarray:
    """value[element, state] of all functions of the monoid."""
    elements = [tuple(row) for row in _NEXT]
    seen = set(elements)
    i = 0
    while i < len(elements):
        for c in range(8):
            composed = tuple(_NEXT[c][s] for s in elements[i])
            if composed not in seen:
                seen.add(composed)
                elements.append(composed)
        i += 1
    return np.array(elements, dtype=np.uint8)


class Encoder:
    """Ids of pieces by one rank file, with a cache of pieces."""

    def __init__(self, rank_file: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        # the pattern takes the whole string: only the pair merging of the library is used
        self.merger = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat = array("i")
        self.begin = array("q", [0])

    def code(self, piece: str) -> int:
        found = self.codes.get(piece)
        if found is None:
            found = self.codes[piece] = len(self.begin) - 1
            self.flat.extend(self.merger.encode_ordinary(piece))
            self.begin.append(len(self.flat))
        return found

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of each text's ids in them)."""
        full = "".join(t for t in texts if t)
        lengths = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(lengths)
        if not full:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        if len(self.codes) > CACHE_PIECES:
            self.clear()
        points = np.frombuffer(full.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        cuts = np.flatnonzero(piece_starts(points, (ends - lengths)[lengths > 0]))
        pieces_before = np.searchsorted(cuts, ends)  # of each text's end
        firsts = np.concatenate([[0], pieces_before[:-1]])
        where = (cuts - np.repeat(ends - lengths, pieces_before - firsts)).tolist()
        get, slow = self.codes.get, self.code
        found: list[int] = []
        for text, a, b in zip(texts, firsts.tolist(), pieces_before.tolist()):
            if a == b:
                continue
            at = where[a:b]
            pieces = [text[x:y] for x, y in zip(at, at[1:])]
            pieces.append(text[at[-1] :])
            codes_here = list(map(get, pieces))
            if None in codes_here:
                codes_here = [slow(p) if c is None else c for p, c in zip(pieces, codes_here)]
            found += codes_here
        codes = np.array(found, dtype=np.int64)
        begin, flat = np.frombuffer(self.begin, dtype=np.int64), np.frombuffer(self.flat, dtype=np.int32)
        begins = begin[codes]
        counts = begin[codes + 1] - begins
        stops = np.cumsum(counts)
        ids = flat[np.arange(stops[-1]) + np.repeat(begins - (stops - counts), counts)]
        del begin, flat  # the arrays can grow only while nothing looks into them
        upto = np.concatenate([[0], stops])[pieces_before]
        return ids, np.concatenate([[0], upto])

    def byte_ends(self, ids: np.ndarray) -> np.ndarray:
        """Running byte offset of the end of each token in the UTF-8 form of what the ids encode."""
        return np.cumsum([len(self.tokens[int(i)]) for i in ids], dtype=np.int64)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@functools.cache
def encoder(rank_file: str) -> Encoder:
    return Encoder(rank_file)


def _shipped(df: DataFrame, folder: str, vocabulary: str) -> str:
    """The name under which the rank file reaches every executor; only the driver needs the folder."""
    name = f"{vocabulary}.tiktoken"
    df.sparkSession.sparkContext.addFile(f"{folder}/{name}")
    return name


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, offsets: bool = False) -> DataFrame:
    """``key`` and ``ids`` of every row, and with ``offsets`` also ``ends``: the byte offset at which each token ends.

    One narrow pass: no shuffle, columns are pruned to two, each Arrow batch is pre-tokenised as one array.  Rows with a
    null key are kept.  Repeated rows each give their row.
    """
    name = _shipped(df, folder, vocabulary)
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    if offsets:
        fields.append(T.StructField("ends", T.ArrayType(T.LongType(), False), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 512):
                part = texts[a : a + 512]
                ids, at = own.encode_batch(part)
                at32 = pa.array(at, pa.int32())
                columns = [batch.column(0).slice(a, len(part)), pa.ListArray.from_arrays(at32, pa.array(ids, pa.int32()))]
                if offsets:
                    ends = own.byte_ends(ids)
                    base = np.repeat(np.concatenate([[0], ends])[at[:-1]], np.diff(at))
                    columns.append(pa.ListArray.from_arrays(at32, pa.array(ends - base, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(key, text).mapInArrow(run, T.StructType(fields))


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``key`` and ``text`` from ids; an empty list gives the empty text, a null list null."""
    name = _shipped(df, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())]))

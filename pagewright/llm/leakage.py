"""Held-out evaluation texts in a training corpus.

Candidates come from latent semantic retrieval.  Texts are squeezed (consistent form, folded, without blanks and
punctuation) and cut into overlapping passages; a passage is a TF-IDF vector over hashed character runs.
The document frequencies are counted over all documents.  A randomised subspace iteration over all passages gives an orthonormal basis of the
leading right singular space; every task adds up its share of the product with the Gram matrix, and only matrices of (features x rank)
leave the tasks.  Passages and the items' passages are compared by cosine in the latent space, block by block, as one
matrix product; pairs at or above ``COSINE`` are candidates.

Each candidate document and item is then aligned: runs of characters that both have are chained in
order within a stretch of the document, and the gaps between neighbouring runs are filled by their longest common subsequence.  The item
is leaked if the chain, slips inside it counted, covers at least ``COVERED`` of its text, more than a short sentence of it outside the standing
question (a closing sentence that several items share), scraps not counted.

Null, empty and blank documents and items match nothing.  Repeated documents each give their rows.  Items are
taken in blocks of ``ITEM_BLOCK``, so their number is not bounded.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import keep
from .forms import canonical_text

FEATURES = 1 << 14
RANK = 128
RUN = 4
#: One in so many features, chosen by hash, is in the vocabulary; the same ones for documents and items.
THINNING = 4
#: The basis is fitted on at most about so many documents, chosen by hash; frequencies, index and search cover all.
FIT_DOCUMENTS = 6_000
#: Tasks that share the fit's documents; each sends one matrix of fixed size.
FIT_TASKS = 16
#: Characters of half a passage, for texts in Chinese and in other scripts; passages are two halves and overlap by one.
HALF_HAN, HALF_OTHER = 32, 80
COSINE = 0.42
COVERED = 0.4
#: Shortest run of characters that counts as common, in Chinese and in other scripts.
SEED_HAN, SEED_OTHER = 5, 10
#: Outside the standing question more than so many characters must be covered (a single short sentence is no case), or the same part as of the whole.
SENTENCE_HAN, SENTENCE_OTHER = 16, 60
#: Stretches of a chain shorter than this are scraps, met by chance; they count only in a chain that fills this part of its span in the document.
SCRAP_HAN, SCRAP_OTHER, DENSE = 12, 32, 0.5
#: Gaps between neighbouring runs that are aligned: at most so many characters of the item and of the document;
#: a gap of which this part is common holds nothing but slips and counts whole.
GAP_ITEM, GAP_DOC, SLIPS = 40, 60, 0.7
#: At most so many characters before and after a chain are added to it: what a slip at the end of a copy cuts off, shorter than a seed.
EDGE = SEED_OTHER
#: Characters of the texts that are taken side by side.
TOGETHER = 400_000
#: Runs of the pairs that are chained side by side, at most so many unless one pair has more.
TABLE = 1 << 18
ITEM_BLOCK = 2000
#: A last sentence that so many items share is a standing question.
STANDING = 3

_NOISE = re.compile(r"[\W_]+")
_HAN = re.compile(r"[一-鿿]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？?!])")


def squeeze(text: str | None) -> str:
    """The folded consistent form without blanks and punctuation."""
    return _NOISE.sub("", canonical_text(text, fold=True)) if text else ""


def _is_han(s: str) -> bool:
    return len(_HAN.findall(s)) * 3 > len(s)


def _hashes(points: np.ndarray, run: int) -> np.ndarray:
    """A hash of the run that starts at each position; runs are put together from runs of RUN, the last of which may overlap the one before."""
    h = np.full(max(0, len(points) - RUN + 1), 0x811C9DC5, dtype=np.uint32)
    for k in range(RUN):
        h = (h ^ points[k : k + len(h)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    n = max(0, len(points) - run + 1)
    out = h[:n].copy()
    for k in [*range(RUN, run - RUN, RUN), run - RUN] if run > RUN else []:
        out = (out ^ h[k : k + n]) * np.uint32(0x85EBCA6B)
        out ^= out >> np.uint32(13)
    return out


def _buckets(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions whose run is in the vocabulary, their features)."""
    h = _hashes(points, RUN)
    at = np.flatnonzero(h % np.uint32(THINNING) == 0)
    return at, ((h[at] >> np.uint32(5)) & np.uint32(FEATURES - 1)).astype(np.int32)


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive texts of together about ``TOGETHER`` characters, or one longer text."""
    block = np.cumsum([len(t) for t in texts]) // TOGETHER
    edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(texts)]
    return zip(edges, edges[1:])


def _cells(points: np.ndarray) -> np.ndarray:
    """Number of the half passage that each character is in: HALF_HAN Chinese characters fill one, or HALF_OTHER others, or shares of both."""
    weight = np.where((points >= 0x4E00) & (points <= 0x9FFF), HALF_OTHER, HALF_HAN)
    return (np.cumsum(weight) - weight) // (HALF_HAN * HALF_OTHER)


def halves(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all texts one after another, start of each half passage in them, text of each half passage); halves without a feature are left out."""
    sizes = np.array([len(s) for s in texts], dtype=np.int64)
    whole = "".join(texts)
    if not whole:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = _points(whole)
    at, features = _buckets(points)
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, at, side="right")
    inside = at + RUN <= ends[owner]  # no run over the border of two texts
    at, features, owner = at[inside], features[inside], owner[inside]
    cell = np.concatenate([_cells(points[e - n : e]) for e, n in zip(ends, sizes)])[at]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1]))) if len(at) else np.zeros(0, np.int64)
    return features, new, owner[new]


def _passages(cell: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sum of each half with the next one of the same text."""
    out = cell.copy()
    same = np.flatnonzero(owner[1:] == owner[:-1])
    out[same] += cell[same + 1]
    return out


def _sums(basis: np.ndarray, features: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first half passage, features, sum of their rows for each half passage) in blocks whose rows stay in the processor's cache."""
    ends = np.append(starts, len(features))
    for a in range(0, len(starts), 256):
        b = min(a + 256, len(starts))
        own = features[ends[a] : ends[b]]
        yield a, own, np.add.reduceat(basis[own], starts[a:b] - ends[a], axis=0)


def _projected(features: np.ndarray, starts: np.ndarray, owner: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Passages in the space of the (weighted) basis."""
    return _passages(np.concatenate([y for _, _, y in _sums(basis, features, starts)]), owner)


def squeezed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, tuple[np.ndarray, int]]:
    """(``key`` and the squeezed ``text`` of every document with one, written once and read by all later passes; (documents that hold each
    feature, number of documents), counted over all of them in the same pass)."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(text, T.StringType()), T.StructField("counts", T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, dtype=np.int64)
        for batch in batches:
            texts = [squeeze(t) for t in batch.column(1).to_pylist()]
            for s in texts:
                if len(s) >= RUN:
                    held = np.zeros(FEATURES + 1, dtype=bool)
                    held[_buckets(_points(s))[1]] = held[-1] = True
                    df += held
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.nulls(len(texts), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, batch_type), pa.nulls(1, pa.string()), pa.array([df.tobytes()], pa.binary())], names=names)

    batch_type = to_arrow_type(schema[key].dataType)
    kept = keep(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, dtype=np.int64)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(total)], names=["feature", "n"])

    rows = kept.where("counts is not null").select("counts").mapInArrow(counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # one row for each feature
    df = np.zeros(FEATURES + 1, dtype=np.int64)
    df[rows["feature"]] = rows["n"]
    return kept.where("counts is null").where(F.col(text) != "").select(key, text), (df[:FEATURES], int(df[FEATURES]))


def _add_share(texts: list[str], weighted: np.ndarray, total: np.ndarray) -> None:
    """Add the texts' part of (X'X basis): X has a row of unit length in the latent space for each half passage."""
    features, starts, _ = halves(texts)
    if not len(starts):
        return
    sizes = np.diff(np.append(starts, len(features)))
    for a, own, y in _sums(weighted, features, starts):
        y /= np.maximum(1e-6, np.linalg.norm(y, axis=1, keepdims=True))
        at = np.repeat(np.arange(len(y)), sizes[a : a + len(y)])
        order = np.argsort(own, kind="stable")
        f = own[order]
        first = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        total[f[first]] += np.add.reduceat(y[at[order]], first, axis=0)


def whitened(product: np.ndarray) -> np.ndarray:
    """Orthonormal columns of a product with the Gram matrix, each over the root of its singular value: what
    most passages share (sentence frames) weighs less in the cosine than what few share."""
    u, sigma, _ = np.linalg.svd(product, full_matrices=False)
    return (u / np.sqrt(np.maximum(sigma, 1e-9 * sigma.max() + 1e-12))).astype(np.float32)


def latent_basis(docs: DataFrame, idf: np.ndarray, n_docs: int, text: str = "text", rank: int = RANK, rounds: int = 1, seed: int = 11) -> np.ndarray:
    """(features x rank) whitened basis of the leading right singular space of the passages' TF-IDF vectors, by randomised subspace iteration."""
    part_of = max(1, n_docs // FIT_DOCUMENTS)
    docs = docs.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(text), F.lit(part_of)) == 0)).select(text).repartition(FIT_TASKS)  # about FIT_DOCUMENTS rows, however many there are
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((FEATURES, rank)))[0].astype(np.float32)
    rows = 1024  # of a block
    for _ in range(rounds):
        weighted = docs.sparkSession.sparkContext.broadcast((basis * idf[:, None]).astype(np.float32))  # a matrix of fixed size

        def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((FEATURES, rank), dtype=np.float32)
            for batch in batches:
                texts = batch[text].tolist()
                for a, b in _stretches(texts):
                    _add_share(texts[a:b], weighted.value, total)
            for a in range(0, FEATURES, rows):
                yield pd.DataFrame({"block": [a], "part": [total[a : a + rows].tobytes()]})

        def add(key, parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"block": [key[0]], "part": [sum(np.frombuffer(p, dtype=np.float32).astype(np.float64) for p in parts["part"]).astype(np.float32).tobytes()]})

        shares = docs.select(text).mapInPandas(share, "block long, part binary").groupBy("block").applyInPandas(add, "block long, part binary").collect()
        product = np.zeros((FEATURES, rank), dtype=np.float64)
        for r in shares:  # a matrix of fixed size, whatever the number of documents
            product[r["block"] : r["block"] + rows] = np.frombuffer(r["part"], dtype=np.float32).reshape(-1, rank)
        basis = whitened(product * idf[:, None])
    return basis


class Item:
    """An item's squeezed text; ``body`` is its length without a standing question at the end."""

    __slots__ = ("text", "seed", "body", "item_id")

    def __init__(self, item_id: int, text: str, body: int):
        self.item_id, self.text, self.body = item_id, text, body
        self.seed = SEED_HAN if _is_han(text) else SEED_OTHER


def with_bodies(items: DataFrame, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, text, body) of every item with a text: squeezed, and the length of its body.  A standing question is a last sentence that at least
    ``STANDING`` items share, counted over all items."""
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("last", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lasts = [next((q for x in reversed(_SENTENCE.split(t)) if (q := squeeze(x))), "") for t in batch[text]]
            yield pd.DataFrame({"item_id": batch[item_key], "text": [squeeze(t) for t in batch[text]], "last": lasts})

    own = items.where(F.col(item_key).isNotNull() & F.col(text).isNotNull()).select(item_key, text).distinct().mapInPandas(run, schema).where(F.length("text") >= RUN)
    standing = own.where("last <> ''").groupBy("last").agg(F.count("*").alias("n")).where(F.col("n") >= STANDING).select("last", F.lit(True).alias("stands"))
    size, last = F.length("text"), F.length("last")
    return own.join(standing, "last", "left").select("item_id", "text", F.when(F.col("stands") & (last < size), size - last).otherwise(size).alias("body"))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    mask: dict[str, int] = {}
    for i, c in enumerate(a):
        mask[c] = mask.get(c, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for c in b:
        u = v & mask.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _reach_out(item: str, doc: str, i: int, j: int, step: int) -> int:
    """Characters of the item beyond a chain's end at (i, j) that go on in the document but for single slips, each followed by RUN equal characters."""
    start, good = i, i
    while 0 <= i < len(item) and 0 <= j < len(doc) and abs(i - start) < EDGE:
        if item[i] == doc[j]:
            i, j = i + step, j + step
            good = i
            continue
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            x, y = i + di * step, j + dj * step
            a, b = (item[x : x + RUN], doc[y : y + RUN]) if step > 0 else (item[max(0, x - RUN + 1) : x + 1], doc[max(0, y - RUN + 1) : y + 1])
            if x >= 0 and y >= 0 and len(a) == RUN and a == b:
                i, j = x, y
                break
        else:
            break
    return min(abs(good - start), EDGE)


def coverage(doc: str, item: Item) -> tuple[float, float]:
    """What ``Seeds.coverages`` gives for one document and one item, without leaving out what is no case."""
    return next((c for _, _, c in Seeds([item]).coverages([doc], np.zeros((1, 2), dtype=np.int64), 0.0)), (0.0, 0.0))


def _common_runs(doc: str, item: Item) -> list[np.ndarray]:
    """Maximal common runs of a document and an item by their characters: item start, document start, length."""
    at: dict[str, list[int]] = {}
    for i in range(len(item.text) - item.seed + 1):
        at.setdefault(item.text[i : i + item.seed], []).append(i)
    hits = sorted((j - i, i) for j in range(len(doc) - item.seed + 1) for i in at.get(doc[j : j + item.seed], ()))
    runs: list[list[int]] = []
    for d, i in hits:
        if runs and runs[-1][0] == d and runs[-1][1] + runs[-1][2] - item.seed + 1 == i:
            runs[-1][2] += 1
        else:
            runs.append([d, i, item.seed])
    table = np.array(runs, dtype=np.int64).reshape(-1, 3)
    return [table[:, 1], table[:, 0] + table[:, 1], table[:, 2]]


def covered_part(doc: str, item: Item, chain: list[tuple[int, int, int]]) -> tuple[float, float]:
    """(part of the item that the chain covers, characters that it covers outside the standing question); slips inside
    what was copied count as covered, scattered scraps do not."""
    size, seed = len(item.text), item.seed
    pieces: list[list[int]] = []  # item start, item end: runs with nothing but slips between them
    filled: list[tuple[int, float]] = []  # paraphrased gaps: item start, characters in common
    stretches: list[tuple[list, list]] = []  # pieces and paraphrased gaps that hang together
    for i, j, k in chain:
        if pieces:
            gap_i, gap_j = i - last_i, j - last_j
            common = _lcs(item.text[last_i:i], doc[max(last_j, 0) : max(j, last_j)]) if 0 < gap_i <= GAP_ITEM and gap_j <= GAP_DOC else 0
            if gap_i <= 0 and gap_j <= GAP_DOC or common >= SLIPS * max(gap_i, gap_j) or 0 < gap_i <= 2 and gap_j <= 2:
                pieces[-1][1] = max(pieces[-1][1], i + k)
            else:
                if common >= 0.5 * gap_i > 0 and gap_j <= 2 * gap_i + 10:  # in a longer gap so much is common by chance
                    filled.append((last_i, common))
                else:
                    pieces, filled = [], []
                    stretches.append((pieces, filled))
                pieces.append([i, i + k])
        else:
            pieces.append([i, i + k])
            stretches.append((pieces, filled))
        last_i, last_j = i + k, j + k
    i, j, _ = chain[0]
    stretches[0][0][0][0] -= _reach_out(item.text, doc, i - 1, j - 1, -1)
    i, j, k = chain[-1]
    stretches[-1][0][-1][1] += _reach_out(item.text, doc, i + k, j + k, 1)
    length = [sum(b - a for a, b in p) + sum(c for _, c in f) for p, f in stretches]
    if sum(length) < DENSE * (chain[-1][1] + chain[-1][2] - chain[0][1]):
        stretches = [x for x, n in zip(stretches, length) if n >= (SCRAP_HAN if seed == SEED_HAN else SCRAP_OTHER)]
    covered = np.zeros(size, dtype=bool)
    for pieces, _ in stretches:
        for a, b in pieces:
            covered[a:b] = True
    gaps = [x for _, filled in stretches for x in filled]
    body = covered[: item.body].sum() + sum(c for a, c in gaps if a < item.body)
    return float((covered.sum() + sum(c for _, c in gaps)) / size), float(body)


def is_leaked(found: tuple[float, float], item: Item, covered: float = COVERED) -> bool:
    """Whether what ``coverage`` gives is a case."""
    whole, body = found
    return whole >= covered and body >= min(SENTENCE_HAN if item.seed == SEED_HAN else SENTENCE_OTHER, covered * item.body)


_FOUND = "item_id long, part double"


def leaked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", cosine: float = COSINE, covered: float = COVERED, with_part: bool = False) -> DataFrame:
    """(``key``, ``item_key``) of every document that holds enough of an item; with ``with_part`` also which part of it."""
    docs, counts = squeezed(docs, key, text)
    df, n = counts
    idf = np.log((n + 1) / (df + 1.0)).astype(np.float32)
    weighted = (latent_basis(docs, idf, n, text) * idf[:, None]).astype(np.float32)
    rows = with_bodies(items, item_key, text).orderBy("item_id", "text").toLocalIterator()
    found = None
    while True:
        block = [Item(*r) for r in itertools.islice(rows, ITEM_BLOCK)]
        if not block and found is not None:
            break
        part = _search(docs, block, weighted, key, text, cosine, covered)
        found = part if found is None else found.unionByName(part)
    found = found.groupBy(key, "item_id").agg(F.max("part").alias("part")).withColumnRenamed("item_id", item_key)
    return found if with_part else found.select(key, item_key)


def item_vectors(items: list[Item], weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit latent vectors of the items' passages, which overlap by a half, item number of each)."""
    vectors, owner = [], []
    for n, item in enumerate(items):
        points = _points(item.text)
        at, f = _buckets(points)
        cell = _cells(points)[at]
        for c in range(max(1, int(cell[-1]) if len(cell) else 0)):
            inside = (cell == c) | (cell == c + 1)
            if inside.any():
                vectors.append(weighted[f[inside]].sum(0))
                owner.append(n)
    v = np.array(vectors, dtype=np.float32).reshape(-1, weighted.shape[1])
    return v / np.maximum(1e-6, np.linalg.norm(v, axis=1, keepdims=True)), np.array(owner, dtype=np.int64)


class Seeds:
    """Hashes of all seeds of a block of items, and with them the alignment of texts and items: common runs, bounds, chains."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.size = np.array([len(i.text) for i in items], dtype=np.int64)
        self.seed = np.array([i.seed for i in items], dtype=np.int64)
        self.longest = int(self.size.max()) + 1 if items else 1
        self.tables = {}
        for run in (SEED_HAN, SEED_OTHER):
            own = [(k, _hashes(_points(item.text), run)) for k, item in enumerate(items) if item.seed == run]
            if own:
                h = np.concatenate([x for _, x in own])
                item, at = np.concatenate([np.full(len(x), k) for k, x in own]), np.concatenate([np.arange(len(x)) for _, x in own])
                order = np.argsort(h, kind="stable")
                held = np.zeros(1 << 20, dtype=bool)
                held[h & np.uint32((1 << 20) - 1)] = True
                self.tables[run] = h[order], item[order], at[order], held

    def runs(self, texts: list[str], pairs: np.ndarray) -> tuple[np.ndarray, ...]:
        """(pair, item start, document start, length) of all maximal common runs of at least a seed, by pair, diagonal and item start."""
        wanted = np.unique(pairs[:, 0])
        row = np.zeros(len(texts), dtype=np.int64)
        row[wanted] = np.arange(len(wanted))
        number = np.full((len(wanted), len(self.items)), -1, dtype=np.int64)
        number[row[pairs[:, 0]], pairs[:, 1]] = np.arange(len(pairs))
        points = _points("\n".join(texts[i] for i in wanted) + "\n")
        ends = np.cumsum([len(texts[i]) + 1 for i in wanted])
        longest, span = self.longest, len(points) + self.longest + 1
        if len(pairs) * span * longest >= 1 << 62 and len(texts) > 1:  # too much for one key: half of the texts at a time
            half = pairs[:, 0] < len(texts) // 2
            parts = [(at, self.runs(texts, pairs[at])) for at in (np.flatnonzero(half), np.flatnonzero(~half)) if len(at)]
            return tuple(np.concatenate([at[r[0]] if c == 0 else r[c] for at, r in parts]) for c in range(4))
        keys = [np.zeros(0, dtype=np.int64)]
        for run, (table, items, places, held) in self.tables.items():
            h = _hashes(points, run)
            hit = np.flatnonzero(held[h & np.uint32((1 << 20) - 1)])
            own = h[hit]
            low = np.searchsorted(table, own)
            some = table[np.minimum(low, len(table) - 1)] == own
            hit, low, own = hit[some], low[some], own[some]
            n = np.searchsorted(table, own, side="right") - low
            of = np.repeat(np.searchsorted(ends, hit, side="right"), n)
            low = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))  # each place in the items that has the seed
            pair = number[of, items[low]]
            kept = np.flatnonzero(pair >= 0)
            at = places[low[kept]]
            keys.append((pair[kept] * span + np.repeat(hit, n)[kept] - at + longest) * longest + at)
        key = np.sort(np.concatenate(keys))  # the hits of a run follow each other by one
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1] + 1)) if len(key) else np.zeros(0, np.int64)
        rest, at = np.divmod(key[first], longest)
        pair, diagonal = np.divmod(rest, span)
        start = (ends - np.array([len(texts[i]) + 1 for i in wanted], dtype=np.int64))[row[pairs[pair, 0]]] if len(pair) else pair
        return pair, at, diagonal - longest + at - start, np.diff(np.append(first, len(key))) + self.seed[pairs[pair, 1]] - 1

    def coverages(self, texts: list[str], pairs: np.ndarray, covered: float) -> Iterator[tuple[int, int, tuple[float, float]]]:
        """(text number, item number, what ``covered_part`` gives) of the pairs that may be covered; no pair that is gets lost.

        The first bound counts every character of the item in some common run, in whatever order, every gap between
        runs that could be filled (at most GAP_ITEM characters, the runs' diagonals at most GAP_DOC apart), and
        the chain's two ends; the second one the same along the best chain."""
        pair, at, place, k = self.runs(texts, pairs)
        asked = covered * self.size[pairs[:, 1]] - 2 * EDGE - 1e-6
        width = self.longest
        end = at + k
        stripe = (place - at + width) // GAP_DOC
        stripes = int(stripe.max(initial=0)) + 2
        for shift in (0, 1):  # two runs whose diagonals are at most GAP_DOC apart are in one double stripe
            group = (pair * stripes + (stripe + shift) // 2) * width
            order = np.argsort(group + at)
            g = group[order]
            reached = np.maximum.accumulate(g + at[order] + k[order])
            following = np.flatnonzero((g[1:] == g[:-1]) & (g[1:] + at[order[1:]] - reached[:-1] <= GAP_ITEM))
            end[order[following]] = np.maximum(end[order[following]], at[order[following + 1]])
        order = np.argsort(pair * width + at)
        of, start, stop = pair[order], at[order], end[order]
        before = np.maximum.accumulate(of * 2 * width + stop)  # how far the pair's runs up to here reach
        reached = np.append(0, before[:-1]) - of * 2 * width
        common = np.bincount(of, np.maximum(0, stop - np.maximum(start, np.maximum(reached, 0))), len(pairs))
        likely = ((common > 0) & (common >= asked))[pair]
        pair, at, place, k = pair[likely], at[likely], place[likely], k[likely]
        for p, chain in best_chains(pair, at, place, k, 2 * self.size[pairs[:, 1]] + 200, asked):
            d, i = pairs[p].tolist()
            doc, item = texts[d], self.items[i]
            if any(doc[y : y + n] != item.text[x : x + n] for x, y, n in chain):  # two runs of the same hash: by the characters
                own = _common_runs(doc, item)
                chain = next((c for _, c in best_chains(np.zeros(len(own[0]), dtype=np.int64), *own, np.array([2 * len(item.text) + 200]), np.zeros(1))), None)
            if chain:
                yield d, i, covered_part(doc, item, chain)


def best_chains(pair: np.ndarray, at: np.ndarray, place: np.ndarray, size: np.ndarray, reach: np.ndarray, asked: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """For each pair the chain of its runs, in order in item and document, with most characters among those within ``reach`` characters of the
    document (pieces further apart than that are not close together), if it and all its gaps that could be filled make up what is ``asked``.

    All pairs side by side: those of much the same number of runs make one table."""
    order = np.lexsort((at, place, pair))
    pair, i, j, k = pair[order], at[order], place[order], size[order]
    counts = np.bincount(pair, minlength=len(asked)) if len(pair) else np.zeros(len(asked), dtype=np.int64)
    starts = np.cumsum(counts) - counts
    by_size = np.argsort(counts, kind="stable")
    by_size = by_size[counts[by_size] > 0]
    a = 0
    while a < len(by_size):
        b = max(a + 1, int(np.searchsorted(counts[by_size], counts[by_size[a]] * 1.25 + 2, side="right")))
        b = min(b, a + max(1, TABLE // int(counts[by_size[b - 1]])))
        rows = by_size[a:b]
        a = b
        n = int(counts[rows[-1]])
        index = np.minimum(starts[rows][:, None] + np.arange(n), len(i) - 1)
        ri, rj, rk = (x[index].astype(np.int64) for x in (i, j, k))
        ei, ej = ri + rk, rj + rk
        score, begin, back = rk.copy(), rj.copy(), np.full(ri.shape, -1)
        far, line = reach[rows][:, None], np.arange(len(rows))
        for t in range(1, n):
            over = np.maximum(np.maximum(ei[:, :t] - ri[:, t : t + 1], ej[:, :t] - rj[:, t : t + 1]), 0)
            fits = (ri[:, :t] < ri[:, t : t + 1]) & (over < rk[:, t : t + 1]) & (ej[:, t : t + 1] - begin[:, :t] <= far)
            gain = np.where(fits, score[:, :t] - over, 0)
            m = t - 1 - np.argmax(gain[:, ::-1], axis=1)  # the nearest of equal ones
            best = gain[line, m]
            some = best > 0
            score[:, t] += np.where(some, best, 0)
            begin[:, t] = np.where(some, begin[line, m], rj[:, t])
            back[:, t] = np.where(some, m, -1)
        now = np.where(np.arange(n) < counts[rows][:, None], score, -1).argmax(axis=1)
        steps, bound = [now], rk[line, now].astype(float)
        while (now >= 0).any():
            last = np.where(now >= 0, back[line, now], -1)
            gap_i, gap_j = ri[line, now] - ei[line, last], rj[line, now] - ej[line, last]
            filled = np.where((gap_j >= SLIPS * gap_i) | (gap_i <= 2), gap_i, np.where(gap_j >= 0.5 * gap_i, gap_j, 0))
            more = rk[line, last] + np.minimum(gap_i, 0) + np.where((gap_i > 0) & (gap_i <= GAP_ITEM) & (gap_j <= GAP_DOC), filled, 0)
            bound += np.where(last >= 0, more, 0)
            now = last
            steps.append(now)
        chains = np.array(steps[::-1]).T
        for r in np.flatnonzero(bound >= asked[rows]).tolist():
            c = chains[r][chains[r] >= 0]
            yield int(rows[r]), list(zip(ri[r, c].tolist(), rj[r, c].tolist(), rk[r, c].tolist()))


def candidate_pairs(texts: list[str], queries: np.ndarray, owner: np.ndarray, weighted: np.ndarray, cosine: float) -> np.ndarray:
    """(text number, item number) pairs of which some passages are near in the latent space."""
    features, starts, of = halves(texts)
    if not len(starts) or not len(queries):
        return np.zeros((0, 2), dtype=np.int64)
    p = _projected(features, starts, of, weighted)
    p /= np.maximum(1e-6, np.linalg.norm(p, axis=1, keepdims=True))
    near = np.zeros((len(texts), int(owner.max()) + 1), dtype=bool)
    for a in range(0, len(p), 512):
        r, c = np.nonzero(p[a : a + 512] @ queries.T >= cosine)
        near[of[a + r], owner[c]] = True
    return np.argwhere(near)


def _search(docs: DataFrame, items: list[Item], weighted: np.ndarray, key: str, text: str, cosine: float, covered: float) -> DataFrame:
    queries, owner = item_vectors(items, weighted) if items else (np.zeros((0, weighted.shape[1]), np.float32), np.zeros(0, np.int64))
    model = docs.sparkSession.sparkContext.broadcast((items, queries, owner, weighted, Seeds(items)))  # one block of items and a matrix of fixed size
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("item_id", T.LongType()), T.StructField("part", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_items, q, of, w, seeds = model.value
        for batch in batches:
            ids, out = batch[key].tolist(), []
            texts = batch[text].tolist()
            for a, b in _stretches(texts):
                part = texts[a:b]
                pairs = candidate_pairs(part, q, of, w, cosine)
                for d, i, found in seeds.coverages(part, pairs, covered) if len(pairs) else ():
                    if is_leaked(found, own_items[i], covered):
                        out.append((ids[a + d], own_items[i].item_id, found[0]))
            yield pd.DataFrame(out, columns=[key, "item_id", "part"])

    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(run, schema)

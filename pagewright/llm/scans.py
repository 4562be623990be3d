"""Repair of text from scanned pages: broken words, misread characters, running lines, page numbers.

*Misread characters.*  Every word (and every shape of a number, and every three characters around a
confusable Chinese character) is counted over all pages.  The anagram hash of a word is the sum of a hash of its
characters, so replacing x by y changes it by hash(y) - hash(x) wherever x stands.  A rare word is joined by equality
to the frequent words whose hash differs from its own by the difference of a confusable pair; the join's
few hits are verified by letters and ranked by frequency, and the best one is the correction.

*Running lines.*  Lines at the edges of pages are compared within their task by a skeleton in which confusable
characters are one; what stands at the edge of at least two pages and of a good part of the task's pages is a
running line, in however many tasks it stands.  Lines of a printed form are told from it by evidence of the task's own pages: a
form's title has the same label (what stands before a colon) below it on page after page, a form's closing line ends in a label,
and a second line belongs to a header only if the first one does.

*Page numbers* are lines that are nothing but a number in one of the usual frames.

*Broken words.*  The mark at a line's end is part of the word if the hyphenated form is more frequent
in the corpus than the joined one; the rest of the word is taken from the next body line, also across pages.

Counts, hashes and joins are Spark SQL; Python only takes pages apart, one Arrow batch at a time.
Null and empty texts have no lines of any kind.  Repeated pages are distinct rows of the input and give the same rows, once.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import keep
from .forms import IGNORED, canonical_lines, canonical_text

# What was read, and what may have been printed.  Digits are written 0 in the words that are counted.
CONFUSIONS_LATIN = {
    "0": "o l i s b g z e q", "!": "i l", "@": "a", "|": "l i", "1": "l i", "5": "s", "c": "e", "e": "c", "f": "t", "t": "f", "h": "b li", "b": "h 0", "l": "i 0", "i": "l 0", "I": "0", "o": "0 ö", "O": "0", "s": "0", "S": "0", "B": "0",
    "g": "q 0", "q": "g 0", "z": "0", "Z": "0", "rn": "m", "m": "rn", "cl": "d", "d": "cl", "vv": "w", "w": "vv", "ii": "u ü", "u": "ii ü v", "v": "u y", "y": "v", "n": "ri", "ri": "n", "li": "h", "ä": "a", "a": "ä", "ö": "o", "ü": "u", "ß": "b",
}
# Pairs of Chinese characters that are taken for each other; read, printed.
CONFUSIONS_HAN = """可司 夯务 友发 又文 祢称 仑仓 硝确 悦税 亏号 単单 颌额 人入 卒率 曰日 台合 勿物 己已 汀订 攴支 活话 淮准 啇商 末未 扯址 同司
司可 土士 士土 干千 千干 田由 由田 甲申 申甲 牛午 午牛 贝见 见贝 睛晴 睛清 拨拔 拔拨 折拆 拆折 未末 入人 日曰 已己 侍待 待侍 侯候 候侯 币市 准淮 话活 订汀 址扯""".split()

#: A correction is at least so many times as frequent as what it corrects, and there at least so often.
RATIO, LEAST = 12, 5
#: A running line is at the edge of at least this part of its task's pages, and of at least two of them.
EDGE_SHARE = 0.4
#: A form's title has a label below it on at least this part of its pages, and the different labels are at most this part of them.
LABELLED, LABELS = 0.5, 0.34

_HAN_READ = {p[0] for p in CONFUSIONS_HAN}
_HAN_ANY = re.compile("[" + "".join({c for p in CONFUSIONS_HAN for c in p}) + "]")
_DIGITS = str.maketrans("123456789", "000000000")
_EMAIL = re.compile(r"\S+@\S+\.\S+")
_TOKEN = re.compile(r"[!|@]?[^\W_](?:[\w!@|.,/\-'’]*[^\W_])?[!|]?")
_HAN = re.compile(r"[一-鿿]")
_HAN_RUN = re.compile(r"[一-鿿，。、；：]+")
_D = r"[\dlIOo]"
_PAGE_NUMBER = re.compile(
    rf"(?:\d{{1,3}}|[ivxlc]{{1,6}}|[IVXLC]{{1,6}}|[-–—·] ?{_D}{{1,4}} ?[-–—·]|[\[(<]{_D}{{1,4}}[\])>]|{_D}{{1,4}} ?/ ?{_D}{{1,4}}|(?:p|pp|pg|s|P|S)\. ?{_D}{{1,4}}|"
    rf"(?i:(?:p[a@]ge|pagc|seite|scite|blatt|folio|sheet)) ?{_D}{{1,4}}(?: ?(?:of|o[ft]|0f|von|/) ?{_D}{{1,4}})?|第 ?{_D}{{1,4}} ?[页頁](?: ?,? ?共 ?{_D}{{1,4}} ?[页頁])?|共 ?{_D}{{1,4}} ?[页頁])"
)
_LABEL = re.compile(r"([^:]{1,24}):")
_FIRST = re.compile(r"[\W_]*([^\W_][^\s]*)")
_MARKS = "-­¬‐‑−"
_MARK_ENDS = frozenset(_MARKS)
_CONJUNCTIONS = {"und", "oder", "bzw", "bis", "and", "or", "sowie"}
_SKELETON = {"0": "o", "O": "o", "Q": "o", "1": "i", "l": "i", "I": "i", "!": "i", "|": "i", "i": "i", "5": "s", "S": "s", "@": "a", "ä": "a", "ö": "o", "ü": "u", "c": "e", "t": "f", "T": "f", "F": "f", "h": "b li", "8": "b", "B": "b", "H": "b", "9": "g", "q": "g", "C": "e", "E": "e", "Z": "z", "2": "z"}
_SKELETON_HAN = {}
for _pair in CONFUSIONS_HAN:
    _SKELETON_HAN.setdefault(_pair[0], _SKELETON_HAN.get(_pair[1], min(_pair)))
    _SKELETON_HAN.setdefault(_pair[1], _SKELETON_HAN[_pair[0]])


_ONE = str.maketrans({**_SKELETON, **_SKELETON_HAN})
_DIGIT = re.compile("[1-9]")
_EDGE_NUMBER = re.compile(r"[\s|·\-–]*\s\d{1,3}$|^\d{1,3}[\s|·\-–]{1,3}(?=\D)")
#: Tokens, windows and lines whose results a worker remembers; most of a corpus is a small part of its different ones.
_REMEMBERED = 1 << 17


@functools.lru_cache(_REMEMBERED)
def skeleton(form: str) -> str:
    """A line in its consistent form with confusable characters made one, page numbers at its ends and blanks left out."""
    if form and (form[0].isdigit() or form[-1].isdigit()):
        form = _EDGE_NUMBER.sub("", form)
    out = "".join(form.translate(_ONE).lower().split())
    return out.replace("rn", "m").replace("vv", "w").replace("ei", "d").replace("ii", "u").replace("ri", "n")


@functools.lru_cache(_REMEMBERED)
def is_page_number(form: str) -> bool:
    return _PAGE_NUMBER.fullmatch(form) is not None


def token_key(token: str) -> str:
    """What a token is counted as: words in lower case with digits as 0; numbers by their shape."""
    if token.isalpha():
        return token.lower()
    shape = token.translate(_DIGITS)
    digits = shape.count("0")
    if not digits:
        return token.lower()
    letters = sum(map(str.isalpha, token))
    if letters > digits and not re.search(r"[/.,]", token) and not re.match(r"[A-Z]{2}-?\d", token):
        return shape.lower()
    return re.sub(r"^[A-Z]{2}(?=-?[0-9lIOoSsBg])", "AA", shape)


@functools.lru_cache(_REMEMBERED)
def _token_keys(piece: str) -> tuple[str, ...]:
    """Keys of what stands between two blanks."""
    word = piece.strip(".,;:()\"")
    if word.isalpha():  # most words; the same as the pattern finds
        return (word.lower(),) if len(word) > 1 else ()
    out = []
    for t in _TOKEN.findall(piece):
        if len(t) < 2 or t.isdigit():
            continue
        out.append(token_key(t))
        if "-" in t and t[0].isalpha() and t[-1].isalpha():  # a word with a mark of its own: its parts are words, and its first part takes a mark
            low = t.lower().split("-")
            out += [x for x in low if len(x) > 1]
            out.append(low[0] + "-")
    return tuple(out)


@functools.lru_cache(_REMEMBERED)
def _window_keys(window: str, at: int) -> tuple[str, ...]:
    """Keys of a confusable Chinese character at a place of its window: the three characters, and it with a Chinese neighbour."""
    window = _DIGIT.sub("0", window)
    out = [f"{window}2"] if at == 1 and len(window) == 3 else []
    if at and _HAN.match(window[0]):
        out.append(f"{window[:2]}2")
    if len(window) > at + 1 and _HAN.match(window[at + 1]):
        out.append(f"{window[at:at + 2]}1")
    return tuple(out)


def _grams(before: str, form: str, after: str) -> list[str]:
    """Keys of a line, each once: its words, and the threes around its confusable Chinese characters (over the line's ends)."""
    has_han = not form.isascii() and _HAN.search(form) is not None
    words = _HAN_RUN.sub(" ", form) if has_han else form
    if "@" in words:
        words = _EMAIL.sub(" ", words)
    keys = map(_token_keys, words.split())
    if has_han and (found := [m.start() for m in _HAN_ANY.finditer(form)]):
        text = before[-2:] + form + after[:2] if _HAN.search(before[-1:] + after[:1]) else form
        shift = len(before[-2:]) if len(text) > len(form) else 0
        keys = itertools.chain(keys, [_window_keys(text[max(0, i + shift - 1) : i + shift + 2], 1 if i + shift else 0) for i in found])
    return list(dict.fromkeys(itertools.chain.from_iterable(keys)))


def _page(text: str) -> tuple[list[str], list[bool], list[list[str]]]:
    """(form, ends with a mark, keys) of each line of a page; a word that is broken over two lines gives no keys."""
    raw = text.split("\n")
    forms = canonical_lines(text)
    soft = "\u00ad" in text
    marks = [f[-1:] in _MARK_ENDS for f in forms]
    for i in range(len(forms)) if soft else [i for i, x in enumerate(marks) if x]:
        end = "".join(c for c in raw[i][-12:] if c == "\u00ad" or c not in IGNORED).rstrip()
        marks[i] = bool(forms[i]) and len(end) > 1 and end[-1] in _MARKS and end[-2].isalpha()
    out = []
    for i, f in enumerate(forms):
        keys = _grams(forms[i - 1] if i else "", f, forms[i + 1] if i + 1 < len(forms) else "") if f else []
        if keys and (marks[i] or i and marks[i - 1]):
            last = _TOKEN.findall(f.rstrip(_MARKS))[-1:] if marks[i] else []
            first = _TOKEN.findall(f)[:1] if i and marks[i - 1] else []
            broken = {token_key(x) for x in (*last, *first)}
            keys = [k for k in keys if k not in broken]
        out.append(keys)
    return forms, marks, out


_NEXTS = T.ArrayType(T.StructType([T.StructField("no", T.IntegerType()), T.StructField("first", T.StringType())]))
_KEYS = T.ArrayType(T.StructType([T.StructField("no", T.IntegerType()), T.StructField("gram", T.StringType())]))
_COUNTS = T.ArrayType(T.StructType([T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())]))
_LINES = T.StructType(
    [T.StructField("src", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("task_id", T.StringType()), T.StructField("page_index", T.IntegerType()), T.StructField("line_no", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("is_number", T.BooleanType()), T.StructField("skeleton", T.StringType()), T.StructField("outer", T.StringType()), T.StructField("label", T.StringType()), T.StructField("left", T.StringType()), T.StructField("nexts", _NEXTS), T.StructField("keys", _KEYS), T.StructField("counts", _COUNTS)]
)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (line 0) for each page with its ``keys`` that may be misread, one for each line at its edges, each page number and each line that ends
    with a mark, and one (without a page) for each batch with the ``counts`` of its keys.

    ``place``: how near to the page's edge (0 first or last, page numbers not counted), -1 inside; ``outer``: the skeleton of the page's first or
    last line, for the second line from there; ``label``: the label of the line below a line at the page's top, ":" for a line that ends in one; ``left``:
    the word before the mark at the end; ``nexts``: the first words of the lines that follow it (of line 0: of the page's first lines), up to the first line
    that is neither at an edge nor a page number."""
    text_type = pa.string()
    for batch in batches:
        rows: list[tuple] = []  # page, line, place, page number, skeleton, outer, label, left, nexts
        every, key_line, key_text, key_ends = [], [], [], []
        for n, text in enumerate(batch.column(4).to_pylist()):
            forms, marks, keys = _page(text)
            page = [i for i, f in enumerate(forms) if f]
            if not page:
                continue
            numbers = {i for i in page if len(forms[i]) < 24 and is_page_number(forms[i])}
            body = [i for i in page if i not in numbers] if numbers else page
            inner = set(body[2:-2])

            def follow(k: int) -> list[dict]:
                some = []
                for i in page[k:]:
                    m = _FIRST.match(forms[i])
                    some.append({"no": i + 1, "first": m[1] if m else ""})
                    if i in inner:
                        break
                return some

            for i in body:
                if own := keys[i]:
                    every += own
                    if not forms[i].isascii():
                        own = list(filter(_may_be_misread, own))
                    key_text += own
                    key_line += [i + 1] * len(own)
            rows.append((n, 0, -1, False, None, None, None, None, follow(0)))
            key_ends += [len(key_text)]
            rank = {i: k for k, i in enumerate(body) if k < 2 or k > len(body) - 3}
            for k, i in enumerate(page):
                at = rank.get(i)
                if at is None and not marks[i] and i not in numbers:
                    continue
                near = -1 if at is None else min(at, len(body) - 1 - at)
                form = forms[i]
                outer = label = left = nexts = None
                if near >= 0:
                    top, second = at * 2 < len(body), near == 1 and len(body) > 2
                    if second:
                        outer = skeleton(forms[body[0 if top else -1]])
                    below = _LABEL.match(forms[body[near + 1]]) if (near == 0 or second) and top and len(body) > near + 1 else None
                    label = ":" if form.endswith(":") else skeleton(below[1]) if below else None
                if marks[i]:
                    tokens = re.findall(r"[^\W\d_][\w'’\-]*", form.rstrip(_MARKS + " "))
                    left, nexts = tokens[-1].lower() if tokens else None, follow(k + 1)
                rows.append((n, i + 1, near, i in numbers, skeleton(form) if near >= 0 else None, outer, label, left, nexts))
                key_ends.append(len(key_text))
        rows.append((None, None, -1, False, None, None, None, None, None))
        key_ends.append(len(key_text))
        counted = Counter(every)
        lists = lambda ends, names, *columns: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(columns), names))
        of, *others = zip(*rows)
        kinds = [pa.int32(), pa.int32(), pa.bool_(), text_type, text_type, text_type, text_type, pa.list_(pa.struct([("no", pa.int32()), ("first", text_type)]))]
        same = [batch.column(c).take(pa.array(of, pa.int32())) for c in range(4)]
        made = [pa.array(x, kind) for x, kind in zip(others, kinds)]
        keys_of = lists([0, *key_ends], ["no", "gram"], pa.array(key_line, pa.int32()), pa.array(key_text, text_type))
        counts = lists([0] * len(rows) + [len(counted)], ["gram", "n"], pa.array(list(counted), text_type), pa.array(list(counted.values()), pa.int64()))
        yield pa.RecordBatch.from_arrays([*same, *made, keys_of, counts], names=_LINES.names)


@functools.lru_cache(_REMEMBERED)
def _may_be_misread(key: str) -> bool:
    """Whether a key around a Chinese character has one that stands for another; other keys may always be."""
    if len(key) < 3 or key[-1] not in "12":
        return True
    at = int(key[-1]) - 1
    return key[at] in _HAN_READ or not _HAN_ANY.match(key[at])


def pages_of(pages: DataFrame, layers: DataFrame) -> DataFrame:
    """The texts of both kinds as (src, page_id, task_id, page_index, text); null and empty texts left out."""
    one = lambda df, src: df.where("page_id is not null and text is not null and text <> ''").select(F.lit(src).alias("src"), F.col("page_id").cast("long").alias("page_id"), "task_id", F.col("page_index").cast("int").alias("page_index"), "text")
    return one(pages, "ocr_pages").unionByName(one(layers, "text_layers"))


def _confusions() -> list[tuple[str, str]]:
    latin = [(x, y) for x, ys in CONFUSIONS_LATIN.items() for y in ys.split()]
    return latin + [(p[0], p[1]) for p in dict.fromkeys(CONFUSIONS_HAN)]


def anagram_hash(gram: Column | str) -> Column:
    """The sum over a string's characters of a hash of each."""
    return F.aggregate(F.transform(F.split(gram, ""), lambda c: F.xxhash64(c) % F.lit(1 << 40)), F.lit(0).cast("long"), lambda a, x: a + x)


def corrections(counts: DataFrame, ratio: int = RATIO, least: int = LEAST) -> DataFrame:
    """(gram, better, x, y) for counted grams (gram, n): the best correction of each rare word that a confusable pair turns into a frequent one."""
    spark = counts.sparkSession
    pairs = spark.createDataFrame(_confusions(), "x string, y string").withColumn("delta", anagram_hash("y") - anagram_hash("x"))
    pairs = pairs.withColumn("han", F.col("x").rlike("[一-鿿]"))
    # a word that holds a sign or a digit among its letters is no word: a quarter of the ratio is enough there
    hashed = counts.withColumn("hash", anagram_hash("gram")).withColumn("han", F.col("gram").rlike("[一-鿿]"))
    # the pairs are a fixed list of a few hundred rows: this join explodes each word by the pairs it holds
    rare = hashed.join(F.broadcast(pairs), (hashed["han"] == pairs["han"]) & F.expr("instr(gram, x) > 0")).select("gram", "n", "x", "y", (F.col("hash") + F.col("delta")).alias("hash"))
    frequent = hashed.where(F.col("n") >= least).select(F.col("gram").alias("better"), F.col("n").alias("n_better"), "hash")
    hits = rare.join(frequent, "hash").where((F.col("n_better") >= 0.25 * ratio * F.col("n")) & (F.length("gram") - F.length("x") + F.length("y") == F.length("better")))
    # short words are often words themselves: they have to be rarer; a gram's last character says which of its characters is meant
    size = F.length("gram")
    hits = hits.where((F.col("gram").rlike("[一-鿿]") & (F.col("n_better") >= ratio * F.col("n"))) | (~F.col("gram").rlike("[一-鿿]") & (F.col("n_better") >= ratio * F.col("n") * F.when(F.col("gram").rlike(r"\p{L}") & F.col("gram").rlike("[0!@|]"), 0.25).when(size <= 3, 8).when(size == 4, 2).otherwise(1))))
    hits = hits.where(~F.col("gram").rlike("[一-鿿]") | F.expr("substring(gram, try_cast(right(gram, 1) as int), 1) = x and substring(better, try_cast(right(gram, 1) as int), 1) = y"))
    verified = hits.where(F.expr("exists(sequence(1, length(gram) - length(x) + 1), p -> concat(substring(gram, 1, p - 1), y, substring(gram, p + length(x))) = better and substring(gram, p, length(x)) = x)"))
    best = verified.groupBy("gram").agg(F.max_by(F.struct("better", "x", "y"), F.struct("n_better", "better")).alias("b"))
    return best.select("gram", "b.better", "b.x", "b.y")


def affected_lines(pages: DataFrame, layers: DataFrame) -> DataFrame:
    """(src, page_id, line_no, kind), one row for each affected line; see the module's description.

    Pages without a task belong to none and have no running lines."""
    return _parts(pages_of(pages, layers))[0]


def _parts(texts: DataFrame, with_fixes: bool = False) -> tuple[DataFrame, DataFrame]:
    """(affected lines, corrections of the lines' grams)."""
    lines = keep(texts.mapInArrow(_lines, _LINES))
    counts = keep(lines.where("src is null").select(F.explode("counts").alias("c")).groupBy("c.gram").agg(F.sum("c.n").alias("n")))
    lines = lines.where("src is not null").drop("counts")
    fixes = keep(corrections(counts))
    key = ["src", "page_id", "line_no"]
    kind = lambda df, k: df.select(*key, F.lit(k).alias("kind"))

    # running lines
    n_pages = lines.where("line_no = 0 and task_id is not null").groupBy("task_id").agg(F.count_distinct("page_index").alias("n_pages"))
    # skeletons of a task are compared by a hash of 64 bits, so only numbers are exchanged and sorted
    of = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64("task_id", c))
    edges = lines.where("place >= 0 and task_id is not null").select(*key, "task_id", "page_index", of("skeleton").alias("line"), of("outer").alias("outer"), of("label").alias("label"), F.col("skeleton").rlike(r"[\p{L}\p{N}]").alias("speaks"))
    held = edges.where("speaks").select("line", "task_id", "page_index", "outer", "label")
    # most skeletons stand on one page of their task; only the others are looked at more closely
    again = held.groupBy("line").agg(F.min("page_index").alias("low"), F.max("page_index").alias("high")).where("low < high").select("line")
    by_task = held.join(again, "line", "left_semi").groupBy("line").agg(F.first("task_id").alias("task_id"), F.count_distinct("page_index").alias("n"), F.count("*").alias("rows"), F.count("outer").alias("second"), F.mode("outer").alias("outer"), F.count("label").alias("labelled"), F.count_distinct("label").alias("labels"))
    printed_form = (F.col("labelled") >= LABELLED * F.col("rows")) & (F.col("labels") <= F.greatest(F.lit(1.0), LABELS * F.col("rows")))
    enough = keep(by_task.where(~printed_form).join(n_pages, "task_id").where(F.col("n") >= EDGE_SHARE * F.col("n_pages")).select("line", "outer", (F.col("second") * 2 > F.col("rows")).alias("is_second")))
    firsts = enough.where("not is_second").select("line")
    seconds = enough.where("is_second").join(firsts.select(F.col("line").alias("outer")), "outer", "left_semi").select("line")
    running = edges.join(firsts.unionByName(seconds), "line", "left_semi")
    # a line is no page number by place, so the two kinds never meet
    taken = keep(kind(running, "running_line").unionByName(kind(lines.where("is_number"), "page_number")))

    # the rest of a broken word: the first word of the next body line of the page or of the next page
    by_page = taken.groupBy("src", "page_id").agg(F.collect_set("line_no").alias("skipped"))
    ahead = lines.where("nexts is not null").select(*key, "task_id", "page_index", "left", "nexts").join(by_page, ["src", "page_id"], "left")
    ahead = ahead.where("line_no = 0 or left is not null").where("skipped is null or not array_contains(skipped, line_no)")
    ahead = ahead.select(*key, "task_id", "page_index", "left", F.expr("get(filter(nexts, x -> skipped is null or not array_contains(skipped, x.no)), 0).first").alias("next"))
    heads = ahead.where("line_no = 0").groupBy("src", "task_id", (F.col("page_index") - 1).alias("page_index")).agg(F.min("next").alias("head"))
    ends = ahead.where("line_no > 0").join(heads, ["src", "task_id", "page_index"], "left").withColumn("rest", F.coalesce("next", "head"))
    right = F.coalesce(F.lower(F.regexp_extract("rest", r"^([\p{L}'’]+(?:-[\p{L}]+)*)", 1)), F.lit(""))
    ends = ends.select(*key, "left", "rest", right.alias("right"))
    # how often the word is written as one, with its mark, its last part alone, and its first part before a mark: looked up at once
    asked = {
        "joined": F.concat("left", "right"),
        "hyphened": F.concat("left", F.lit("-"), "right"),
        "part": F.concat(F.regexp_extract("left", r"([^-]*)$", 1), F.regexp_extract("right", r"^([^-]*)", 1)),
        "before": F.concat("left", F.lit("-")),
    }
    questions = ends.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("what"), c.alias("gram")) for n, c in asked.items()])).alias("q")).select("*", "q.what", "q.gram").drop("q")
    answered = questions.join(counts, "gram", "left")
    weighed = answered.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("left", "rest", "right")], *[F.coalesce(F.max(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(f"n_{n}") for n in asked])
    starts_low = F.col("rest").rlike(r"^\p{Ll}")
    broken = weighed.where(
        ((F.col("right") == "") & F.col("rest").isNull() & F.length("left").between(2, 30) & (F.col("n_before") < LEAST))
        | ((F.col("right") != "") & (~F.col("right").isin(*_CONJUNCTIONS) | (F.col("n_joined") > 0)) & ~F.col("rest").rlike("[@]") & (starts_low & (F.col("n_joined") + F.when(F.col("left").contains("-"), F.col("n_part")).otherwise(0) >= F.col("n_hyphened"))))
    )

    wrong = lines.where("size(keys) > 0").select("src", "page_id", F.explode("keys").alias("k")).select("src", "page_id", F.col("k.no").alias("line_no"), "k.gram").join(fixes, "gram").select(*key, "gram", "better", "x", "y")
    if with_fixes:
        wrong = keep(wrong)
    # a line's kind is the first of its kinds in this order
    order = {"running_line": 0, "page_number": 0, "broken_word": 1, "misread": 2}
    every = taken.unionByName(kind(broken, "broken_word")).unionByName(kind(wrong, "misread"))
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("kind")]
    return every.groupBy(*key).agg(F.min(F.struct(rank.alias("rank"), "kind"))["kind"].alias("kind")), wrong


def _mended(form: str, fixes: list) -> str:
    for f in fixes or []:
        for m in re.finditer(re.escape(f["x"]), form):
            new = f["y"]
            if new == "0":
                new = {"l": "1", "i": "1", "I": "1", "!": "1", "s": "5", "S": "5", "B": "8", "b": "6", "g": "9", "q": "9", "z": "2", "Z": "2"}.get(f["x"], "0")
            trial = form[: m.start()] + new + form[m.end() :]
            if f["better"] in {*_grams("", trial, ""), *(x.lower() for x in _TOKEN.findall(trial))} and f["gram"] in _grams("", form, ""):
                form = trial
                break
    return form


_CLEAN = T.StructType([T.StructField("src", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("paragraphs", T.StringType())])


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for src, page_id, text, kinds, fixes in zip(batch["src"], batch["page_id"], batch["text"], batch["kinds"], batch["fixes"]):
            kind = {int(k["line_no"]): k["kind"] for k in (kinds if kinds is not None else [])}
            mend: dict[int, list] = {}
            for f in fixes if fixes is not None else []:
                mend.setdefault(int(f["line_no"]), []).append(f)
            paragraphs, now, glue = [], "", False
            for i, raw in enumerate(text.split("\n"), 1):
                if kind.get(i) in ("running_line", "page_number"):
                    continue
                form = canonical_text(raw)
                if not form:
                    if now and not glue:
                        paragraphs.append(now)
                        now = ""
                    continue
                form = _mended(form, mend.get(i))
                han = bool(now) and unicodedata.east_asian_width(now[-1]) in "WF" and unicodedata.east_asian_width(form[0]) in "WF"
                keeps_mark = now.endswith("-") and not glue
                now = now + form if glue or han or keeps_mark else f"{now} {form}" if now else form
                glue = kind.get(i) == "broken_word"
                if glue:
                    now = now.rstrip(_MARKS + " ")
            if now:
                paragraphs.append(now)
            rows.append((src, page_id, "\n\n".join(paragraphs)))
        yield pd.DataFrame(rows, columns=_CLEAN.names)


def clean_paragraphs(pages: DataFrame, layers: DataFrame) -> DataFrame:
    """(src, page_id, paragraphs) of every page with text: body text only, words whole, corrections applied, one paragraph a block."""
    texts = pages_of(pages, layers)
    found, wrong = _parts(texts, with_fixes=True)
    kinds = found.groupBy("src", "page_id").agg(F.collect_list(F.struct("line_no", "kind")).alias("kinds"))
    fixes = wrong.groupBy("src", "page_id").agg(F.collect_list(F.struct("line_no", "gram", "better", "x", "y")).alias("fixes"))
    return texts.join(kinds, ["src", "page_id"], "left").join(fixes, ["src", "page_id"], "left").select("src", "page_id", "text", "kinds", "fixes").mapInPandas(_clean, _CLEAN)


_BLOCKS = T.StructType([T.StructField("block_id", T.LongType()), T.StructField("page_id", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("repaired", T.StringType())])


def _block_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for block_id, page_id, line_no, text, kind, fixes in zip(*(batch[c] for c in ("block_id", "page_id", "line_no", "text", "kind", "fixes"))):
            form = None
            if isinstance(text, str) and kind not in ("running_line", "page_number"):
                form = _mended(canonical_text(text), list(fixes) if fixes is not None else [])
                if kind == "broken_word":
                    form = form.rstrip(_MARKS + " ")
            rows.append((block_id, page_id, line_no, kind, form))
        yield pd.DataFrame(rows, columns=_BLOCKS.names).astype({"block_id": "Int64", "page_id": "Int64", "line_no": "Int32"})


def clean_blocks(blocks: DataFrame, pages: DataFrame, layers: DataFrame) -> DataFrame:
    """(block_id, page_id, line_no, kind, repaired) of every distinct block: the kind of its page line and its text with that line's corrections.

    A block is a line of its page's text, so counts come from the pages and no line is counted twice.  ``repaired`` is null for running lines,
    page numbers and null texts; after a ``broken_word`` the mark is gone and the next body line goes on with the word."""
    found, wrong = _parts(pages_of(pages, layers), with_fixes=True)
    key = ["page_id", "line_no"]
    kinds = found.where("src = 'ocr_pages'").select(*key, "kind")
    fixes = wrong.where("src = 'ocr_pages'").groupBy(*key).agg(F.collect_list(F.struct("gram", "better", "x", "y")).alias("fixes"))
    own = blocks.select(F.col("block_id").cast("long").alias("block_id"), F.col("page_id").cast("long").alias("page_id"), F.col("line_no").cast("int").alias("line_no"), "text").distinct()
    return own.join(kinds, key, "left").join(fixes, key, "left").select("block_id", *key, "text", "kind", "fixes").mapInPandas(_block_texts, _BLOCKS)

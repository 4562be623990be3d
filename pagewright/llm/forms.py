"""One consistent form for texts that look the same.

``canonical_text`` works on a Python string, ``canonical`` on a Spark column.  The
compatibility decomposition is taken first, look-alike letters are mapped to one
alphabet on the decomposed text (so that an accent on a foreign letter meets the same
accent on the native one), and the result is composed.  Default-ignorable characters
vanish, every run of blanks becomes one space, blanks at the ends are dropped.

Defined results: null stays null, the empty text and texts of blanks or invisible
characters give the empty text.  ``fold=True`` adds full case folding; the default
keeps case, because texts that differ in case look different.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters (Cyrillic, Greek, Armenian, others) and the letters they show.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ү": "y", "ѵ": "v", "Ѵ": "V",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j", "υ": "u", "κ": "k",
    "օ": "o", "Օ": "O", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "Տ": "S", "Լ": "L", "զ": "q",
    "ɡ": "g", "ɑ": "a", "ı": "i", "ɩ": "i", "ʋ": "v", "Ꭺ": "A", "Ꭼ": "E", "Ꮃ": "W", "Ꮋ": "H", "Ꮇ": "M",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮓ": "Z", "Ꮯ": "C", "Ꮲ": "P", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮩ": "V",
}
# Hyphens and minus signs, all shown as one short stroke.
STROKES = "‐‑‒−˗➖﹣－⁃"
# Blanks that str.split does not take as such.
BLANKS = "⠀ㅤﾠᅟᅠ"


def _ignorable() -> frozenset[str]:
    """The characters without width: format characters and the default-ignorable ranges."""
    spans = [(0x34F, 0x34F), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF)]
    chars = [c for c in range(0x30000) if unicodedata.category(chr(c)) == "Cf" or unicodedata.category(chr(c)) == "Cc" and not chr(c).isspace()]
    return frozenset(map(chr, [*chars, *(c for a, b in spans for c in range(a, b + 1))]))


IGNORED = _ignorable()
#: Characters outside the ranges in which texts are written and nothing is without width; only these are looked up.
_ODD = re.compile("[^ -~\u3000-\ufdff\xa1-\xac\xae-\u034e\u2010-\u2027\u2030-\u205e\uff00-\uffef\n]")


def _seen(m: re.Match) -> str:
    return "" if m[0] in IGNORED else m[0]


def shown(text: str) -> str:
    """A text without its characters that have no width."""
    return _ODD.sub(_seen, text)
_MAP = {**LOOKALIKES, **dict.fromkeys(STROKES, "-"), **dict.fromkeys(BLANKS, " ")}
_MAPPED = re.compile("[" + "".join(map(re.escape, _MAP)) + "]")


def canonical_text(text: str | None, fold: bool = False) -> str | None:
    """The consistent form of one text; see the module's description."""
    if text is None:
        return None
    if text.isascii():
        text = " ".join(text.split())
        if not text.isprintable():
            text = " ".join(shown(text).split())
        return text.lower() if fold else text
    kept = shown(text)
    text = unicodedata.normalize("NFKD", kept)
    if text != kept:
        text = shown(text)
    text = unicodedata.normalize("NFC", _MAPPED.sub(lambda m: _MAP[m[0]], text))
    text = " ".join(text.split())
    return unicodedata.normalize("NFC", text.casefold()) if fold else text


def canonical_lines(text: str) -> list[str]:
    """The consistent form of each line of a text, in order; the number of lines is kept."""
    return [x.strip(" ") for x in canonical_text(text.replace("\n", "\ue000")).split("\ue000")]


def canonical_with_map(text: str) -> tuple[str, list[int], list[int]]:
    """The consistent form, and for each of its characters the start and the end of the part of the source that it comes from;
    the one space of a run of blanks comes from the whole run."""
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    i, n = 0, len(text)
    while i < n:
        j = k = i + 1
        while k < n and (unicodedata.combining(text[k]) or "\u1161" <= text[k] <= "\u11ff" or text[k] in IGNORED):
            k += 1
            if text[k - 1] not in IGNORED:  # marks, and letters that join the one before, with invisible characters between
                j = k
        for c in text[i] if text[i].isascii() and text[i].isprintable() and j == i + 1 else canonical_text(f"\ue000{text[i:j]}\ue000")[1:-1]:
            if c == " " and (not out or out[-1] == " "):
                if out:
                    end[-1] = j
                continue
            out.append(c)
            start.append(i)
            end.append(j)
        i = j
    if out and out[-1] == " ":
        out.pop(), start.pop(), end.pop()
    return "".join(out), start, end


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(texts)
    formed = pd.Series([canonical_text(x) for x in distinct] + [None], dtype=object)
    return formed.iloc[codes].reset_index(drop=True)


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(texts)
    formed = pd.Series([canonical_text(x, fold=True) for x in distinct] + [None], dtype=object)
    return formed.iloc[codes].reset_index(drop=True)


def canonical(text: Column | str, fold: bool = False) -> Column:
    """The consistent form of a text column, computed once for each distinct value of a batch."""
    return (_folded if fold else _canonical)(F.col(text) if isinstance(text, str) else text)


def same_looking_blocks(blocks: DataFrame, layers: DataFrame) -> DataFrame:
    """``block_id`` of the blocks that look like a line of their page's text layer while no line of it has exactly
    the same characters; one row each.

    Exactly equal lines are removed with an anti join before any text reaches Python; the rest is compared by page and
    consistent form.  Null and blank texts never match.  Both joins use (page_id, text), so a page that holds a large
    part of the blocks is spread by its texts, and repeated layer lines are reduced to distinct ones before the shuffle.
    """
    lines = layers.where(F.col("page_id").isNotNull()).select("page_id", F.explode(F.split("text", "\n", -1)).alias("line")).distinct()
    own = blocks.select("block_id", "page_id", F.col("text").alias("line")).where("block_id is not null and page_id is not null and line is not null")
    other = own.join(lines, ["page_id", "line"], "left_anti")
    # most look-alikes are in lines that hold something besides plain printable ASCII, on one of the two sides
    keys = lines.select("page_id", canonical("line").alias("key")).where("key <> ''").distinct()
    return other.select("block_id", "page_id", canonical("line").alias("key")).where("key <> ''").join(keys, ["page_id", "key"], "left_semi").select("block_id").distinct()


def consistent_lines(blocks: DataFrame, layers: DataFrame) -> DataFrame:
    """(src, block_id, page_id, line_no, form, folded) of every block and of every line of every text layer (without a block_id); a null
    layer gives one row without a line."""
    own = blocks.select(F.lit("ocr_blocks").alias("src"), "block_id", "page_id", F.col("line_no").cast("int").alias("line_no"), "text")
    lines = layers.select("page_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("at", "text"))
    lines = lines.select(F.lit("text_layers").alias("src"), F.lit(None).cast(blocks.schema["block_id"].dataType).alias("block_id"), "page_id", (F.col("at") + 1).alias("line_no"), "text")
    return own.unionByName(lines).select("src", "block_id", "page_id", "line_no", canonical("text").alias("form"), canonical("text", fold=True).alias("folded"))

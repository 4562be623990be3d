"""Linking of the spellings of one person or company.

Every distinct spelling is taken apart by rules into parts (given name and surname; brand,
field, trade and town of a company), whatever their order, with nicknames, abbreviations and legal forms
brought to one word.  From the parts every canonical rewriting of the spelling is generated as
a *form*: parts left out, initials in place of given names, one character lost.  Forms are exploded and
joined by equality; a form's weight is its rarity: it links a shortened spelling only to the one
full identity that the form can stand for, and nothing if it can stand for several.  A form with a
lost character links two spellings only where they are one slip (a character lost, added, changed, or
two swapped) apart.  The classes are the connected components of the links.

Nulls and blank strings are no names.  Repeated rows count once.  Equal strings need no link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .forms import canonical_text

# Short forms of given names.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "andy": "andrew", "tony": "anthony", "ben": "benjamin", "benny": "benjamin", "charlie": "charles", "chuck": "charles", "chris": "christopher",
    "kit": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "debbie": "deborah", "deb": "deborah", "dot": "dorothy", "dolly": "dorothy", "ed": "edward", "eddie": "edward", "ned": "edward",
    "nell": "eleanor", "ellie": "eleanor", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "fred": "frederick", "freddy": "frederick", "greg": "gregory", "harry": "henry", "hal": "henry",
    "jim": "james", "jimmy": "james", "jenny": "jennifer", "jen": "jennifer", "jack": "john", "joe": "joseph", "josie": "josephine", "jo": "josephine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine",
    "len": "leonard", "lenny": "leonard", "leo": "leonard", "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "madge": "margaret", "tilly": "matilda", "mattie": "matilda", "mike": "michael", "mick": "michael", "nick": "nicholas",
    "pat": "patricia", "patty": "patricia", "trish": "patricia", "becky": "rebecca", "becca": "rebecca", "rick": "richard", "dick": "richard", "bob": "robert", "rob": "robert", "bobby": "robert", "sam": "samuel", "sammy": "samuel", "steve": "stephen",
    "sandy": "alexander", "sue": "susanna", "susie": "susanna", "ted": "theodore", "theo": "theodore", "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "vic": "victoria", "tori": "victoria", "bill": "william", "will": "william", "billy": "william", "liam": "william",
}
#: Given names besides those that the short forms stand for.
OTHER_GIVEN = set("alice anna catherine charlotte emily emma helen jane laura linda martha mary sarah sophia susan george paul peter anneliese björn dörte günther heike jürgen käthe lothar rüdiger sören ute volker hans klaus uwe ingrid sabine petra monika werner wolfgang".split())
_GIVEN = OTHER_GIVEN | set(NICKNAMES) | set(NICKNAMES.values())
# Words for the field and the trade of a company.
FIELDS_EN = "alpine civil coastal general harbour industrial marine medical modern optical organic precision rural technical thermal urban northern southern eastern western united national global royal central".split()
TRADES_EN = "ceramics fasteners foods instruments logistics packaging printing textiles supplies tools plastics metals chemicals electronics furniture services trading transport machinery".split()
FIELDS_ZH = "新型 智能 环保 精密 工业 农业 医用 电子 建筑 汽车 绿色 海洋 冷链 纺织 食品 化工 现代 国际 数码 生物 光学 机械 航空".split()
TRADES_ZH = "仪器 印刷 包装 陶瓷 五金 设备 物流 材料 科技 贸易 制造 家具 服装 电器 塑料".split()
LEGAL_EN = re.compile(r"\b(?:co\.?,? ?ltd|ltd|limited|inc|incorporated|gmbh|company|co|corp|corporation|llc|plc|ag|kg|& co)\b\.?", re.I)
_LEGAL_ZH = re.compile(r"(?:股份|责任|有限|集团|公司|公同|公可|司)+$")
TOWN_ENDS_EN = ("mere", "combe", "hurst", "thorpe", "wick", "stead", "holt", "garth", "ford", "bury", "ham", "ton", "ley", "worth", "ville")
TOWN_ENDS_ZH = "原川泽渡湾岭陵浦州江城山阳港口"
_PART_MIN = 3


def one_slip(a: str, b: str) -> bool:
    """At most one character lost, added or changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (len(a) > i + 1 and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def _known(word: str, words: list[str]) -> str | None:
    """The listed word that this one is, abbreviates, or is one slip away from; only if there is just one."""
    word = word.rstrip(".")
    if word in words:
        return word
    if len(word) < _PART_MIN:
        return None
    begun = [w for w in words if w.startswith(word)]
    if len(begun) == 1:
        return begun[0]
    if len(word) >= 4:
        near = [w for w in words if one_slip(word, w)]
        if len(near) == 1:
            return near[0]
    return None


def parse(name: str) -> dict[str, str]:
    """The parts of a spelling: kind 'person' with given, middle, surname, or kind 'company' with brand, field, trade, town."""
    text = canonical_text(name, fold=True)
    if any("一" <= c <= "鿿" for c in text):
        return _parse_chinese(text)
    return _parse_latin(text, canonical_text(name))


def _parse_latin(text: str, cased: str) -> dict[str, str]:
    legal = LEGAL_EN.search(text) is not None
    words = re.findall(r"[^\W\d_][\w'.]*", text)
    if not legal and 2 <= len(words) <= 4:
        plain = [w.strip(".") for w in words]
        given = [i for i, w in enumerate(plain) if w in _GIVEN]
        if not given and not any(len(w) <= 2 for w in plain):  # a slip in the given name
            near = [(i, v[0]) for i, w in enumerate(plain) if len(w) >= 5 and len(v := [g for g in _GIVEN if abs(len(g) - len(w)) < 2 and one_slip(w, g)]) == 1]
            if len(near) == 1:
                plain[near[0][0]] = near[0][1]
                given = [near[0][0]]
        field_like = any(_known(w, FIELDS_EN) == w.strip(".") or _known(w, TRADES_EN) == w.strip(".") for w in words)
        if not field_like:
            if given:
                g = given[0]
                rest = [w for i, w in enumerate(plain) if i != g]
                middle = "".join(w for w in rest if len(w) == 1)
                surname = " ".join(w for w in rest if len(w) > 1)
                if surname:
                    return {"kind": "person", "given": NICKNAMES.get(plain[g], plain[g]), "middle": middle, "surname": surname}
            initials = [w for w, c in zip(plain, re.findall(r"[^\W\d_][\w'.]*", cased)) if len(w) <= 2 and (c.strip(".").isupper())]
            rest = [w for w in plain if w not in initials]
            if initials and len(rest) == 1:
                letters = "".join(initials)
                return {"kind": "person", "initial": letters[0], "middle": letters[1:], "surname": rest[0]}
    core = LEGAL_EN.sub(" ", text)
    parts = {"kind": "company", "brand": "", "field": "", "trade": "", "town": ""}
    of = re.search(r"\bof (\w+)", core)
    unknown: list[tuple[int, str]] = []
    for m in re.finditer(r"[^\W\d_][\w'.]*", core):
        w = m[0].strip(".'")
        if w in ("of", "the", "and") and not (w == "the" and m.start()):
            continue
        field, trade = _known(w, FIELDS_EN), _known(w, TRADES_EN)
        if field and not parts["field"] and (field == w or not trade):
            parts["field"] = field
        elif trade and not parts["trade"]:
            parts["trade"] = trade
        elif w:
            unknown.append((m.start(), w))
    if of:
        parts["town"] = of[1]
        unknown = [u for u in unknown if u[1] != of[1]]
    elif len(unknown) > 1:
        ends = [u for u in unknown if u[1].endswith(TOWN_ENDS_EN)]
        town = ends[-1] if ends else unknown[-1]
        if " - " in core and not ends:
            town = unknown[0]
        parts["town"] = town[1]
        unknown = [u for u in unknown if u != town]
    parts["brand"] = " ".join(u[1] for u in unknown)
    return parts


def _parse_chinese(text: str) -> dict[str, str]:
    parts = {"kind": "company", "brand": "", "field": "", "trade": "", "town": ""}
    text = re.sub(r"[\s。.,，、·]", "", text)
    inside = re.search(r"\(([^()]+)\)", text)
    if inside:
        parts["town"] = inside[1].rstrip("市")
        text = text.replace(inside[0], "")
    text = _LEGAL_ZH.sub("", text)
    text = re.sub(r"有$", "", text)
    for _ in range(2):  # at the end, or moved to the front
        for slot, words in (("trade", TRADES_ZH), ("field", FIELDS_ZH)):
            if not parts[slot] and text[-2:] in words and len(text) > 3:
                parts[slot], text = text[-2:], text[:-2]
    if not parts["trade"]:
        for slot, words in (("field", FIELDS_ZH), ("trade", TRADES_ZH)):
            if not parts[slot] and text[:2] in words and len(text) > 3:
                parts[slot], text = text[:2], text[2:]
    if not parts["town"]:
        m = re.match(rf"(.[{TOWN_ENDS_ZH}])市?(?=.{{2}})", text)
        if m:
            parts["town"], text = m[1], text[m.end() :]
    parts["brand"] = text
    return parts


def _losses(word: str) -> set[str]:
    """A word and what is left without one of its characters.  One character alone would stand for too many words, so a word of two is
    its own form and that of its swapped characters."""
    return {word} | ({word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) > 2 else {"".join(sorted(word))})


def rewritings(name: str) -> list[tuple[str, str, str, str]]:
    """(identity, form, role, whole) rows: role 'full' for a form of a complete identity, 'short' for a spelling that
    leaves parts out, 'slip' for a form with a character lost; ``whole`` is what two spellings under a slip form are compared by."""
    p = parse(name)
    out = []
    if p["kind"] == "person":
        surname = p["surname"]
        if "given" in p:
            identity = f"p:{p['given']}|{surname}"
            out.append((identity, f"pi:{p['given'][0]}|{surname}", "full", ""))
            out += [(identity, f"ps:{p['given']}|{x}", "slip", surname) for x in _losses(surname)]
        else:
            out.append((f"pi:{p['initial']}|{surname}", f"pi:{p['initial']}|{surname}", "short", ""))
        return out
    b, f, t, w = p["brand"], p["field"], p["trade"], p["town"]
    if not b:
        return [(f"w:{canonical_text(name, fold=True)}", f"w:{canonical_text(name, fold=True)}", "full", "")]
    identity = f"c:{b}|{f}|{t}|{w}"
    slots = {"f": f, "t": t, "w": w}
    have = "".join(k for k in "ftw" if slots[k])

    def form(keys: str) -> str:
        return f"c{keys}:{b}" + "".join("|" + slots[k] for k in keys)

    for keys in ("", "f", "t", "w", "fw", "tw", "ft", "ftw"):
        if all(k in have for k in keys):
            out.append((identity, form(keys), "full" if f and t else "part", ""))
    out.append((identity, form(have), "short", ""))
    if w:  # the town may be what the complete spellings leave out
        out.append((identity, form(have.replace("w", "")), "townless", ""))
    if len(b) > 1:
        rest = f"{f}|{t}"
        for x in _losses(b):
            if f and t:
                out.append((identity, f"cs:{x}|{rest}", "slip", b))
            if w and t:
                out.append((identity, f"csw:{x}|{t}|{w}", "slip" if f else "part-slip", b))
    return out


_FORMS = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "identity", "core", "town", "form", "role", "whole")])


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name in batch["name"]:
            for identity, form, role, whole in rewritings(name):
                core, _, town = identity.rpartition("|") if identity.startswith("c:") else (identity, "", "")
                rows.append((name, identity, core, town, form, role, whole))
        yield pd.DataFrame(rows, columns=_FORMS.names)


def spellings(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct names in the given columns; nulls and blank strings left out."""
    all_names = rows.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("name"))
    return all_names.where("name is not null").where(F.length(F.regexp_replace("name", r"(?U)\s", "")) > 0).distinct()


def _components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node is connected to; labels spread and jump until nothing changes, in about as many rounds as the
    logarithm of the longest chain."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    both = cut(both)
    labels = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label"))
    while True:
        labels = cut(labels)
        spread = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(spread, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("jumped"))
        moved = cut(lower.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("jumped", "next")).alias("next")))
        labels = moved.select("node", F.col("next").alias("label"))
        if moved.where("label <> next").isEmpty():
            return labels


def _one_slip(a: str, b: str) -> Column:
    """``one_slip`` of two columns: one edit apart, or the same but for two neighbours swapped."""
    swapped = F.expr(f"length({a}) = length({b}) and exists(sequence(1, greatest(1, length({a}) - 1)), i -> concat(substring({a}, 1, i - 1), substring({a}, i + 1, 1), substring({a}, i, 1), substring({a}, i + 2)) = {b})")
    return (F.levenshtein(a, b, 1) >= 0) | swapped


def party_classes(names: DataFrame) -> DataFrame:
    """(name, party): the class of each distinct name; ``party`` is a hash of the class's smallest node.

    The work is over distinct names, so one party that holds a third of all rows weighs as one name.  Links go from each
    spelling to the identity it stands for and from a slipped identity to its neighbours under a form; no group is expanded to
    all its pairs: members of a form are compared with the form's most written member and with each other only as
    identities that share the form, which rarity bounds.
    """
    forms = cut(names.select("name").mapInPandas(_forms, _FORMS))
    identities = forms.select("name", "identity").distinct()
    own = identities.select(F.col("identity").alias("a"), F.concat(F.lit("n:"), "name").alias("b"))
    # rarity: how many identities, and how many cores among complete ones, a form can stand for
    cores = (
        forms.where("role in ('full', 'part')")
        .groupBy("form")
        .agg(
            F.count_distinct(F.when(F.col("role") == "full", F.col("core"))).alias("full_cores"),
            F.min(F.when(F.col("role") == "full", F.col("identity"))).alias("full_identity"),
            F.count_distinct(F.when((F.col("role") == "full") & (F.col("town") != ""), F.col("town"))).alias("towns"),
        )
    )
    # a spelling with parts left out: one complete core, in at most one town (or the form names the town)
    short = (
        forms.where("role = 'short'")
        .select("identity", "form", "town")
        .distinct()
        .join(cores, "form")
        .where("full_cores = 1 and (towns <= 1 or town <> '')")
        .select(F.col("identity").alias("a"), F.col("full_identity").alias("b"))
        .where("a <> b")
    )
    townless = (
        forms.where("role = 'townless'")
        .select("identity", "form")
        .distinct()
        .join(cores, "form")
        .where("full_cores = 1 and towns = 0")
        .select(F.col("identity").alias("a"), F.col("full_identity").alias("b"))
        .where("a <> b")
    )
    # one slip: neighbours under a form, compared to the form's members once each
    slips = forms.where("role = 'slip'").select("form", "identity", "whole", "town").distinct()
    x, y = slips.where("form not like 'csw:%'").alias("x"), slips.alias("y")
    near = (
        x.join(y, "form")
        .where("x.identity < y.identity and (x.town = y.town or x.town = '' or y.town = '')")
        .select(F.col("x.identity").alias("a"), F.col("y.identity").alias("b"), F.col("x.whole").alias("wa"), F.col("y.whole").alias("wb"))
        .distinct()
        .where(_one_slip("wa", "wb"))
        .select("a", "b")
    )
    # a slip in a spelling that also leaves out the field: linked where only one complete core is that near
    x, y = forms.where("role = 'part-slip'").select("form", "identity", "whole").distinct().alias("x"), slips.where("form like 'csw:%'").select("form", "identity", "whole", F.expr("split(identity, '[|]')[1]").alias("field")).alias("y")
    partial = (
        x.join(y, "form")
        .select(F.col("x.identity").alias("a"), F.col("y.identity").alias("b"), F.col("x.whole").alias("wa"), F.col("y.whole").alias("wb"), "field")
        .distinct()
        .where(_one_slip("wa", "wb"))
        .groupBy("a")
        .agg(F.count_distinct("field").alias("fields"), F.min("b").alias("b"))
        .where("fields = 1")
        .select("a", "b")
    )
    labels = _components(own.unionByName(short).unionByName(townless).unionByName(near).unionByName(partial))
    return labels.where("node like 'n:%'").select(F.expr("substring(node, 3)").alias("name"), F.xxhash64("label").alias("party"))


def same_party_pairs(classes: DataFrame) -> DataFrame:
    """(name_a, name_b) for every two spellings of one party, the smaller by code points first."""
    a = classes.select("party", F.col("name").alias("name_a"))
    b = classes.select("party", F.col("name").alias("name_b"))
    return a.join(b, "party").where(F.encode("name_a", "UTF-8") < F.encode("name_b", "UTF-8")).select("name_a", "name_b").distinct()

"""Scores for abusive, hateful and sexual language by weak supervision.

Voters are word lists and patterns for three languages; each votes for one kind, or against all kinds.  They
look at a segment (a line's sentence) in a plain view in which disguises are undone: look-alikes, full-width
forms, invisible characters, digits and signs for letters, stretched letters, letters set apart, masked letters.
The votes of all segments of all documents are counted by pattern of votes (at most 2^voters patterns a kind).
A generative model of the votes is fitted to the counts of different segments by expectation maximisation: how often each voter votes
in segments of the kind and in others, and how far two voters go together beyond that; voters that repeat each other share their weight.
Its posterior labels train a linear classifier over the segment's character runs and votes,
on a bounded sample (``SAMPLE`` segments, documented parameter, chosen by hash); counts, votes and scores cover all segments.

A document's score for a kind is the highest of its segments.  Null, empty and blank texts score 0.
The ratings in ``labels`` are not used for training; they measure (see README).
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import keep
from .forms import canonical_text

KINDS = ("abuse", "hate", "sexual")
#: About so many segments the classifier is fitted on: half of them with votes, half without (documented bound of the fit).
SAMPLE = 20_000
THRESHOLD = 0.5
#: The label model's starting rates weigh as much as so many segments; beyond that the votes decide.
PSEUDO_COUNTS = 10.0
_BUCKETS = 1 << 18

# Word lists.
INSULTS = """idiot moron imbecile dimwit scumbag bastard loser pig asshole arsehole bitch cretin halfwit fool jerk dickhead twat wanker prick cunt dumbass dumbo nitwit numbskull retard whore slut swine pigs idiots morons bastards losers imbeciles dimwits scumbags cretins
trottel arschloch drecksack versager idiot idioten vollidiot depp schwachkopf dummkopf mistkerl scheißkerl hurensohn wichser schlampe blödmann vollpfosten dreckskerl penner schwein lump armleuchter miststück fotze arschlöcher versagerin""".split()
INSULTS_ZH = "白痴 混蛋 傻逼 傻子 傻瓜 蠢货 废物 脑残 王八蛋 垃圾 畜生 杂种 贱人 狗东西 人渣 笨蛋 滚蛋 智障 弱智 神经病 去死 他妈的 妈的 狗屎 饭桶 蠢猪".split()
SCORN_EN = "scum vermin parasites parasite rats rat subhuman thieves cockroaches filth leeches plague savages lice maggots criminals".split()
SCORN_DE = "ungeziefer parasiten ratten abschaum gesindel pack untermenschen diebe schmarotzer verbrecher brut dreckspack schädlinge".split()
SCORN_ZH = "害虫 寄生虫 老鼠 败类 蛆虫 渣滓 不配做人 恶心 小偷 低等 劣等 祸害".split()
SEXUAL = """nude nudes naked sex porn porno horny fuck undressed erotic blowjob orgasm pornographic sexy undress striptease
nackt nacktbilder nacktfotos sexvideos sexbilder sexfotos ficken unbekleidet geil nacktfoto nacktbild sextreffen pornos porno bumsen entkleidet ausgezogen splitternackt sexdienste erotik""".split()
SEXUAL_ZH = "裸聊 裸照 裸体 色情 一夜情 激情服务 一丝不挂 脱光 做爱 性服务 约炮 寂寞难耐 激情视频 黄片 床上 性交 包夜 成人视频 光着身子 上床".split()

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"})
_LEET_IN = re.compile(r"[013457@$!|€+]+")
_APART = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*·~/|]{1,2}[^\W\d_]){2,}(?![^\W_])")
_APART_ZH = re.compile(r"(?<=[一-鿿])[ .\-_·~/|+^]+(?=[一-鿿])")
_APART_HINT = re.compile(r"[ .\-_*·~/|\ue000][^\W\d_][ .\-_*·~/|]{1,2}[^\W\d_](?![^\W_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_END = re.compile(r"[.!?]\s|。|[!?](?=[一-鿿])")
_MASKED = re.compile(r"(?<![^\W_])[a-zäöüß]+[*#_]+[a-zäöüß*#_]*")
_QUOTES = re.compile("[\"'“”„‘’«»《》]")


def segments(text: str | None) -> list[str]:
    """The segments of a text in the plain view."""
    if not text or text.isspace():
        return []
    whole = plain(canonical_text(text.replace("\n", "\ue000"), fold=True))
    return [s for x in _END.sub(lambda m: m[0] + "\ue000", whole).split("\ue000") if len(s := x.strip(" ")) > 1]


def plain(s: str) -> str:
    """A text with disguises undone."""
    s = _QUOTES.sub("", s)
    if not s.isascii():
        s = _APART_ZH.sub("", s)
    if _APART_HINT.search(s):
        s = _APART.sub(_together, s)
    s = _LEET_IN.sub(_unleet, s)
    if _has_stretch(s):
        s = _STRETCHED.sub(r"\1", s)
    if "*" in s or "#" in s or "_" in s:
        s = _MASKED.sub(_unmask, _MASK_ZH.sub(_unmask_zh, s))
    return s


def _has_stretch(s: str) -> bool:
    """Whether a letter stands three times in a row."""
    points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    same = points[1:] == points[:-1]
    return any(s[i].isalpha() for i in np.flatnonzero(same[1:] & same[:-1]).tolist())


def _together(m: re.Match) -> str:
    """Letters set apart as one word; an article before it stays a word of its own."""
    word = re.sub(r"[^\w]|_", "", m[0])
    plain_word = _STRETCHED.sub(r"\1", word)
    return f"{word[0]} {word[1:]}" if plain_word not in _LISTED and plain_word[1:] in _LISTED else word


def _unleet(m: re.Match) -> str:
    """Digits and signs between letters, before two letters at a word's start, or after two at its end, as letters."""
    s, a, b = m.string, m.start(), m.end()
    left, right = s[a - 1 : a], s[b : b + 1]
    low, high = left.isalpha() and left < "ɐ", right.isalpha() and right < "ɐ"
    if low and high or (high and not left.isalnum() and s[b + 1 : b + 2].isalnum()) or (low and not right.isalnum() and s[a - 2 : a - 1].isalpha() and m[0].isalnum()):
        return m[0].translate(_LEET)
    return m[0]


_LISTED = dict.fromkeys(sorted({*INSULTS, *SEXUAL, *SCORN_EN, *SCORN_DE}))
_MASKED_ZH = {w[:i] + "*" + w[i + 1 :]: w for w in (*INSULTS_ZH, *SCORN_ZH, *SEXUAL_ZH) for i in range(len(w)) if len(w) < 6}
_MASK_ZH = re.compile(r"[一-鿿]{1,5}\*[一-鿿]{0,5}")


def _unmask_zh(m: re.Match) -> str:
    s = m[0]
    at = s.index("*")
    for size in (5, 4, 3, 2):
        for a in range(max(0, at - size + 1), min(at, len(s) - size) + 1):
            if word := _MASKED_ZH.get(s[a : a + size]):
                return s[:a] + word + s[a + size :]
    return s


def _unmask(m: re.Match) -> str:
    pattern = re.compile("".join("." if c in "*#_" else re.escape(c) for c in m[0]))
    return next((w for w in _LISTED if pattern.fullmatch(w)), m[0])


def _words(words: list[str]) -> str:
    """Alternatives for the words, also with their doubled letters once (as stretched words come out) where that leaves a word of some length."""
    return "|".join(sorted({re.escape(x) for w in words for x in (w, re.sub(r"(.)\1", r"\1", w)) if x == w or len(x) > 3}, key=len, reverse=True))


_W = r"(?<![^\W_])(?:{})(?![^\W_]|-$)"
_INSULT = _W.format(_words(INSULTS)) + "|" + "(?:" + "|".join(INSULTS_ZH) + ")(?!桶|袋|箱|分类|回收|邮件|清运|处理)"
_GROUP = r"(?:the|those|these|all|any|every one of those|die|diese|dieser|alle|keine) (?:\w+ )?\w{4,}(?:s|i|sh|en|er|ans|ier|ians|ese|e)\b|[一-鿿]{2,4}?(?:人|族)(?=都|全|就|没|是|天生|也|,|里|们)"

#: Voters: name, kind ("" votes against all), pattern.  A voter looks only at segments with what its pattern needs.
VOTERS: list[tuple[str, str, re.Pattern]] = [
    (name, kind, re.compile(pattern))
    for name, kind, pattern in [
        ("insult", "abuse", _INSULT),
        ("insult-you", "abuse", rf"(?:you|your|du|dich|dir|ihr|sie|你|你们|叫那个|这个|这种|那个|only an?|nur ein|what kind of|was für ein|只有).{{0,24}}(?:{_INSULT})|(?:{_INSULT}).{{0,16}}(?:you\b|\bdu\b|东西|你)"),
        ("threat", "abuse", r"(?:break|smash|bash|kick) (?:your|his|her|their)|(?:kill|murder|hurt|beat|stab|strangle|shoot) (?:you|him|her|them)\b|know where (?:you|he|she|they) lives?|watch your back|(?:you|he|she|they)(?:'ll| will| are going to) (?:regret|pay|be sorry)|make (?:you|him|her) (?:pay|suffer)|(?:schlag|brech|tret|hau)e? (?:dir|dich|ihm|ihr|euch)|bring(?:e)? (?:dich|ihn|sie|euch) um|mach(?:e)? (?:dich|ihn|sie|euch) (?:fertig|kalt)|wei(?:ß|ss) (?:\w+ )?wo (?:du|er|sie|ihr|der|die)|打断你|弄死|杀了你|打死你|知道[他她你]住|砍死|揍你|要你的命|让你好看|小心点|hope (?:you|he|she|they|you all) (?:die|choke|rot|burn|suffer|bleed)|die in a fire|end up in (?:hospital|a ditch|a coffin)|hoffe,? (?:du|ihr|er|sie) (?:stirbst|krepier|verreck|sterbt|stirbt)|krepier|verreck|不得好死|弄死你|宰了你"),
        ("dismiss", "abuse", r"drop dead|go to hell|shut up|shut your|get lost|piss off|fuck (?:you|off)|screw you|burn in hell|halt (?:die fresse|den mund|dein maul|die klappe)|halts maul|fahr zur hölle|verpiss dich|verschwinde|leck mich|滚蛋|滚开|滚出|去死|闭嘴|见鬼去|给我滚|nobody (?:likes|wants|needs|loves) (?:you|him|her|them)\b|(?:you are|you're|he is|she is) (?:such )?an? (?:\w+ ){0,2}(?:clown|joke|disgrace|coward|creep|freak|waste of space|nobody|parasite|liar|failure)\b|(?:du bist|ihr seid) (?:\w+ ){0,3}(?:clown|feigling|lügner|nichtsnutz|abschaum|niete|schande|witzfigur)|keiner mag dich|niemand mag dich|没人喜欢你|丢人现眼|不是人"),
        ("curse", "abuse", r"\b(?:damn|bloody|fucking|filthy|pathetic|disgusting|brainless|stupid|worthless|useless|verdammte\w*|dreckige\w*|blöde\w*|dumme\w*|erbärmliche\w*|hirnlose\w*|beschissene\w*|dämliche\w*|verfluchte\w*|widerliche\w*)\b|脑子进水|没脑子|瞎了|不要脸|他妈"),
        ("scorn", "hate", _W.format(_words(SCORN_EN + SCORN_DE)) + "|" + "|".join(SCORN_ZH)),
        ("scorn-group", "hate", rf"(?:{_GROUP}).{{0,40}}(?:{_W.format(_words(SCORN_EN + SCORN_DE))}|{'|'.join(SCORN_ZH)})|(?:{_W.format(_words(SCORN_EN + SCORN_DE))}).{{0,30}}(?:{_GROUP})"),
        ("drive-out", "hate", r"driven? (?:them )?out|crawl back|go back (?:to )?where|where (?:they|you) came from|keep (?:them|those|these) (?:\w+ )?(?:off|out|away)|(?:do not|don't|never|nobody should) (?:hire|serve|trust|employ|rent to)|not welcome here|send them (?:back|home)|get rid of (?:them|these|those)|赶出去|滚回|不要雇|别雇|不许进|不接待|没有一个好东西|全部赶|天生就是|stellt .{0,12}kein|rauswerfen|vertreiben|raus aus|zurück (?:in|nach|wo|dahin)|gehören? (?:raus|vertrieben|fort|weg)|hinaus|bedienen (?:wir )?(?:hier )?(?:nicht|keine)|keine \w+ einstellen|verjag"),
        ("only-good", "hate", r"only good \w+|people like (?:the|those)|breeds? like|that (?:lot|kind|sort)\b|by nature|in their blood|von natur aus|leute wie die|einzig guten?|dieses (?:pack|gesindel|volk|ungeziefer)|sind alle\b|are all\b|all of them are|人都是|族都是|人全是|族全是|人就|(?:those|these|the|all|diese|die|alle) (?:\w+ )?\w{4,} (?:are|sind) (?:\w+ ){0,3}(?:animals|dogs|beasts|monkeys|apes|subhumans|a disease|a plague|tiere|hunde|affen|bestien)\b|[人族](?:都|全)?是(?:畜生|动物|猴子|狗)"),
        ("explicit", "sexual", _W.format(_words(SEXUAL)) + "|" + "|".join(SEXUAL_ZH)),
        ("explicit-media", "sexual", r"(?:nude|naked|adult|sex|porn|erotic) ?(?:pictures?|photos?|selfies?|videos?|pics?|clips?|chat|shows?)|private shows?|nackt\w+|sex(?:videos?|bilder|fotos|chat|clips?)|裸聊|裸照|色情视频|成人视频|激情服务|激情视频"),
        ("desire", "sexual", r"horny|lonely and|think(?:ing)? about you|want you (?:undressed|naked|with nothing on)|have sex|(?:let us|lets|let's|want to|wanna) (?:fuck|screw)|with nothing on|in my (?:bed|room)|see you naked|call me tonight|heute nacht (?:\w+ )?(?:nackt|unbekleidet|ausgezogen|ohne)|nackt sehen|ohne kleid|will dich|mit dir (?:schlafen|ins bett|sex)|寂寞难耐|看你(?:裸体|脱光|一丝不挂|光)|来我房间|今晚就约|想和你|陪我"),
        ("offer", "sexual", r"write for prices|send me .{0,30}(?:nude|naked|sex|adult|selfie|pictures of your)|pay the invoice at once|schick mir|zahle ich sofort|价格私聊|马上付款|今晚约|for prices|preise? auf anfrage|ruf mich an|求(?:裸|色|一夜|激情)|发几张"),
        ("contempt-mild", "", r"\b(?:sorry|apolog\w+|excuse|entschuldig\w+|verzeih\w+|pardon)\b|谅解|抱歉|对不起|请原谅"),
        ("technical", "", r"\b(?:process|print job|printer job|server|script|thread|queue|import|medical|breast|hosiery|coloured|wire|wires|pump|programm|prozess|rohr|kabel|draht)\b|进程|裸机|裸线|按米|医用|解剖|性别|sex: ?[mfdx]\b|geschlecht"),
        ("official", "", r"\b(?:policy|training|report(?:ed)? (?:an?|the)|logged|noted|association|committee|festival|poster|posters|culture|cultural|complaint about|harassment|lecture|course|schulung|seminar|verein|kultur\w*|gemeldet|vermerkt|höflich|politely|museum|statistics|prevention)\b|协会|文化|培训|海报|反歧视|记录在案|举报|讲座|制度|政策|礼貌"),
        ("waste", "", r"垃圾(?:桶|袋|箱|分类|回收|邮件|清运|处理)|\b(?:garbage|trash|rat|rats|vermin|pest|pig|pigs|parasite) (?:bin|bag|trap|traps|control|iron|farm|poison|skin)|rattengift|rattenfalle|fachbetrieb|bekämpf|kammerjäger|pest control|exterminat|schädlingsbekämpfung|ungezieferbekämpfung|鼠药|鼠夹|灭鼠|杀虫|消杀|防治"),
    ]
]
N_VOTERS = len(VOTERS)
#: Voters whose words are in plain use, too: their vote starts out as weak evidence.
_WEAK = {"insult", "curse", "scorn", "explicit", "only-good"}
#: Exact alternatives of a part of a pattern are listed up to this number.
_ALTERNATIVES = 400


def _exact(parts) -> set[str] | None:
    """All strings that a parsed pattern can match, or None where they are too many; look-arounds are taken as met."""
    out = {""}
    for op, value in parts:
        if op is sre.LITERAL:
            own = {chr(value)}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value):
            own = {chr(v) for _, v in value}
        elif op is sre.SUBPATTERN:
            own = _exact(value[-1])
        elif op is sre.BRANCH:
            each = [_exact(x) for x in value[1]]
            own = None if None in each else set().union(*each)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] == 1:
            own = _exact(value[2])
            own = own if own is None or value[0] else own | {""}
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            own = {""}
        else:
            own = None
        if own is None or len(out) * len(own) > _ALTERNATIVES:
            return None
        out = {x + y for x in out for y in own}
    return out


def _needed(parts) -> set[tuple[str, bool]]:
    """Strings of which every match of a parsed pattern holds at least one, and whether it has to stand alone; empty if there are none."""
    parts, choices = list(parts), []
    for n, (op, value) in enumerate(parts):
        edge = lambda k: 0 <= k < len(parts) and (parts[k][0] is sre.ASSERT_NOT or parts[k] == (sre.AT, sre.AT_BOUNDARY))
        alone = edge(n - 1) and edge(n + 1)
        if op is sre.SUBPATTERN and len(value[-1]) == 1:
            op, value = value[-1][0]
        if op is sre.BRANCH:
            each = []
            for x in value[1]:
                words = _exact(x) if alone else None
                each.append({(w, True) for w in words} if words and "" not in words else _needed(x))
            choices.append(set().union(*each) if all(each) else set())
        elif op is sre.SUBPATTERN:
            choices.append(_needed(value[-1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0]:
            choices.append(_needed(value[2]))
    a = 0
    while a < len(parts):  # neighbouring parts that can be listed together
        b, words = a, {""}
        while b < len(parts) and (more := _exact(parts[a : b + 1])) is not None:
            b, words = b + 1, more
        choices.append(set() if "" in words else {(w, False) for w in words})
        a = max(b, a + 1)
    return max(choices, key=lambda c: (min((len(w) for w, _ in c), default=0), -len(c)), default=set())


@functools.cache
def _triggers():
    """An automaton of what the voters with a kind need, derived from their patterns: for each string its length, the voters that need it
    anywhere and those that need it standing alone."""
    import ahocorasick

    masks: dict[str, list[int]] = {}
    for i, (name, kind, pattern) in enumerate(VOTERS):
        if kind:
            needed = _needed(sre_parser.parse(pattern.pattern))
            assert needed, f"the voter {name} has an alternative without a fixed part"
            for word, alone in needed:
                masks.setdefault(word, [0, 0])[alone] |= 1 << i
    automaton = ahocorasick.Automaton()
    for word, (anywhere, alone) in masks.items():
        automaton.add_word(word, (len(word), anywhere, alone))
    automaton.make_automaton()
    return automaton


_FOR = sum(1 << i for i, (_, kind, _) in enumerate(VOTERS) if kind)


def vote(segment: str, voters: int = _FOR) -> int:
    """The segment's votes as bits; ``voters`` are those with a kind that may vote at all."""
    bits = 0
    for i, (_, kind, pattern) in enumerate(VOTERS):
        if (voters >> i & 1 if kind else bits) and pattern.search(segment):
            bits |= 1 << i
    return bits


def votes(parts: list[str]) -> list[int]:
    """The votes of the segments of one text; a voter looks only at segments that hold what its pattern needs."""
    bits = [0] * len(parts)
    whole = "\n".join(parts) + "\n"
    ends: list[int] = []
    for at, (size, anywhere, alone) in _triggers().iter(whole):
        voters = anywhere
        if alone and not (whole[at + 1].isalpha() or at >= size and whole[at - size].isalpha()):
            voters |= alone
        if voters:
            ends = ends or list(itertools.accumulate(len(p) + 1 for p in parts))
            bits[bisect.bisect_right(ends, at)] |= voters
    return [vote(p, b) if b else 0 for p, b in zip(parts, bits)]


def _own(kind: str) -> list[int]:
    """The voters of a kind's model: those for it, those against all, and for insults of persons those for contempt of groups, as against."""
    return [i for i, (n, k, _) in enumerate(VOTERS) if k in (kind, "") or kind == "abuse" and n in ("scorn-group", "drive-out")]


class LabelModel:
    """Two classes, conditionally dependent voters: rates of voting in either class and pairwise ties."""

    def __init__(self, kind: str, patterns: dict[int, int], rounds: int = 60):
        self.kind, self.voters = kind, _own(kind)
        merged: dict[tuple[int, ...], float] = {}
        for bits, n in patterns.items():
            row = tuple((bits >> i) & 1 for i in self.voters)
            if any(row[j] for j, i in enumerate(self.voters) if VOTERS[i][1] == kind):
                merged[row] = merged.get(row, 0.0) + n
        self.x = np.array(list(merged) or [[0] * len(self.voters)], dtype=float)
        self.n = np.array(list(merged.values()) or [0.0])
        positive = np.array([VOTERS[i][1] == kind for i in self.voters])
        # start and prior: a voter for the kind votes in half of such segments and hardly in others, a weak one in half of these, too
        self.prior = 0.5
        weak = np.array([VOTERS[i][0] in _WEAK for i in self.voters])
        start_1, start_0 = np.where(positive, np.where(weak, 0.75, 0.5), 0.03), np.where(positive, np.where(weak, 0.5, 0.06), 0.4)
        self.rate_1, self.rate_0 = start_1.copy(), start_0.copy()
        self.tie = np.zeros((len(self.voters), len(self.voters)))
        weight = PSEUDO_COUNTS
        for _ in range(rounds):
            p = self.posterior(self.x)
            self.prior = float(np.clip((self.n @ p + weight / 2) / (self.n.sum() + weight), 0.02, 0.98))
            self.rate_1 = np.clip(((self.n * p) @ self.x + weight * start_1) / ((self.n * p).sum() + weight), 0.01, 0.99)
            self.rate_0 = np.clip(((self.n * (1 - p)) @ self.x + weight * start_0) / ((self.n * (1 - p)).sum() + weight), 0.01, 0.99)
            self.tie = self._ties(p)

    def _ties(self, p: np.ndarray) -> np.ndarray:
        total = np.zeros_like(self.tie)
        for w, rate in ((self.n * p, self.rate_1), (self.n * (1 - p), self.rate_0)):
            d = self.x - rate
            c = (d * w[:, None]).T @ d / (w.sum() + PSEUDO_COUNTS)
            s = np.sqrt(np.maximum(rate * (1 - rate), 1e-3))
            total += np.clip(c / np.outer(s, s), 0, 1) / 2
        np.fill_diagonal(total, 0)
        return np.where(total > 0.15, total, 0)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        shared = 1 / (1 + (self.tie @ x.T) / 2).T  # voters that go together share their weight
        yes, no = np.log(self.rate_1 / self.rate_0), np.log((1 - self.rate_1) / (1 - self.rate_0))
        z = math.log(self.prior / (1 - self.prior)) + (x * yes * shared).sum(1) + 0.3 * ((1 - x) * no).sum(1)
        return 1 / (1 + np.exp(-z))

    def label(self, bits: int) -> float:
        row = np.array([[(bits >> i) & 1 for i in self.voters]], dtype=float)
        if not any(row[0][j] for j, i in enumerate(self.voters) if VOTERS[i][1] == self.kind):
            return 0.0
        return float(self.posterior(row)[0])


#: Lengths of the character runs that are the classifier's features.
RUNS = (3,)


def _features(parts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each run length the bucket of every position of the segments set one after another, and where each segment starts."""
    joined = "\n".join(parts) + "\n\n\n\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    n = int(lengths.sum())
    buckets = []
    for run in RUNS:
        h = np.full(n, run, dtype=np.uint32)
        for k in range(run):
            h *= np.uint32(0x9E3779B1)
            h ^= points[k : k + n]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        buckets.append(((h ^ (h >> np.uint32(13))) & np.uint32(_BUCKETS - 1)).astype(np.int32))
    return buckets, np.cumsum(lengths) - lengths


def linear_scores(parts: list[str], bits: list[int], weights: dict[str, np.ndarray]) -> np.ndarray:
    """Probabilities of each kind for each segment."""
    if not parts:
        return np.zeros((0, len(KINDS)))
    buckets, starts = _features(parts)
    lengths = np.diff(np.append(starts, len(buckets[0])))
    z = np.zeros((len(parts), len(KINDS)), dtype=np.float32)
    for run, b in enumerate(buckets):
        for k in range(len(KINDS)):
            z[:, k] += np.add.reduceat(weights["runs"][run, k][b], starts)
    z /= np.sqrt(lengths)[:, None]
    z += weights["bias"]
    voted = [i for i, x in enumerate(bits) if x]
    if voted:
        z[voted] += _bit_rows([bits[i] for i in voted]) @ weights["votes"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _bit_rows(bits: list[int]) -> np.ndarray:
    return ((np.array(bits, dtype=np.int64)[:, None] >> np.arange(N_VOTERS)) & 1).astype(np.float32)


def fit_linear(parts: list[str], bits: list[int], targets: np.ndarray, rounds: int = 80, rate: float = 0.15, decay: float = 2e-5) -> dict[str, np.ndarray]:
    """Logistic regression for each kind on soft targets over character runs and votes, by Adam steps over the whole sample."""
    w = {"runs": np.zeros((len(RUNS), len(KINDS), _BUCKETS), dtype=np.float32), "votes": np.zeros((N_VOTERS, len(KINDS)), dtype=np.float32), "bias": np.full(len(KINDS), -2.0, dtype=np.float32)}
    if not parts:
        return w
    buckets, starts = _features(parts)
    lengths = np.diff(np.append(starts, len(buckets[0])))
    owner = np.repeat(np.arange(len(parts)), lengths)
    rows, scale = _bit_rows(bits), (1 / np.sqrt(lengths)).astype(np.float32)
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    for t in range(1, rounds + 1):
        error = (targets - linear_scores(parts, bits, w)).astype(np.float32)
        g = {"bias": error.mean(0) * 20, "votes": rows.T @ error / len(parts) * 20, "runs": np.stack([np.stack([np.bincount(b, (error[:, k] * scale)[owner], _BUCKETS) for k in range(len(KINDS))]) for b in buckets]).astype(np.float32) / len(parts) * 20}
        for k in w:
            g[k] -= decay * w[k]
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            w[k] += rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-4)
    return w


_VOTED = T.StructType([T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("bits", T.ArrayType(T.IntegerType()))])


def voted_segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, parts, bits): the segments of every document and their votes, written once; fitting and scoring read them.

    Null, empty and blank texts have no segments; no row is left out."""
    kind = docs.schema[key].dataType
    names = [key, "parts", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [segments(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, every)], dtype=np.int64).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(ends), pa.array([s for own in every for s in own], pa.string()))
            bits = pa.ListArray.from_arrays(pa.array(ends), pa.array([b for own in every for b in votes(own)], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), parts, bits], names=names)

    return keep(docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, T.StructType([T.StructField(key, kind), *_VOTED.fields])))


class Scorer:
    """The fitted label models and classifier."""

    def __init__(self, patterns: dict[int, int], sample: list[tuple[int, str]]):
        self.models = [LabelModel(k, patterns) for k in KINDS]
        self.labels = {b: np.array([m.label(b) for m in self.models]) for b in {*patterns, *(b for b, _ in sample)}}
        targets = np.array([self.labels[b] for b, _ in sample]).reshape(-1, len(KINDS))
        self.weights = fit_linear([s for _, s in sample], [b for b, _ in sample], targets)


def document_scores(every: list[list[str]], bits: list[int], weights: dict[str, np.ndarray]) -> np.ndarray:
    """The highest segment score for each kind of each document's segments; ``bits`` are the votes of all of them, one after another."""
    best = np.zeros((len(every), len(KINDS)))
    parts = [s for own in every for s in own]
    if parts:
        p = linear_scores(parts, bits, weights)
        sizes = np.fromiter(map(len, every), dtype=np.int64, count=len(every))
        best[sizes > 0] = np.maximum.reduceat(p, (np.cumsum(sizes) - sizes)[sizes > 0], axis=0)
    return best


def _each(voted: DataFrame) -> DataFrame:
    """(bits, segment) of every segment."""
    return voted.select(F.explode(F.arrays_zip("bits", "parts")).alias("s")).select("s.bits", F.col("s.parts").alias("segment"))


def vote_patterns(voted: DataFrame) -> DataFrame:
    """(bits, n, n_distinct) of every pattern of votes: its segments and, where there is a vote, its different segments, so that a passage
    that is copied over many documents counts as one piece of evidence.  Voteless segments are not told apart (n_distinct is about right for them)."""
    every = _each(voted)
    some = every.where("bits <> 0").groupBy("bits", "segment").agg(F.count("*").alias("n")).groupBy("bits").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))
    return some.unionByName(every.where("bits = 0").groupBy("bits").agg(F.count("*").alias("n"), F.approx_count_distinct("segment").alias("n_distinct")))


def fit(voted: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Label models from the counts over all documents; the classifier from a sample of about ``sample`` different segments: half of them with votes,
    half without, each half those whose hash is below the rate that its count of different segments gives."""
    rows = vote_patterns(voted).collect()  # one row for each pattern of votes
    distinct = {True: sum(r["n_distinct"] for r in rows if r["bits"]), False: sum(r["n_distinct"] for r in rows if not r["bits"])}
    rate = lambda some: F.lit(int((1 << 31) * min(1.0, sample / 2 / max(1, distinct[some]))))
    below = F.pmod(F.xxhash64("segment"), F.lit(1 << 31)) < F.when(F.col("bits") != 0, rate(True)).otherwise(rate(False))
    chosen = sorted((r["bits"], r["segment"]) for r in _each(voted).where(below).distinct().collect())
    return Scorer({r["bits"]: r["n_distinct"] for r in rows}, chosen)


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", scorer: Scorer | None = None) -> DataFrame:
    """``key`` and a score in 0..1 for each kind, for every row; null and blank texts score 0."""
    voted = voted_segments(docs, key, text)
    scorer = scorer or fit(voted)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(k, T.DoubleType(), False) for k in KINDS])
    model = docs.sparkSession.sparkContext.broadcast(scorer.weights)  # bounded by the number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # bounds the arrays of a step
                part = batch.slice(a, 256)
                best = document_scores(part.column(1).to_pylist(), part.column(2).flatten().to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, best.T)], names=schema.names)

    return voted.mapInArrow(run, schema)


def voter_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each voter: the segments it votes on, those of them that another voter for a kind votes on, too, and the rates that its kind's label model
    estimates for it (votes in segments of the kind, votes in others; null for voters against all kinds)."""
    rows = vote_patterns(voted_segments(docs, key, text)).collect()  # one row for each pattern of votes
    models = {k: LabelModel(k, {r["bits"]: r["n_distinct"] for r in rows}) for k in KINDS}
    out = []
    for i, (name, kind, _) in enumerate(VOTERS):
        own = [r for r in rows if r["bits"] >> i & 1]
        rates = (None, None)
        if kind:
            at = models[kind].voters.index(i)
            rates = float(models[kind].rate_1[at]), float(models[kind].rate_0[at])
        out.append((name, kind, sum(r["n"] for r in own), sum(r["n"] for r in own if r["bits"] & _FOR & ~(1 << i)), *rates))
    return docs.sparkSession.createDataFrame(out, "voter string, kind string, segments long, overlapping long, rate_in_kind double, rate_elsewhere double")


def found_kinds(scored: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(``key``, ``kind``) for each kind that a document scores at least the threshold on."""
    kinds = F.array(*[F.when(F.col(k) >= threshold, F.lit(k)) for k in KINDS])
    return scored.where(F.col(key).isNotNull()).select(key, F.explode(F.array_compact(kinds)).alias("kind")).distinct()


def source_rates(docs: DataFrame, scored: DataFrame, key: str = "doc_id", source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """For each source: its documents, and how many and which part of them reach the threshold for each kind and for any."""
    flags = scored.groupBy(key).agg(*[F.max((F.col(k) >= threshold).cast("int")).alias(k) for k in KINDS])
    joined = docs.select(key, source).join(flags, key, "left").fillna(0, list(KINDS))
    per = joined.groupBy(source).agg(F.count("*").alias("documents"), *[F.sum(k).alias(f"{k}_documents") for k in KINDS], F.sum(F.greatest(*KINDS)).alias("any_documents"))
    return per.select("*", *[(F.col(f"{k}_documents") / F.col("documents")).alias(f"{k}_rate") for k in (*KINDS, "any")])

"""Personal information in free text, found by a semi-Markov conditional random field.

A segmentation of a line is a sequence of non-overlapping candidate spans, each with a type;
everything between them is outside.  The score of a segmentation is the sum over its spans of
the weights of whole-span features (shape of the whole span, digit counts, list membership of
its parts, words on either side), and P(segmentation | line) is the softmax over all
segmentations of the line.  Candidate spans come from permissive generators of bounded length;
dynamic programming over the spans' ends chooses boundaries and types jointly.

The weights are trained here, by gradient ascent on the conditional log-likelihood, on lines that
``training_lines`` makes from fixed sentence frames; the number of lines is the parameter
``TRAINING_LINES``.  No outside model or data is used.

Spans are found on the consistent form of a text (see ``forms``), so disguises by look-alike
letters, full-width forms and invisible characters do not hide them; redaction maps the spans back and
leaves all other characters as they are.  Null texts give null (no rows in the found form); empty texts stay empty.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .forms import canonical_text, canonical_with_map

KINDS = ("name", "email", "phone", "id_number", "address")
PLACEHOLDERS = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}
TRAINING_LINES = 2400

# Given names and short forms in common use.
GIVEN = set("""
Alexander Andrew Anthony Benjamin Charles Christopher Daniel David Edward Frederick George Gregory Henry James John Joseph
Leonard Michael Nicholas Patrick Paul Peter Richard Robert Samuel Stephen Theodore Thomas William Abigail Alice Anna Catherine
Charlotte Deborah Dorothy Eleanor Elizabeth Emily Emma Helen Jane Jennifer Josephine Katherine Laura Linda Margaret Martha Mary Matilda
Patricia Rebecca Sarah Sophia Susan Susanna Victoria Alex Andy Tony Ben Chris Dan Dave Ed Ned Ted Fred Greg Jim Joe Len Mike Nick Pat
Rick Bob Rob Sam Steve Theo Tom Bill Will Abby Debbie Dot Nell Liz Beth Jenny Josie Kate Kathy Peggy Meg Maggie Tilly Becky Sandy Sue Vicky
Anneliese Björn Dörte Günther Heike Jürgen Käthe Lothar Rüdiger Sören Ute Volker Hans Klaus Uwe Ingrid Sabine Petra Monika Werner Wolfgang
Ursula Renate Karin Dieter Horst Jörg Jens Anja Birgit Gisela Helga Karl Otto Fritz
""".split())
SURNAMES_ZH = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻苏潘葛奚范彭郎鲁韦昌马苗方俞任袁柳鲍史唐费岑薛雷贺倪汤滕罗毕郝邬安常于傅皮卞齐康伍余顾孟黄穆萧尹姚邵汪祁毛狄米戴宋庞熊纪舒屈项祝董梁杜阮蓝闵席季贾路江童颜郭梅林钟徐邱骆高夏蔡田樊胡凌霍虞万柯管卢莫房丁邓石崔龚程邢裴陆翁段侯武刘龙叶白聂辛翟曾温廖"
DOUBLE_SURNAMES_ZH = "欧阳|司徒|上官|司马|诸葛|东方|皇甫|尉迟|公孙|慕容|令狐|夏侯"
GIVEN_ZH = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰建国志文博浩然子墨一鸣承泽嘉怡佩思远晓楠姝若溪雪松景行念慈少宛如梓涵雨桐海燕春梅红辉斌宇轩欣悦晨阳俊豪诗琪佳宁天翔龙飞云鹏凯琳婷倩颖慧美莲德福宏峰光荣新成永康庆祥瑞安立业家兴家国忠义信诚心语萱涵晴雅芝"
# Fixed values, for the training lines: other characters of given names, and characters of plain text.
OTHER_GIVEN_ZH = "丹洁莉萍玲林波亮鑫辰昊薇珍凤东山生根胜利勤财旺发全有才贵富进步长远青松柏岩峻岭川河湖泉清澈亚南北西冬夏秋艺舒菲蓉蕾蝶露莹珊瑚璐瑶琴韵诚恒毅锋锐钧铭锦钰"
PLAIN_ZH = "的了在是有和不这那也都已请见按被把用到上下前后内外货单价税率数量日期合同订仓库车间工具机器标签箱包装运送验收退换付款账户标准温度高低黄金石路方向时间安排项目经理检查更新通知附页表格样品材料零件电缆水管"
STREETS_EN = r"(?:Street|Str|St|Road|Rd|Avenue|Ave|Lane|Ln|Row|Close|Drive|Dr|Way|Court|Place|Terrace|Square|Crescent|Boulevard|Blvd|Gardens|Hill|Walk)"
LEGAL = r"(?:Ltd|Limited|Inc|Incorporated|Co|GmbH|AG|KG|LLC|PLC|Company|Corp)"
TRADES = set("Marine Modern Rural Urban Organic General Technical Optical Civil Thermal Medical Coastal Harbour Alpine Precision Industrial Textiles Foods Packaging Logistics Printing Ceramics Instruments Fasteners Supplies Tools Plastics Metals Group Services Trading".split())
NOT_NAMES = set("""The This That These Those Our Your Please Copies Copy Invoice Date Item Total Attn Tel Mob Mail Questions Queries Ledger Archive
Confidential Page Unit Flat No Order Quantity Amount Neither Nor Each An On In At By During Against Before After Because Despite With Under Write Within
January February March April May June July August September October November December Der Die Das Bitte Herr Frau Am Im Bei Weder Noch Den Dem Ein Eine Vor Zum Zur
Januar Februar März Mai Juni Juli Oktober Dezember Rechnung Datum Purchasing Manager Site Engineer Export Coordinator Quality Inspector Finance Director Dispatch Clerk
Street Lane Road Avenue Row Close Drive Firmware Account Several Instalment Extraction Expenditure Nobody Payment Reminder Checked Carried Statement""".split())

_EMAIL = re.compile(r"[A-Za-z0-9äöüß][A-Za-z0-9äöüß_.+\-]*\s?(?:@|\(\s?(?:at|@)\s?\)|\[\s?(?:at|@)\s?\]|\{at\}|\sat(?=\s[A-Za-z0-9\-]+\sdot\s))\s?[A-Za-z0-9][A-Za-z0-9\-]*(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s|\sDOT\s)\s?[A-Za-z0-9][A-Za-z0-9\-]*)+", re.I)
_NUMBER = re.compile(r"(?<![A-Za-z0-9])(?:\+\s?|\(\+?)?\d(?:[\d \-/.()]{4,22}\d)(?:\s?(?:ext\.?|extension|x|转|App\.|Durchwahl|分机)\s?\d{1,5})?", re.I)
_ID = re.compile(r"(?<![A-Za-z0-9])(?:\d{6}[ \-]?\d{8}[ \-]?\d{3}[\dXx]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z][A-Z0-9]{2}\d[A-Z0-9]{4,7}|[A-Z]{1,2}\d{6,9}[A-Z]?|\d{3}-\d{2}-\d{4})(?![A-Za-z0-9])")
_ADDRESS_EN = re.compile(rf"(?:(?:Flat|Unit|Apt|Apartment|Suite|Room)\.? ?\w{{1,4}},? )?(?:No\. ?)?\b\d{{1,4}} ?[A-Za-z]?,? (?:[A-Z][a-z']+ ){{1,2}}{STREETS_EN}\b\.?")
_ADDRESS_DE = re.compile(r"\b(?:[A-ZÄÖÜ][a-zäöüß]+ |(?:Am|An der|Im|Zur|Zum|Auf dem) )?[A-ZÄÖÜ][a-zäöüß\-]*(?:[Ss]traße|[Ss]trasse|[Ss]tr\.|[Gg]asse|[Ww]eg|[Aa]llee|[Pp]latz|ring|damm|ufer|steig|markt|graben) ?\d{1,4}(?: ?[a-f]\b)?")
_ADDRESS_ZH = re.compile(r"(?:[一-鿿]{2,3}[省])?(?:[一-鿿]{2}[市县])?(?:[一-鿿]{2}[区县镇])?(?:(?![在住由位于至和与,])[一-鿿]){2,4}?(?:大道|路|街|道|巷|胡同) ?\d{1,5} ?(?:弄 ?\d{1,4} ?)?号(?:[一-鿿]{2,6}(?:楼|大厦|中心|园|座|厦))?(?:\d{1,3}[楼层])?(?:\d{1,7}室?)?")
_LEAD_ZH = re.compile(r"(?:.{0,3}(?:位于|现住|住在|地址|送至|寄至|寄往)|[在住至从由往到于、])(?=[一-鿿]{2,})")
_NAME_PART = r"(?:[A-ZÄÖÜ][a-zäöüß]+|[A-ZÄÖÜ]{3,})"
_NAME_EN = re.compile(rf"(?<![A-Za-z0-9@.\-_+])(?:{_NAME_PART}, {_NAME_PART}(?: [A-Z]\.)?|{_NAME_PART}(?: [A-Z]\.?)? {_NAME_PART}|[A-Z]\. ?(?:[A-Z]\. ?)?{_NAME_PART})(?![a-zA-Z0-9@_])")
_NAME_ZH = re.compile(rf"(?=((?:{DOUBLE_SURNAMES_ZH}|[{SURNAMES_ZH}])[一-鿿]{{1,2}}))")
_SPACED_ZH = re.compile(r"(?<=[一-鿿]) (?=[一-鿿])")
_DIGIT = re.compile(r"\d")
_LEFT_WORD = re.compile(r"([A-Za-zÄÖÜäöüß.@]+|[一-鿿]{1,3})[ :,，：]*$")
_RIGHT_WORD = re.compile(r"[ ,，]*([A-Za-zÄÖÜäöüß%€]+|[一-鿿]{1,2})")


def candidates(text: str) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(start, end, type, features) of every candidate span of a text in its consistent form."""
    out: list[tuple[int, int, str, tuple[str, ...]]] = []
    digits = _DIGIT.search(text) is not None
    low = text.lower()
    if "@" in text or "at" in low:
        if "." in text or "dot" in low:
            for m in _EMAIL.finditer(text):
                s = m[0]
                tail = re.split(r"\.|\sdot\s|[(\[{]dot[)\]}]", s, flags=re.I)[-1].strip()
                f = ["email", "sign" if "@" in s else "word", "tail-alpha" if tail.isalpha() and len(tail) >= 2 else "tail-odd", "spaced" if " " in s else "tight"]
                out.append((m.start(), m.end(), "email", tuple("email:" + x for x in f)))
    if digits:
        for m in _ID.finditer(text):
            out.append((m.start(), m.end(), "id_number", _id_features(text, m.start(), m.end())))
        for m in _NUMBER.finditer(text):
            a, b = m.span()
            n = sum(map(str.isdigit, m[0]))
            if 7 <= n <= 19:
                out.append((a, b, "phone", _phone_features(text, a, b, m[0])))
        for pattern, shape in ((_ADDRESS_EN, "en"), (_ADDRESS_DE, "de")):
            for m in pattern.finditer(text):
                out.append((m.start(), m.end(), "address", ("address:" + shape,)))
        if "号" in text:
            for m in _ADDRESS_ZH.finditer(text):
                lead = _LEAD_ZH.match(m[0])
                out.append((m.start(), m.end(), "address", ("address:zh", "address:zh-lead" if lead else "address:zh-plain")))
                if lead:
                    out.append((m.start() + lead.end(), m.end(), "address", ("address:zh", "address:zh-plain")))
    if text.isascii() or any("A" <= c <= "Z" for c in text):
        for m in _NAME_EN.finditer(text):
            a, b = m.span()
            if (f := _name_features(text, a, b, m[0])) is not None:
                out.append((a, b, "name", f))
            # the pattern may have taken a capitalised word that stands before the name
            if " " in m[0]:
                shift = a + m[0].index(" ") + 1
                if (again := _NAME_EN.match(text, shift)) and (f := _name_features(text, shift, again.end(), again[0])) is not None:
                    out.append((shift, again.end(), "name", f))
    if not text.isascii():
        for m in _NAME_ZH.finditer(text):
            a, b = m.start(1), m.end(1)
            out += _chinese_names(text, a, b)
    return out


def _left(text: str, a: int) -> str:
    m = _LEFT_WORD.search(text[max(0, a - 16) : a])
    return m[1].lower() if m else ("start" if not text[:a].strip() else "mark")


def _right(text: str, b: int) -> str:
    m = _RIGHT_WORD.match(text[b : b + 14])
    return m[1].lower() if m else ("end" if not text[b:].strip() else "mark")


# Words before or after a span that tell its type, by class.
_CUES = {
    "tel": {"tel", "tel.", "telefon", "phone", "mob.", "mob", "mobile", "t", "fax", "ring", "call", "to", "unter", "oder", "话", "电话", "致电", "咨询电话", "手机", "传真", "questions", "at", "rufen", "anruf", "call to", "机"},
    "id": {"number", "numbered", "nummer", "gave", "identification", "passport", "ausweis", "证", "份证", "身份证", "号码", "件号码", "id", "identity", "personalausweis", "insurance", "保号", "照", "护照"},
    "reference": {"order", "reference", "account", "konto", "auftragsnummer", "ersetzt", "replaces", "vat", "no.", "serial", "invoice", "firmware", "version", "sheet", "单号", "订单号", "代替", "账号", "及账号", "行及账", "账户", "号", "识别号", "序列号", "版本为", "账", "fassung", "vom", "konto-nr"},
    "person": {"contact", "attn", "by", "with", "to", "driver", "and", "hd.", "an", "von", "fahrer", "und", "mit", "call", "manager", "start", "联系", "抄送", "送", "由", "司机", "收款人", "款人", "复核", "开票人", "票人", "和", "已经和", "与", "申请人", "人", "机", "applicant", "through"},
    "place": {"from", "visiting", "aus", "nach", "in", "at", "near", "来自"},
}
# Words whose second character is no surname.
_NOT_SURNAMES = {"由于", "对于", "关于", "位于", "处于", "任何", "如何", "为何", "几何", "平方", "地方", "双方", "一方", "安全", "完全"}
_CUES["zh-after"] = {"谈过", "在", "签收", "签", "先生", "女士", "和", "转", "说"}


def _cue(word: str) -> list[str]:
    hits = [k for k, words in _CUES.items() if word in words or (len(word) > 1 and not word.isascii() and (word[-2:] in words or word[-1:] in words))]
    return hits or ["none"]


def _id_features(text: str, a: int, b: int) -> tuple[str, ...]:
    s = text[a:b]
    plain = s.replace(" ", "").replace("-", "")
    if len(plain) == 18 and plain[:17].isdigit():
        year, month, day = plain[6:10], plain[10:12], plain[12:14]
        shape = "zh18" if "1900" <= year <= "2025" and "01" <= month <= "12" and "01" <= day <= "31" else "zh18-odd"
    elif re.fullmatch(r"[A-Z]\d{8}", plain):
        shape = "letter8"
    elif re.fullmatch(r"[A-Z]{2}\d{6}[A-Z]", plain):
        shape = "insurance"
    elif re.fullmatch(r"[A-Z]{2}\d{2,}", plain):
        shape = "code"
    elif re.fullmatch(r"\d{9}", plain):
        shape = "three-two-four"
    else:
        shape = "mixed" if 9 <= len(plain) <= 10 else "mixed-odd"
    near = "id-near" if re.search(r"(?i)identi|ausweis|passport|reisepass|身份证|护照|证件|insurance|versicherung|社保", text[max(0, a - 40) : b + 40]) else "id-far"
    company = ["company-no"] if re.search(r"(?i)vat|ust|tax|识别号|steuer", text[max(0, a - 16) : a]) else []
    return tuple("id:" + x for x in [shape, near, *(f"left-{c}" for c in _cue(_left(text, a)))] + company + [f"{shape}/{near}"])


def _phone_features(text: str, a: int, b: int, s: str) -> tuple[str, ...]:
    body = re.split(r"(?i)\s?(?:ext|x|转|App|Durchwahl|分机)", s)[0]
    d = "".join(filter(str.isdigit, body))
    f = []
    plus = s.lstrip("( ").startswith("+")
    if plus:
        f.append("plus")
    elif d.startswith("00"):
        f.append("double-zero")
    elif d.startswith("0"):
        f.append("zero" + ("-mark" if re.search(r"[ \-/()]", body) else ""))
    elif len(d) == 11 and re.match(r"1[3-9]", d):
        f.append("mobile")
    elif len(d) == 13 and re.match(r"861[3-9]", d) and "(" in s:
        f.append("mobile-86")
    elif re.fullmatch(r"\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}", body.strip()):
        f.append("three-three-four")
    else:
        f.append("odd")
    if re.search(r"(?i)ext|x\d|转|分机", s):
        f.append("extension")
    f.append("length-" + ("short" if len(d) < 9 else "usual" if len(d) <= 13 else "long"))
    if re.search(r"(?:19|20)\d\d[\-./]\d\d?[\-./]\d\d?", s) or re.search(r"\d\d?\.\d\d?\.(?:19|20)\d\d", s):
        f.append("date")
    if re.fullmatch(r"[\d.]+", body) and body.count(".") in (1, 3) and "-" not in body:
        f.append("decimal")
    if re.search(r"\d{4} \d{4} \d{4}", s):
        f.append("card")
    left = _left(text, a)
    f += [f"left-{c}" for c in _cue(left)]
    before = text[a - 1 : a]
    if before and (before.isalnum() and before.isascii() or before in "-/$£€¥#.,"):
        f.append("glued-left")
    after = text[b : b + 1]
    if after and (after.isascii() and after.isalnum() or after in "%€" or text[b : b + 2] in (" E",)):
        f.append("glued-right")
    if text[b : b + 1] in "," and text[b + 1 : b + 2].isdigit():
        f.append("amount")
    return tuple("phone:" + x for x in f)


def _name_features(text: str, a: int, b: int, s: str) -> tuple[str, ...] | None:
    parts = re.findall(r"[^\s,.]+", s)
    words = [p for p in parts if len(p) > 1]
    title = [p if not p.isupper() else p.capitalize() for p in words]
    if not words or any(p in NOT_NAMES or p in TRADES for p in title):
        return None
    given = [p in GIVEN for p in title]
    right = _right(text, b)
    if re.match(rf",? (?:[A-Z]\w+ ){{0,3}}{LEGAL}\b", text[b : b + 40]) or right.capitalize() in TRADES:
        return ("name:company",)
    f = []
    if "," in s:
        f.append("comma-given" if given[-1] else "comma")
    elif len(words) == 1:
        f.append("initial" + ("-upper" if words[0].isupper() else ""))
    else:
        f.append(f"given-{int(given[0])}{int(given[-1])}")
    if words[-1].isupper() and not words[0].isupper():
        f.append("upper-last")
    f += [f"left-{c}" for c in _cue(_left(text, a))]
    if a == 0 and b == len(text):
        f.append("alone" + ("-given" if any(given) else ""))
    return tuple("name:" + x for x in f)


def _chinese_names(text: str, a: int, b: int) -> list[tuple[int, int, str, tuple[str, ...]]]:
    double = re.match(DOUBLE_SURNAMES_ZH, text[a:b])
    first = 2 if double else 1
    out = []
    left = text[max(0, a - 5) : a].rstrip(" :")[-3:] if text[a - 1 : a] in (" ", ":") else text[max(0, a - 3) : a]
    cues = [f"left-{c}" for c in _cue(left)] if left.strip() else ["left-start"]
    b = min(len(text), a + first + 2)
    for end in range(a + first + 1, b + 1):
        given = text[a + first : end]
        if not all("一" <= c <= "鿿" for c in given):
            continue
        known = sum(c in GIVEN_ZH for c in given)
        if text[max(0, a - 1) : a + 1] in _NOT_SURNAMES:
            continue
        listed = "all" if known == len(given) else "some" if known else "none"
        right = text[end : end + 2]
        f = [f"zh-{'double' if double else 'single'}-{len(given)}", *("zh-" + c for c in cues), "zh-right-cue" if right in _CUES["zh-after"] or right[:1] in ("在", "和", "谈") else "zh-right-end" if not right.strip() else "zh-right-mark" if not "一" <= right[0] <= "鿿" else "zh-right-other"]
        f.append(f"{f[0]}/{f[-1]}")
        # the list of given-name characters is evidence beside the cues; it decides nothing by itself
        person = "cue" if "left-person" in cues else "start" if cues == ["left-start"] else "other"
        f += [f"zh-listed-{listed}", f"zh-listed-{listed}/{person}", f"zh-listed-{listed}/{person}/{f[-1].rpartition('/')[2]}"]
        if re.search(r"公司|集团|银行|支行", text[end : end + 14]) and not re.search(r"[,，。:]", text[end : end + 4]):
            f.append("zh-company")
        out.append((a, end, "name", tuple("name:" + x for x in f)))
    return out


def _chain(spans: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """For spans sorted by end: (index of the last span that ends at or before each span's start) as counts."""
    ends = [s[1] for s in spans]
    import bisect

    return [(i, bisect.bisect_right(ends, s[0], 0, i)) for i, s in enumerate(spans)]


def decode(found: list[tuple[int, int, str, tuple[str, ...]]], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best segmentation: dynamic programming over the candidate spans in order of their ends."""
    scored = []
    for a, b, kind, f in found:
        score = sum(weights.get(x, 0.0) for x in f) + weights.get("bias:" + kind, 0.0)
        if score > 0:
            scored.append((a, b, kind, score))
    if len(scored) < 2:
        return [x[:3] for x in scored]
    scored.sort(key=lambda x: (x[1], x[0], x[2]))
    best, take = [0.0], [False]
    before = [j for _, j in _chain([x[:3] for x in scored])]
    for i, x in enumerate(scored):
        with_it = best[before[i]] + x[3] + 1e-6 * (x[1] - x[0])
        take.append(with_it > best[-1])
        best.append(max(best[-1], with_it))
    out, i = [], len(scored)
    while i:
        if take[i]:
            out.append(scored[i - 1][:3])
            i = before[i - 1]
        else:
            i -= 1
    return out[::-1]


def _gradient(found: list, gold: set[tuple[int, int, str]], weights: dict[str, float]) -> tuple[float, dict[str, float]]:
    """Log-likelihood of the gold segmentation and its gradient, by the forward-backward recursion over segmentations."""
    spans = sorted(((a, b, k, (*f, "bias:" + k)) for a, b, k, f in found), key=lambda x: (x[1], x[0], x[2]))
    if not spans:
        return 0.0, {}
    scores = [sum(weights.get(x, 0.0) for x in s[3]) for s in spans]
    before = [j for _, j in _chain([s[:3] for s in spans])]
    forward = [0.0]
    for i, s in enumerate(scores):
        forward.append(_add(forward[-1], forward[before[i]] + s))
    after = [0.0] * (len(spans) + 1)  # log sum over what may follow the first i spans
    back = [-math.inf] * (len(spans) + 1)
    back[-1] = 0.0
    for i in range(len(spans), 0, -1):
        back[i - 1] = _add(back[i - 1], back[i])
        back[before[i - 1]] = _add(back[before[i - 1]], back[i] + scores[i - 1])
    total = forward[-1]
    likelihood, gradient = -total, {}
    for i, (a, b, k, f) in enumerate(spans):
        is_gold = (a, b, k) in gold
        if is_gold:
            likelihood += scores[i]
        p = math.exp(forward[before[i]] + scores[i] + back[i + 1] - total)
        for x in f:
            gradient[x] = gradient.get(x, 0.0) + is_gold - p
    del after
    return likelihood, gradient


def _add(a: float, b: float) -> float:
    if a == -math.inf or b == -math.inf:
        return max(a, b)
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


# Sentence frames of the training lines; what stands in braces is filled in.
FRAMES = """
Please contact {name} at {email} if anything is missing.|Copies go to {name} and {name} as usual.|I spoke with {name} about the {noun}.
The driver, {name}, showed an identity document numbered {id} at the gate.|The parcel was signed for by {name} at {address} in the afternoon.
The applicant gave {id} as identification and {address} as residence.|For questions ring {phone} during office hours.|Our new delivery entrance is at {address} behind the ramp.
Attn {name}|{name}|{address}|{address}, {town}|Tel {phone}|Mob. {phone}|T: {phone}|E-mail {email}|mail {email}|E: {email}|{phone}|{email}|Questions: {phone}|Queries by mail: {email}
Write to {email} or a short call to {phone} is sufficient.|{email} or a short call to {phone} is sufficient.|{phone} is sufficient.|by {name} at {address} in|{id} as identification and
Bitte wenden Sie sich an {name} unter {email} oder {phone}.|z. Hd. {name}|Der Fahrer zeigte den Ausweis mit der Nummer {id} vor.|Nummer {id} vor. Die {noun}|Ausweis mit der Nummer {id} vor.
Fragen beantworten wir unter {phone} gern.|Das Paket wurde von {name} in der {address} angenommen.|{deaddress}|Per Mail: {email}|Telefon {phone}|Kopien gehen an {name} und {name}.
如有遗漏请联系{zhname},邮箱{email}。|抄送{zhname}和{zhname}。|我已经和{zhname}谈过缺少的证书和未结余额。|司机{zhname}在门口出示证件,号码{zhid}。|申请人身份证{zhid},现住{zhaddress}。
包裹由{zhname}在{zhaddress}签收。|由{zhname}在|新的收货入口位于{zhaddress},请从后门进入。|咨询电话{zhphone},工作时间均可拨打。|收款人:{zhname} 复核:{zhname} 开票人:{zhname}|{zhname}
地址、电话:{zhaddress} {zhphone}|电话:{zhphone}|Tel {zhphone}|地址:{zhaddress}|身份证号:{zhid}|口出示证件,号码{zhid}。|{zhphone}|请发邮件至{email}或致电{zhphone}。|{zhaddress}|{zhname}谈过缺少的证书|{zhname},邮箱|抄送{zhname}和
The {noun} ordered by {company} under reference {code} left on {date}.|Bill to: {company}|Payment of {money} for invoice {code} is overdue since {date}.|Account {account} is held with the merchant bank.
Order reference {order} replaces {order}.|Auftragsnummer {order} ersetzt {order}.|Firmware {version} is installed.|VAT no. {vat}|{noun} 14 127.25 1781.50|Quantity 40 @ 12.50 each, packing included.|reading identification such as {code} on the door.
On {date} the {noun} was replaced for {money}.|{company}|Total due {money}|Purchasing Manager|Site Engineer|Export Coordinator|Warehouse Supervisor|{job}|{job}|{job}|Artikel Menge Preis Betrag|ARCHIVE VOLUME {code}|Archive volume {code}|{denoun} {denoun} prüften Angebote|obwohl {denoun} {denoun} auf dem Regal verzögerten|Die {denoun} von {denoun} {denoun} wurde|{denoun} {denoun}|Ledger of incoming goods, {town}|The Lane and Street register of routes was reprinted.|after visiting {town}.
Die Rechnung {code} über {money} ist seit dem {date} überfällig.|Der Vertrag mit {company} läuft am {date} aus.|The agreement with {company} expires on {date}.|{company} – internal copy|entered under inventory number {code}.
纳税人识别号:{zhtax}|开户行及账号:郁陵商业银行霁陵支行 {zhaccount}|订单号{zhorder}代替{zhorder}。|发票号码:{zhlong}|购买方名称:{zhcompany}|账号{account},开户行为商业银行。|扫描仪固件版本为{version}。|发票{code}的货款{money}元自{date}起逾期。
路线表和街道名册已经重新印刷。|周例会上,采购员分拣了捆包{code}。|{zhcompany}于{date}提交的订单{code}已从仓库发出,共146箱。|单价 @ 12.50,含包装费。|流程和周围的方向都在台账里。|与{zhcompany}签订的合同将于{date}到期。|Invoice {code}|{zhaccount}|{order} replaces
收款人:{zhname}|联系{zhname}|请联系{zhname}。|复核:{zhname} 电话:{zhphone}|司机{zhname}签收|周末仓库关闭,请于周一再来。|路线和方向都已确认。|金额合计不含税。|安装费用另计,详见附页。|高度和温度须符合标准,颜色为黄色。|马达和水管已更换。
常用的工具放在石台上,由门卫看管。|时间安排见通知,地点和平时相同。|程序已经更新,请重新安装。|江边的仓库和车间已满。|项目经理和安全员到场。|单价和金额由双方确认。|请联系车间和仓库。|货物由金属架固定。|负责人于当天签字。|{zhplain}。|{zhplain},{zhplain}。|{zhplain}和{zhplain}
{zhtail}。{zhplain}|{zhtail},{zhplain}|{zhtail}|{zhtail}为{money}元|{zhplain}和{zhtail}在{zhplain}|{zhplain},{zhtail}。|{zhplain}{zhtail}|{zhtail}。
""".strip().replace("\n", "|").split("|")


def training_lines(count: int = TRAINING_LINES, seed: int = 7) -> Iterator[tuple[str, set[tuple[int, int, str]]]]:
    """Lines with their gold spans, made from the frames."""
    r = random.Random(seed)
    given = sorted(GIVEN)
    syllables = "bram corn dell farn gard hold kell lorr mead nor pend quill rusk sel tarn wick vel dor gim".split()
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    capital = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") for _ in range(n))
    surname = lambda: (r.choice(syllables) + r.choice(syllables)).capitalize()
    town = lambda: (r.choice(syllables) + r.choice(["mere", "stead", "combe", "hurst", "thorpe"])).capitalize()

    def name() -> str:
        g, s = r.choice(given) if r.random() < 0.93 else surname(), surname()
        return r.choice([f"{g} {s}"] * 5 + [f"{s}, {g}", f"{g[0]}. {s}", f"{g} {capital(1)}. {s.upper()}", f"{g} {s.upper()}", f"{s.upper()} {g}"])

    def email() -> str:
        user = r.choice([f"{r.choice(given)}.{surname()}", f"info", f"{surname()}_{digit(2)}", f"{r.choice(given)}+inv", "ap"]).lower()
        host = (r.choice(syllables) + r.choice(syllables)).lower() + r.choice(["", "-group"])
        tail = r.choice(["test", "example", "invalid", "mail.example"])
        s = r.choice([f"{user}@{host}.{tail}"] * 6 + [f"{user} @ {host}.{tail}", f"{user} (at) {host} dot {tail}", f"{user}[at]{host}.{tail}", f"{user} at {host} dot {tail.replace('.', ' dot ')}"])
        return s.upper() if r.random() < 0.08 else s

    def phone() -> str:
        return r.choice([f"+44 7700 {digit(6)}", f"0044 20 {digit(4)} {digit(4)}", f"(020) 7946 {digit(4)}", f"{r.randint(2, 9)}{digit(2)}-555-{digit(4)}", f"{r.randint(2, 9)}{digit(2)}.555.{digit(4)} ext. {digit(3)}", f"030/{digit(8)}", f"+49 30 {digit(5)} {digit(3)}", f"0049 (0)171 {digit(7)}"])

    def zhname() -> str:
        """Listed given-name characters mostly; any others, too, so that the list is no condition."""
        first = r.choice(SURNAMES_ZH) if r.random() < 0.85 else r.choice(DOUBLE_SURNAMES_ZH.split("|"))
        pool = GIVEN_ZH if r.random() < 0.6 else OTHER_GIVEN_ZH
        return first + r.choice(pool) + (r.choice(GIVEN_ZH if r.random() < 0.5 else pool) if r.random() < 0.85 else "")

    def zhphone() -> str:
        m = f"1{r.choice('3456789')}{digit(9)}"
        return r.choice([m, f"{m[:3]} {m[3:7]} {m[7:]}", f"+86-{m[:3]}-{m[3:7]}-{m[7:]}", f"(86){m[:7]} {m[7:]}", f"0{digit(2)}-{r.randint(2, 8)}{digit(7)}", f"(0{digit(3)}){r.randint(2, 8)}{digit(3)} {digit(4)} 转 {digit(3)}"])

    def address() -> str:
        road = f"{r.choice(['Foundry', 'Tanner', 'Juniper', 'Harbour', 'Mill', 'Station'])} {r.choice(['Street', 'St.', 'Road', 'Rd', 'Lane', 'Row', 'Close', 'Avenue', 'Drive'])}"
        return r.choice([f"{r.randint(1, 299)} {road}"] * 3 + [f"No. {r.randint(1, 299)} {road}", f"Flat {digit(1)}A, {r.randint(1, 299)} {road}", f"Unit {digit(1)}, {r.randint(1, 299)} {road}"])

    def zhaddress() -> str:
        return r.choice(["", "翎岭市", "砚川县", "桐岭市沐泽区"]) + r.choice(["长岸路", "青禾街", "银杏大道", "竹影巷"]) + f"{r.randint(1, 900)}" + r.choice(["号", "号", f"弄{r.randint(1, 60)}号", "号云启中心3楼", f"号国瑞大厦14楼{digit(3)}室"])

    def zhid() -> str:
        s = f"99{digit(4)}{r.randint(1950, 2008)}{r.randint(1, 12):02}{r.randint(1, 28):02}{digit(3)}{r.choice('0123456789X')}"
        return s if r.random() < 0.75 else f"{s[:6]} {s[6:14]} {s[14:]}"

    company = lambda: f"{surname()}{r.choice(syllables)} {r.choice(sorted(TRADES))} {r.choice(['Textiles', 'Foods', 'Ceramics', 'Printing'])} {r.choice(['Ltd', 'Inc.', 'Co.', 'GmbH'])}"
    order = lambda: f"2024-{digit(3)}-{digit(4)}"
    fill = {
        "name": (name, "name"), "zhname": (zhname, "name"), "zhplain": (lambda: "".join(r.choice(PLAIN_ZH) if r.random() < 0.85 else r.choice(SURNAMES_ZH) for _ in range(r.randint(4, 9))), ""),
        "zhtail": (lambda: r.choice(SURNAMES_ZH) + "".join(r.choice(PLAIN_ZH) for _ in range(r.choice((1, 1, 2, 2, 3, 5)))), ""),
        "email": (email, "email"), "phone": (phone, "phone"), "zhphone": (zhphone, "phone"), "address": (address, "address"), "zhaddress": (zhaddress, "address"),
        "deaddress": (lambda: r.choice(["Rosenstr.", "Lindengasse", "Gartenweg", "Bahnhofstraße"]) + f" {r.randint(1, 199)}" + r.choice(["", " b"]), "address"),
        "id": (lambda: r.choice([f"{r.choice('NPK')}{digit(8)}", f"{capital(2)} {digit(2)} {digit(2)} {digit(2)} {capital(1)}", f"L{capital(1)}{digit(2)}{capital(1)}{digit(4)}" + r.choice(["D", ""])]), "id_number"), "zhid": (zhid, "id_number"),
        "noun": (lambda: r.choice(["missing certificates", "open balance", "cable gland", "Waage", "storage rack", "toner cartridge"]), ""), "town": (town, ""),
        "job": (lambda: r.choice("Warehouse Depot Export Customs Payroll Machine Senior Night Leitende Technische".split()) + " " + r.choice("Supervisor Clerk Planner Foreman Operator Leiterin Buchhalter Auditor".split()), ""),
        "denoun": (lambda: r.choice("Packer Register Verblasste Drucker Kisten Planen Quittungen Prüfer Träger Lehrlinge Artikel Menge Preis Umschläge Einkäufer Doppelte".split()), ""), "company": (company, ""),
        "code": (lambda: r.choice([f"{capital(2)}-{digit(5)}", f"{capital(2)}{digit(3)}/{digit(2)}"]), ""), "date": (lambda: r.choice([f"2024-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 28)} June 2023", f"{r.randint(1, 28):02}.0{r.randint(1, 9)}.2025", f"2023年{r.randint(1, 12)}月{r.randint(1, 28)}日"]), ""),
        "money": (lambda: r.choice([f"${r.randint(1, 99)},{digit(3)}.{digit(2)}", f"EUR {digit(4)}.{digit(2)}", f"{digit(6)}.{digit(2)}", f"{r.randint(1, 99)}.{digit(3)},{digit(2)} Euro"]), ""), "account": (lambda: " ".join(digit(4) for _ in range(4)) if r.random() < 0.5 else digit(16), ""),
        "order": (order, ""), "version": (lambda: f"{digit(2)}.{digit(1)}.{digit(2)}.{digit(1)}", ""), "vat": (lambda: capital(2) + digit(9), ""), "zhtax": (lambda: "91" + digit(15) + capital(1), ""), "zhaccount": (lambda: digit(19), ""), "zhorder": (lambda: "2024" + digit(7), ""), "zhlong": (lambda: digit(20), ""),
        "zhcompany": (lambda: r.choice(["砚川", "栖湾", "黛陵", "翎浦"]) + r.choice(GIVEN_ZH) + r.choice(GIVEN_ZH) + r.choice(["工业设备", "智能物流", "精密陶瓷", "环保材料"]) + "有限公司", ""),
    }
    for i in range(count):
        frame = FRAMES[i % len(FRAMES)]
        line, gold, at = "", set(), 0
        for m in re.finditer(r"\{(\w+)\}", frame):
            line += frame[at : m.start()]
            make, kind = fill[m[1]]
            value = make()
            if kind:
                gold.add((len(line), len(line) + len(value), kind))
            line += value
            at = m.end()
        yield line + frame[at:], gold


@functools.cache
def train(count: int = TRAINING_LINES, rounds: int = 14, rate: float = 0.25, decay: float = 1e-4) -> dict[str, float]:
    """Weights by stochastic gradient ascent (AdaGrad steps) on the conditional log-likelihood of the training lines."""
    data = [(candidates(line), gold) for line, gold in training_lines(count)]
    data = [(found, gold) for found, gold in data if found]
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    r = random.Random(3)
    for _ in range(rounds):
        r.shuffle(data)
        for found, gold in data:
            for x, g in _gradient(found, gold, weights)[1].items():
                g -= decay * weights.get(x, 0.0)
                squares[x] = squares.get(x, 0.0) + g * g
                weights[x] = weights.get(x, 0.0) + rate * g / math.sqrt(1e-8 + squares[x])
    return weights


def find(text: str, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) in a text that is in its consistent form."""
    found = candidates(text)
    return decode(found, weights) if found else []


def found_kinds(blocks: DataFrame, key: str = "block_id", text: str = "text") -> DataFrame:
    """(``key``, ``kind``): one row for every kind of which a text holds an item.  Equal texts of a batch are worked on once; the last
    step removes repeated rows.  Rows with a null key or text give nothing."""
    weights = train()
    schema = T.StructType([T.StructField(key, blocks.schema[key].dataType), T.StructField("kind", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            kinds: list[str] = []
            seen: dict[str, list[str]] = {}
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = seen.get(t)
                if own is None:
                    own = seen[t] = sorted({k for _, _, k in find(canonical_text(t), weights)})
                for k in own:
                    rows.append(i)
                    kinds.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string())], names=[key, "kind"])

    return blocks.where(f"`{key}` is not null and `{text}` is not null").select(key, text).mapInArrow(run, schema).distinct()


def redact_text(text: str | None, weights: dict[str, float]) -> str | None:
    """The text with each item replaced by its placeholder and every other character as it was; lines are worked on one by one."""
    if not text:
        return text
    lines = text.split("\n")
    for n, line in enumerate(lines):
        found = find(canonical_text(line), weights)
        if not found:
            continue
        _, start, end = canonical_with_map(line)
        for a, b, kind in reversed(found):
            line = line[: start[a]] + PLACEHOLDERS[kind] + line[end[b - 1] :]
        lines[n] = line
    return "\n".join(lines)


def redact(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and ``redacted`` of every row; null stays null, empty stays empty, repeated rows are kept."""
    weights = train()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("redacted", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str | None, str | None] = {}
            out = []
            for t in batch.column(1).to_pylist():
                if t not in seen:
                    seen[t] = redact_text(t, weights)
                out.append(seen[t])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "redacted"])

    return df.select(key, text).mapInArrow(run, schema)

"""Column expressions for cleaning, typing and checking strings.  All of them stay inside Catalyst
except ``dedupe_key``, whose compatibility normalisation has no built-in."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK_CELL = " "
_SPACE = r"[\s\x1c-\x1f]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_u(c: Column | str) -> Column:
    """Blanks of any kind removed at both ends (Unicode blanks and U+001C to U+001F)."""
    return F.regexp_replace(_c(c), rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip_u(c), F.lit("")) == ""


def digits_of(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?U)\D+", "")


def normalize_phone(c: Column | str) -> Column:
    """Digits only, a leading plus kept."""
    s = strip_u(c)
    return F.concat(F.when(F.startswith(s, F.lit("+")), "+").otherwise(""), digits_of(s))


def is_valid_phone(c: Column | str) -> Column:
    return F.length(digits_of(c)).between(7, 18)


def normalize_email(c: Column | str) -> Column:
    return F.lower(strip_u(c))


def is_valid_email(c: Column | str) -> Column:
    """One @ with something before it and a dotted domain without empty labels after it, no blanks."""
    s = normalize_email(c)
    parts = F.split(s, "@", -1)
    labels = F.split(F.get(parts, F.lit(1)), r"\.", -1)
    return F.coalesce((F.size(parts) == 2) & ~s.rlike(rf"(?U){_SPACE}") & (F.get(parts, F.lit(0)) != "") & (F.size(labels) >= 2) & F.forall(labels, lambda x: x != ""), F.lit(False))


def normalize_company(c: Column | str) -> Column:
    return strip_u(c)


_NUMBER = r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$|^[+-]?(nan|inf|infinity)$"


def parse_number(c: Column | str, thousands: str = ",", decimal: str = ".", strip_currency: bool = True) -> Column:
    """A double, or null where the cleaned string is no number: sign peeled, currency signs and thousands separators removed."""
    s = strip_u(c)
    negative = F.startswith(s, F.lit("-"))
    s = F.when(negative, F.substr(s, F.lit(2))).otherwise(s)
    if strip_currency:
        s = F.regexp_replace(strip_u(s), "^[¥￥$€£]+|[¥￥$€£]+$", "")
    if thousands:
        s = F.replace(s, F.lit(thousands), F.lit(""))
    if decimal == ",":
        s = F.replace(s, F.lit(","), F.lit("."))
    s = strip_u(s)
    number = F.when(s.rlike(_NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(negative, -number).otherwise(number)


_STRPTIME = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%y": "yy", "%b": "MMM", "%B": "MMMM"}


def java_pattern(strptime: str) -> str:
    """A strptime format as a Java pattern; other letters are quoted."""
    out = ""
    for part in re.split(r"(%[A-Za-z%])", strptime):
        if part in _STRPTIME:
            out += _STRPTIME[part]
        elif part == "%%":
            out += "%"
        else:
            out += re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", part)
    return out


def parse_date(c: Column | str, formats: list[str]) -> Column:
    """The date by the first format that fits, else null."""
    s = strip_u(c)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(java_pattern(f)))) for f in formats], F.lit(None).cast("date"))


def _dedupe_key(value: str | None) -> str | None:
    return None if value is None else "".join(unicodedata.normalize("NFKC", value).split()).lower()


@F.pandas_udf(T.StringType())
def dedupe_key(values: pd.Series) -> pd.Series:
    """Compatibility form without blanks, in lower case; once for each distinct value of a batch."""
    codes, distinct = pd.factorize(values)
    return pd.Series([_dedupe_key(x) for x in distinct] + [None], dtype=object).iloc[codes].reset_index(drop=True)


def email_equivalent(a: Column, b: Column) -> Column:
    """Equal keys; blanks never equal anything."""
    x, y = F.lower(F.regexp_replace(a, rf"(?U){_SPACE}", "")), F.lower(F.regexp_replace(b, rf"(?U){_SPACE}", ""))
    return F.coalesce((x == y) & (x != ""), F.lit(False))


def phone_equivalent(a: Column | str, b: Column | str) -> Column:
    """Digit strings equal or one edit apart; blanks never equal anything."""
    x, y = digits_of(a), digits_of(b)
    return F.coalesce((x != "") & (y != "") & (F.levenshtein(x, y, 1) >= 0), F.lit(False))


def normalize_block_text(c: Column | str) -> Column:
    """Runs of blanks as one space, ends stripped, and glued numbers of a contact line set apart (see ``repair_contact_line``)."""
    return repair_contact_line(strip_u(F.regexp_replace(_c(c), rf"(?U){_SPACE}+", " ")))


def repair_contact_line(c: Column | str) -> Column:
    """In a line without blanks that is a contact label and two glued numbers, a space between them; the first number is as long as it can be."""
    s = _c(c)
    glued = r"^((?:电话|传真|Tel|TEL|Fax|FAX)[:：]?)(0\d{2,3}+-\d{7,8}+)(0\d{2,3}-\d{7,8}|\d{7,8}(?:-\d{1,6})?)$"
    return F.when(F.contains(s, F.lit(" ")), s).otherwise(F.regexp_replace(s, glued, "$1$2 $3"))


def truncate_label(c: Column | str, size: int = 15) -> Column:
    """The first characters, with an ellipsis where something was left out."""
    s = _c(c)
    return F.when(F.length(s) > size, F.concat(F.substring(s, 1, size), F.lit("…"))).otherwise(s)


def clamp_progress(progress: Column | str, status: Column | str) -> Column:
    """0 to 100; a finished task is at 100."""
    return F.when(_c(status) == "done", 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(_c(progress), F.lit(0)))))


def safe_positive_int(c: Column | str, fallback: int) -> Column:
    n = _c(c).try_cast("int")
    return F.when(n > 0, n).otherwise(F.lit(fallback))


def safe_file_name(c: Column | str, suffix: str = ".xlsx", limit: int = 120) -> Column:
    """A file name without characters that file systems refuse, no longer than the limit.

    A suffix of the name's own (after the last dot of the last path part, unless that dot is its first or last character) is kept, else ``suffix`` is added;
    an empty name becomes ``example``, an empty stem ``export``; a stem that is cut does not end in blanks, dots or underscores."""
    name = F.coalesce(F.nullif(strip_u(F.coalesce(_c(c), F.lit(""))), F.lit("")), F.lit("example" + suffix))
    last = F.regexp_replace(F.regexp_replace(name, "/+$", ""), r"(?s)^.*/", "")
    end = F.regexp_extract(last, r"(?s)^.+(\.[^.]+)$", 1)
    stem = F.when(end != "", F.substr(last, F.lit(1), F.length(last) - F.length(end))).otherwise(name)
    clean = F.regexp_replace(strip_u(F.regexp_replace(stem, r'[<>:"/\\|?*\x00-\x1f]', "")), r"\.+$", "")
    clean = F.when(clean == "", "export").otherwise(clean)
    end = F.when(end != "", end).otherwise(suffix)
    room = F.greatest(F.lit(1), F.lit(limit) - F.length(end))
    cut = F.regexp_replace(F.substr(clean, F.lit(1), room), r"[ ._]+$", "")
    return F.concat(F.when(F.length(clean) > room, F.when(cut == "", "export").otherwise(cut)).otherwise(clean), end)


# What column names and values say about a column's type.
PHONE_NAMES = ["电话", "手机", "联系电话", "phone", "mobile", "tel"]
NOT_PHONE_NAMES = ["税号", "纳税人识别号", "发票", "订单", "金额", "编号", "代码"]
COMPANY_NAMES = ["公司", "单位", "机构", "企业", "organization", "company", "employer"]
COMPANY_ENDS = ["有限公司", "有限责任公司", "股份有限公司", "集团", "分公司", "研究院", "事务所", "co., ltd", "inc.", "llc", "ltd."]


def _has_any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words))


def infer_type(name: Column, value: Column) -> Column:
    """Aggregate: the type of a column from its name and its values (string, email, phone or company).

    Use in ``groupBy(name).agg(infer_type(F.col(name), F.col(value)))``; blank values are no samples."""
    v, low = strip_u(value), F.lower(strip_u(name))
    sample = F.coalesce(v, F.lit("")) != ""
    count = F.count_if(sample)
    right_size = F.length(digits_of(v)).between(7, 18)
    all_email = F.every(F.when(sample, v.rlike(r"(?U)\S+@\S+\.\S+")))
    all_digits = F.every(F.when(sample, right_size))
    all_formatted = F.every(F.when(sample, right_size & ~v.rlike(r"(?U)^\d+$") & v.rlike(r"[+ \-()]")))
    some_company = F.some(F.when(sample, _has_any(F.lower(v), COMPANY_ENDS)))
    deny, allow, company = (F.bool_or(_has_any(low, w)) for w in (NOT_PHONE_NAMES, PHONE_NAMES, COMPANY_NAMES))
    return (
        F.when(count == 0, "string")
        .when(all_email, "email")
        .when(deny, "string")
        .when(allow & all_digits, "phone")
        .when(company | F.coalesce(some_company, F.lit(False)), "company")
        .when(all_formatted, "phone")
        .otherwise("string")
    )

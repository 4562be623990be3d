"""Queries over small made tables whose results are worked out by hand, for operators that SQL cannot say over the driver's tables.

Each query runs the library's operator; its SQL is the table of expected rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import payload, text
from ..operators import attribute, ground, layout, quality, rollup, segment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def made(names: str, *rows: tuple):
    """Register a query with its expected rows; ``names`` are the columns, each as ``name type``."""
    columns = [n.rsplit(" ", 1) for n in names.split(", ")]

    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = " UNION ALL ".join("SELECT " + ", ".join(f'CAST({_literal(v)} AS {t}) AS "{n}"' for v, (n, t) in zip(row, columns)) for row in rows)
        return f

    return put


# --- grounding ----------------------------------------------------------------------------------------

_TEXT = "vendor Acme Ltd paid 1200.50 to Bob,\ninvoice AB-77 for xx ABC yy"
#: A value of its own; part of more; blanks and signs not counted; segments: all found, one found nowhere, one part of more; near; nowhere; blank; short segments.
_VALUES = ["Acme", "1200", "A B C", "AB77", "Acme;Bob", "Acme;zzzz", "Acme;1200", "vendor Acme Lte paid", "nowhere", " ", "a;b"]


def _grounded(spark: SparkSession, rows: list[list[str]]) -> DataFrame:
    cells = spark.createDataFrame([(n, r, _TEXT) for n, r in enumerate(rows)], "row int, values array<string>, source_text string")
    return ground.ground_cells(cells)


@made(
    "row INTEGER, value VARCHAR, source_text VARCHAR, start INTEGER, end INTEGER, status VARCHAR",
    (0, "Acme", "Acme", 7, 11, "ASSIGNED"), (1, "1200", "1200.50", 21, 28, "ASSIGNED_PARTIAL"), (2, "A B C", "ABC", 58, 61, "ASSIGNED"), (3, "AB77", "AB-77", 45, 50, "ASSIGNED"),
    (4, "Acme;Bob", "Acme", 7, 11, "ASSIGNED"), (5, "Acme;zzzz", "", -1, -1, "UNCERTAIN"), (6, "Acme;1200", "1200.50", 21, 28, "ASSIGNED_PARTIAL"), (7, "vendor Acme Lte paid", "vendor Acme Ltd paid", 0, 20, "INFERRED_FUZZY"),
    (8, "nowhere", "", -1, -1, "INFERRED"), (9, " ", "", -1, -1, "UNCERTAIN"), (10, "a;b", "AB", 45, 47, "ASSIGNED"),
)
def ground_made(spark, d):
    return _grounded(spark, [[v] for v in _VALUES]).select("row", F.inline("cells"))


#: Assigned wholly and partly; near; nowhere; no key cell; a blank beside an assigned one.
_ROWS = [["Acme", "1200"], ["Acme", "vendor Acme Lte paid"], ["Acme", "nowhere"], [" ", " ", "Acme"], ["AB77", " "]]


@made("row INTEGER, classification VARCHAR", (0, "ASSIGNED"), (1, "INFERRED"), (2, "INFERRED"), (3, "UNCERTAIN"), (4, "ASSIGNED"))
def classified_rows(spark, d):
    return _grounded(spark, _ROWS).select("row", "classification")


def _passing(mode: str):
    return lambda spark: _grounded(spark, _ROWS).where(ground.passes_grounding(F.col("cells"), F.col("classification"), mode)).select("row", "classification")


@made("row INTEGER, classification VARCHAR", (0, "ASSIGNED"), (4, "ASSIGNED"))
def grounding_filter_strict(spark, d):
    return _passing("strict")(spark)


@made("row INTEGER, classification VARCHAR", (0, "ASSIGNED"), (1, "INFERRED"), (4, "ASSIGNED"))
def grounding_filter_balanced(spark, d):
    return _passing("balanced")(spark)


@made(
    "row_id INTEGER, values VARCHAR[]",
    (1, ["Bob", "Acme", "CEO", "1234568", " ", " ", " "]), (3, ["Bob", "Other", " ", "1234567", " ", " ", " "]), (4, ["Ann", " ", " ", "1", " ", "a@b.c", " "]),
)
def near_dup_contacts_made(spark, d):
    rows = [["Bob", "Acme", " ", "1234567", " ", " ", " "], ["Bob", "Acme", "CEO", "1234568", " ", " ", " "], ["Bob", "Other", " ", "1234567", " ", " ", " "], ["Ann", " ", " ", "1", " ", "a@b.c", " "], ["Ann", " ", " ", " ", " ", "A@b.c", " "]]
    contacts = spark.createDataFrame([("k", n, r, 1) for n, r in enumerate(rows, 1)], "k string, row_id int, values array<string>, rank int")
    return ground.near_duplicate_contacts(contacts, "k", "row_id").select("row_id", "values")


# --- agreement and rates ------------------------------------------------------------------------------

_SAMPLES = [
    (1, [["a", "1"], ["a", "2"]], [["a", "2"]]), (2, [], []), (3, [["", "x"], ["b", "y"]], [["b", "y"], ["", "x"]]), (4, [["a", "1"]], []), (5, [["Ａ b", "1"]], [["ab", "1", "9"]]), (6, [["a", "1"], ["c", "3"]], [["b", "3"], ["a", "1"]]),
]


def _agreed(spark: SparkSession) -> DataFrame:
    return quality.agreement_scores(spark.createDataFrame(_SAMPLES, "sample int, candidate_rows array<array<string>>, reference_rows array<array<string>>"))


@made("sample INTEGER, matched INTEGER, compared INTEGER", (1, 2, 4), (2, 0, 0), (3, 4, 4), (4, 0, 2), (5, 2, 3), (6, 3, 4))
def agreement_made(spark, d):
    return _agreed(spark).select("sample", "matched", "compared")


@made("agreement DOUBLE", (11 / 17,))
def agreement_total(spark, d):
    return quality.aggregate_agreement(_agreed(spark))


@made("n INTEGER, edits INTEGER", (1, 2), (2, 1), (3, 0), (4, 3))
def word_edits(spark, d):
    pairs = spark.createDataFrame([(1, "a b c", "a x c d"), (2, "", "one"), (3, None, " "), (4, "x y z", "y z x w")], "n int, truth string, said string")
    return pairs.select("n", quality.word_distance(F.col("truth"), F.col("said")).cast("int").alias("edits"))


# --- names, payloads ----------------------------------------------------------------------------------


@made(
    "n INTEGER, file_name VARCHAR",
    (0, "a.csv"), (1, "ab.xlsx"), (2, "example.xlsx"), (3, "export.xlsx"), (4, ".hidden.xlsx"), (5, "a.xlsx"), (6, "y.z"), (7, "x" * 115 + ".xlsx"), (8, "dirplain.xlsx"), (9, "x" * 113 + ".xlsx"), (10, "b.xlsx"),
)
def file_names_made(spark, d):
    names = ["a.csv", 'a<>:"b.xlsx', None, "??", ".hidden", "a. ", "x/y.z", "x" * 130, "dir/plain", "x" * 113 + " _ " + "y" * 20, " b "]
    return spark.createDataFrame(list(enumerate(names)), "n int, name string").select("n", text.safe_file_name("name").alias("file_name"))


@made("n INTEGER, repaired VARCHAR", (1, '{"a": [1, 2]}'), (2, '[{"b": "c"}]'), (3, "(x;y)"), (4, None))
def repaired_json(spark, d):
    raw = [(1, '｛"a"： ［1， 2， ］｝'), (2, '[{"b": "c",},\n]'), (3, "（x；y）"), (4, None)]
    return spark.createDataFrame(raw, "n int, raw string").select("n", payload.repair_json(F.col("raw")).alias("repaired"))


@made("n INTEGER, rows VARCHAR[][], error_code VARCHAR", (1, [["a", "b"]], None), (2, [["a", "it"]], None), (3, None, "E_LLM_007"), (4, None, "E_LLM_002"), (5, [], None))
def parse_rows_made(spark, d):
    raw = [(1, '<think>[]</think>```json\n[["a","b",],]\n```'), (2, "x {'rows': [['a', 'it']]}"), (3, '{"rows":[1]}'), (4, None), (5, "[]")]
    return spark.createDataFrame(raw, "n int, raw string").select("n", payload.parse_rows(F.col("raw"), "aggressive").alias("p")).select("n", "p.rows", "p.error_code")


# --- segmentation -------------------------------------------------------------------------------------


@made(
    "start INTEGER, prefix VARCHAR, text VARCHAR",
    (0, "", "p one"), (7, "\n\n", "p two line"), (18, "\n", "long line he"), (30, "", "re"), (37, "\n\n", "end"),
)
def line_units(spark, d):
    @F.pandas_udf("array<struct<start:int,prefix:string,text:string>>")
    def units(texts):
        return texts.map(lambda t: [{"start": u.start, "prefix": u.prefix, "text": u.text} for u in segment.text_units(t, 12)])

    return spark.createDataFrame([("p one\n\np two line\nlong line here\n\n \n\nend",)], "t string").select(F.inline(units("t")))


_OLD = "发票号码:1\n货物或应税劳务、服务名称 规格型号 单位 数量 单价 金 额 税率 税 额\n运输费 次 1 211.33 211.33 6% 12.68\n??\n价税合计 224.01"
_NEW = "项目名称 规格型号 单位 数量 单价 金额 税率 税额\n*汽油*95号 升 20 7.50 150.00 13% 19.50\n*服务*住宿 费 -1,150.00 6%\n合 计 150.00\n*其他*项 1.00 6%"


@made(
    "page_id INTEGER, block_index INTEGER, row_index INTEGER, item VARCHAR, amount VARCHAR, rate VARCHAR",
    (1, 0, 0, "运输费", "211.33", "6%"), (2, 0, 0, "*汽油*95号", "150.00", "13%"), (2, 0, 1, "*服务*住宿", "-1,150.00", "6%"),
)
def invoice_lines_made(spark, d):
    pages = spark.createDataFrame([(1, _OLD), (2, _NEW), (3, "no invoice"), (4, None)], "page_id int, text string")
    rows = segment.line_rule_rows(pages, config.INVOICE.line_rules)
    f = lambda n: F.col("fields")[n]
    return rows.select("page_id", "block_index", "row_index", f("项目名称").alias("item"), f("金额").alias("amount"), f("税率").alias("rate"))


@made("page_id INTEGER, block_index INTEGER, item VARCHAR, invoice_no VARCHAR, buyer VARCHAR", (1, 0, "x", "7", "b0"), (1, 1, "y", "9", "b1"), (1, 2, "z", "7", "b0"), (2, 0, "w", " ", " "))
def parents_made(spark, d):
    rows = spark.createDataFrame([(1, 0, {"item": "x", "no": " "}), (1, 1, {"item": "y", "no": "9", "buyer": ""}), (1, 2, {"item": "z"}), (2, 0, {"item": "w"})], "page_id int, block_index int, fields map<string,string>")
    parents = spark.createDataFrame([(1, 0, {"no": "7", "buyer": "b0"}), (1, 1, {"no": "8", "buyer": "b1"})], "page_id int, block_index int, parent map<string,string>")
    filled = segment.backfill_parents(rows, parents, ["page_id"], ["no", "buyer"])
    return filled.select("page_id", "block_index", F.col("fields")["item"].alias("item"), F.col("fields")["no"].alias("invoice_no"), F.col("fields")["buyer"].alias("buyer"))


# --- layout -------------------------------------------------------------------------------------------


def _box(left: float, top: float, right: float, bottom: float) -> list[list[float]]:
    return [[float(x), float(y)] for x, y in ((left, top), (right, top), (right, bottom), (left, bottom))]


_PAGES = {
    1: [("next", _box(0, 20, 24, 30)), ("world", _box(14, 0, 24, 10)), ("Hello", _box(0, 0, 10, 10))],  # a word gap in the first row
    2: [("R2", _box(100, 20, 140, 30)), ("L1", _box(0, 0, 40, 10)), ("L2", _box(0, 20, 40, 30)), ("R1", _box(100, 0, 140, 10))],  # two columns
}
_LAID = {
    "none": ("next\nworld\nHello", "R2\nL1\nL2\nR1"),
    "single_none": ("Hello\nworld\nnext", "L1\nR1\nL2\nR2"),
    "single_line": ("Hello world\nnext", "L1\tR1\nL2\tR2"),
    "multi_none": ("Hello\nworld\nnext", "L1\nL2\nR1\nR2"),
    "multi_line": ("Hello world\nnext", "L1\nL2\nR1\nR2"),
}


@made("page INTEGER, parser VARCHAR, text VARCHAR", *[(n + 1, p, t) for p, both in _LAID.items() for n, t in enumerate(both)])
def layout_made(spark, d):
    pages = [(n, p, [{"text": t, "score": 0.9, "box": b, "end": None} for t, b in blocks]) for n, blocks in _PAGES.items() for p in _LAID]
    df = spark.createDataFrame(pages, "page int, parser string, blocks array<struct<text:string,score:double,box:array<array<double>>,end:string>>")
    return df.select("page", "parser", layout.layout(F.col("blocks"), F.col("parser"))["text"].alias("text"))


@made("page INTEGER, regions DOUBLE[][]", (1, [[0.0, 0.0, 50.0, 50.0]]), (2, []), (3, []), (4, []))
def uncovered_made(spark, d):
    image = [0.0, 0.0, 50.0, 50.0]  # a quarter of the page
    pages = [(1, [image], [[0.0, 0.0, 20.0, 20.0]]), (2, [image], [[0.0, 0.0, 25.0, 20.0], [0.0, 0.0, 25.0, 20.0]]), (3, [[0.0, 0.0, 20.0, 20.0]], []), (4, None, None)]
    df = spark.createDataFrame(pages, "page int, images array<array<double>>, texts array<array<double>>")
    return df.select("page", layout.uncovered_regions(F.col("images"), F.col("texts"), F.lit(100.0), F.lit(100.0)).alias("regions"))


# --- attribution --------------------------------------------------------------------------------------

_GROUPS = [attribute.Group("buyer", ("buyer_name",), ("购买方名称", "购买方")), attribute.Group("seller", ("seller_name",), ("销售方名称", "销售方"))]
_INVOICES = {
    1: [("购买方名称:", 0, 0), ("销售方名称:", 300, 0), ("甲公司有限公司", 0, 20), ("乙公司有限公司", 300, 20), ("foot", 0, 100)],  # side by side
    2: [("购买方名称:", 0, 0), ("销售方名称:", 0, 300), ("甲公司有限公司", 0, 20), ("乙公司有限公司", 0, 320), ("foot", 300, 400)],  # one above the other
    3: [("购买方名称:", 0, 0), ("购买方名称:", 0, 50), ("销售方名称:", 300, 0), ("foot", 300, 100)],  # two anchors of a kind
}


def _divided(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [(page, n, t, _box(x, y, x + 100, y + 10)) for page, blocks in _INVOICES.items() for n, (t, x, y) in enumerate(blocks)]
    blocks = spark.createDataFrame(rows, "page_id int, line_no int, text string, box array<array<double>>")
    e = layout.box_edges(F.col("box"))
    sizes = blocks.groupBy("page_id").agg(F.max(e["right"]).alias("width"), F.max(e["bottom"]).alias("height"))
    return blocks, attribute.page_divisions(attribute.find_anchors(blocks, _GROUPS), sizes, "buyer", "seller")


@made("page_id INTEGER, mode VARCHAR, split DOUBLE, low VARCHAR, high VARCHAR", (1, "left_right", 200.0, "buyer", "seller"), (2, "top_bottom", 155.0, "buyer", "seller"))
def attribution_divisions(spark, d):
    return _divided(spark)[1].select("page_id", "division.mode", "division.split", "division.low", "division.high")


@made(
    "page_id INTEGER, n INTEGER, buyer_name VARCHAR, seller_name VARCHAR, verdict VARCHAR",
    (1, 0, "甲公司有限公司", "乙公司有限公司", "kept"), (1, 1, "甲公司有限公司", "乙公司有限公司", "swapped"), (1, 2, "甲公司有限公司", "丙公司", "uncertain"), (2, 0, "甲公司有限公司", "乙公司有限公司", "swapped"), (2, 1, " ", "甲公司有限公司", "kept"),
)
def attribution_corrected(spark, d):
    blocks, divisions = _divided(spark)
    e = layout.box_edges(F.col("box"))
    region = attribute.region_of((e["left"] + e["right"]) / 2, (e["top"] + e["bottom"]) / 2, F.col("division"))
    located = blocks.join(divisions, "page_id").groupBy("page_id").agg(F.collect_list(F.struct("text", region.alias("region"))).alias("blocks"))
    a, b = "甲公司有限公司", "乙公司有限公司"
    rows = spark.createDataFrame([(1, 0, a, b), (1, 1, b, a), (1, 2, a, "丙公司"), (2, 0, b, a), (2, 1, " ", a)], "page_id int, n int, x string, y string")
    fixed = rows.join(located, "page_id").select("page_id", "n", attribute.correct_pair(F.col("x"), F.col("y"), F.col("blocks"), "buyer", "seller").alias("c"))
    return fixed.select("page_id", "n", F.col("c.a").alias("buyer_name"), F.col("c.b").alias("seller_name"), "c.verdict")


# --- templates, settings, review ----------------------------------------------------------------------


@made(
    "template_id VARCHAR, ordinal INTEGER, name VARCHAR, type VARCHAR",
    ("a", 0, "name", "company"), ("a", 1, "邮箱", "email"), ("a", 2, "电话", "phone"), ("a", 3, "备注", "string"), ("b", 0, "x", "number"), ("c", 0, "发票号码", "string"),
)
def inferred_columns(spark, d):
    rows = [("a", 0, ["name", "邮箱", "电话", "备注"]), ("a", 1, ["x", "a@b.cn", "0731-12345678", "ok"]), ("a", 2, ["y", "c@d.cn", "13800000000", " "]), ("c", 0, ["发票号码"]), ("c", 1, ["12345678"])]
    examples = spark.createDataFrame(rows, "template_id string, row_no int, cells array<string>")
    existing = spark.createDataFrame([("a", 0, "name", "company"), ("b", 0, "x", "number")], "template_id string, ordinal int, name string, type string")
    return config.inferred_columns(examples, existing)


_GOOD = {"provider": "ollama", "base_url": "http://h:1/v", "model": "m", "prompts": "p", "examples_raw": "e", "api_key": None, "needs_key": True, "ocr_profile": "fast", "extraction_profile": "balanced", "grounding_mode": "off",
         "ocr_layout_parser": "other", "parser_edited": False, "ollama_num_ctx": "4096", "online": False, "online_url": None, "online_key": None}
_CHANGES = [
    ({}, None), ({"provider": "x"}, "provider: unsupported value."), ({"base_url": "ftp://h"}, "base_url: must be a valid http(s) URL."), ({"model": ""}, "model: required."), ({"prompts": None}, "prompts: required."),
    ({"examples_raw": ""}, "examples_raw: required."), ({"provider": "openai_compatible"}, "api_key: required for openai_compatible."), ({"provider": "openai_compatible", "needs_key": False}, None), ({"ocr_profile": "slow"}, "ocr_profile: must be fast/balanced/accurate."),
    ({"grounding_mode": None}, "grounding_mode: must be off/balanced/strict."), ({"parser_edited": True}, "ocr_layout_parser: must be single_line/multi_para/none."), ({"ollama_num_ctx": "2047"}, "ollama_num_ctx: must be integer in [2048, 32768]."),
    ({"ollama_num_ctx": "many"}, "ollama_num_ctx: must be integer in [2048, 32768]."), ({"online": True}, "ocr_online_base_url: must be a valid http(s) URL."), ({"online": True, "online_url": "https://o"}, "ocr_online_api_key: required when online OCR is enabled."),
]


@made("n INTEGER, problem VARCHAR", *[(n, said) for n, (_, said) in enumerate(_CHANGES)])
def settings_problems(spark, d):
    rows = [(n, *(_GOOD | change).values()) for n, (change, _) in enumerate(_CHANGES)]
    kinds = ", ".join(f"{n} {'boolean' if n in ('needs_key', 'parser_edited', 'online') else 'string'}" for n in _GOOD)
    return spark.createDataFrame(rows, f"n int, {kinds}").select("n", config.settings_problem().alias("problem"))


_EVENTS = [  # task, seq, type, page, text, markdown, triggered, applied, rows
    ("t", 1, "ocr_completed", None, "all", "m1", True, False, None), ("t", 2, "ocr_completed", 1, "p1", None, False, False, None), ("t", 3, "page_streamed", 1, "p1 again", None, None, None, [(1, "a")]),
    ("t", 4, "progressed", None, None, None, None, None, [(1, "b"), (2, "c")]), ("t", 5, "page_streamed", 2, "p2", None, None, None, [(2, "d"), (2, "e")]), ("t", 6, "ocr_completed", None, None, None, False, False, None),
    ("u", 1, "page_streamed", 1, "q", None, None, None, [(1, "f")]), ("v", 1, "succeeded", None, "v", None, None, None, []), ("", 1, "failed", None, "lost", None, None, None, [(1, "g")]),
]


def _events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_EVENTS, "task_id string, seq int, event_type string, page_index int, text string, markdown string, retry_triggered boolean, retry_applied boolean, rows array<struct<page_index:int,value:string>>")


@made(
    "task_id VARCHAR, page_index INTEGER, text VARCHAR, markdown VARCHAR, retry_triggered BOOLEAN, retry_applied BOOLEAN",
    ("t", None, "all", None, False, False), ("t", 1, "p1 again", None, False, False), ("t", 2, "p2", None, None, None), ("u", 1, "q", None, None, None), ("v", None, "v", None, None, None),
)
def review_texts(spark, d):
    return rollup.review_texts(_events(spark))


@made("task_id VARCHAR, page_index INTEGER, value VARCHAR", ("t", 1, "b"), ("t", 2, "d"), ("t", 2, "e"), ("u", 1, "f"))
def review_rows(spark, d):
    return rollup.review_rows(_events(spark)).select("task_id", "page_index", "row.value")

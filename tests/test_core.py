import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright import config, providers
from pagewright.functions import payload, text
from pagewright.operators import attribute, ground, layout, lifecycle, markup, quality, rollup, segment
from pagewright.sinks import writers
from pagewright.sources import readers

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"`{n}` string" for n in names)).select(column.alias("r")).first()["r"]


def test_strings(spark):
    assert one(spark, text.strip_u("s"), s="　 a\t\x1c") == "a"
    assert one(spark, text.normalize_phone("s"), s=" +86 (10) 1234") == "+86101234"
    assert one(spark, text.is_valid_email("s"), s=" A@b.c ") is True
    assert one(spark, text.is_valid_email("s"), s="a@b..c") is False
    assert one(spark, text.parse_number("s"), s="-¥1,234.50") == -1234.5
    assert one(spark, text.parse_number("s"), s="12d") is None
    assert str(one(spark, text.parse_date("s", ["%Y年%m月%d日", "%Y-%m-%d"]), s="2023年7月3日")) == "2023-07-03"
    assert one(spark, text.repair_contact_line("s"), s="电话0731-123456780731-87654321") == "电话0731-12345678 0731-87654321"
    assert one(spark, text.dedupe_key("s"), s=" Ａ b") == "ab"
    assert one(spark, text.safe_file_name("s"), s='a<>:"b.xlsx') == "ab.xlsx"
    assert one(spark, text.safe_file_name("s"), s="??") == "export.xlsx"
    assert one(spark, text.safe_file_name("s"), s="a.csv") == "a.csv"


def test_status_codes():
    assert [providers.status_code(n) for n in (400, 422, 401, 403, 404, 429, 500, 302)] == ["E_LLM_003"] * 2 + ["E_LLM_004"] * 2 + ["E_LLM_006", "E_LLM_005", "E_LLM_006", "E_LLM_006"]


def test_payloads():
    assert payload.decode_rows('<think>[]</think>```json\n[["a","b",],]\n```') == ([["a", "b"]], None)
    assert payload.decode_rows("x {'rows': [['a', 'it']]}", "aggressive") == ([["a", "it"]], None)
    assert payload.decode_rows('{"rows":[1]}') == (None, "E_LLM_007")
    assert payload.decode_rows(None) == (None, "E_LLM_002")
    assert payload.decode_rows("[]") == ([], None)
    assert payload.decode_objects('[{"a": 1}]') == ([{"a": "1"}], None)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n中。", max_size=400), st.integers(5, 60), st.integers(1, 80))
def test_passes_cover_the_text(body, limit, step):
    chunks = segment.split_passes(body, 2, limit, step)
    assert all(len(c) <= max(limit, len(body) if len(chunks) == 1 else limit) for c, _, _ in chunks)
    if body.strip() and len(body) > limit + step:
        seen = set()
        for _, a, b in chunks:
            seen.update(range(a, b))
        assert {i for i, c in enumerate(body) if not c.isspace()} <= seen or max(b for *_, b in chunks) <= len(body)


def test_line_rules():
    rules = segment.LineRules("^items", "^total", r"^(?P<name>\w+) (?P<n>\d+)$")
    found = segment.line_rows("x\nitems\na 1\n??\nb 2\ntotal 3\ny\nitems\nc 3\ntotal", rules)
    assert found.matched and [[r["name"] for r in b] for b in found.blocks] == [["a", "b"], ["c"]] and found.unmatched == "x\ny"
    assert not segment.line_rows("items\na 1", rules).matched
    assert segment.line_rows("nothing", rules).diagnostics == ["start not found"]


def test_grounding():
    g = ground.ground_value
    assert g("hello", "say hello now")[2:] == (4, 9, "ASSIGNED")
    assert g("hell", "say hello now")[4] == "ASSIGNED_PARTIAL"
    assert g("ABC公司", "xx ABC公 司 yy")[2:] == (3, 9, "ASSIGNED")  # blanks do not count
    assert g(" ", "x")[4] == "UNCERTAIN" and g("x", None)[4] == "INFERRED" and g(None, "x")[4] == "UNCERTAIN"
    assert g("ab;zz", "ab")[4] == "UNCERTAIN" and g("ab;cd", "x ab cdx")[2:] == (5, 8, "ASSIGNED_PARTIAL")
    assert g("invoice tota1 amount", "a invoice total amount is")[2:] == (2, 22, "INFERRED_FUZZY")
    assert g("invoice tota1 amount", "an invoice total amount is")[4] == "INFERRED"  # windows start at every second character, and these are not near enough


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aİ中 ，1b", min_size=1, max_size=12), st.text(alphabet="aİ中 ，1b", max_size=60))
def test_spans_lie_in_the_text(value, body):
    _, source, a, b, status = ground.ground_value(value, body)
    assert (a, b, source) == (-1, -1, "") if status in ("UNCERTAIN", "INFERRED") else body[a:b] == source


def test_exact_status_in_the_jvm_is_the_models(spark):
    rows = [("hello", "say hello now"), ("hell", "say hello"), ("x", "y"), ("甲", "甲，乙"), ("", "a"), (None, "a")]
    df = spark.createDataFrame(rows, "v string, t string").select("v", "t", ground.exact_status(F.col("v"), F.col("t")).alias("s"))
    for r in df.collect():
        hit = ground._exact(r["v"], r["t"]) if r["v"] else None
        assert r["s"] == (hit[2] if hit else None)


def block(t, l, top, w=50, h=10):
    return layout.Block(t, 0.9, [[l, top], [l + w, top], [l + w, top + h], [l, top + h]])


def test_reading_order_and_separators():
    cols = [block("a1", 0, 0), block("b1", 100, 0), block("a2", 0, 20), block("b2", 100, 20), block("head", 0, -20, 160)]
    assert [b.text for b in layout.arrange(cols, "multi_line")] == ["head", "a1", "a2", "b1", "b2"]
    row = layout.arrange([block("wide", 0, 0, 40), block("gap", 200, 0, 30)], "single_line")
    assert "".join(b.text + b.end for b in row) == "wide\tgap"
    assert layout.word_separator("中", "文") == "" and layout.word_separator("a", "b") == " " and layout.word_separator("a", ".") == ""
    assert layout.arrange([], "multi_para") == []
    assert layout.union_area([(0, 0, 2, 2), (1, 1, 3, 3)]) == 7
    assert layout.uncovered([(0, 0, 50, 50)], [(0, 0, 50, 20)], 100, 100) == [] and len(layout.uncovered([(0, 0, 50, 50)], [], 100, 100)) == 1


def test_layout_of_null_and_empty_pages(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "id int, blocks array<struct<text:string,score:double,box:array<array<double>>,end:string>>")
    assert {r["t"] for r in df.select(layout.layout(F.col("blocks"), F.lit("multi_para"))["text"].alias("t")).collect()} == {""}


def test_markup():
    assert markup.normalize(" ") is None and markup.normalize("plain") == "plain"
    html = "<div>a<table><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2|3</td></tr></table>b</div>"
    assert markup.normalize(html) == "a\n\n| x | 1 |\n| --- | --- |\n| x | 2\\|3 |\n\nb"
    assert markup.to_text("# Head\n| a | b |\n| --- | --- |\n|1|2|") == "Head\na b\n1 2"


def test_lifecycle_folds_agree(spark):
    rows = [("a", i, c) for i, c in enumerate(["start", "extract", "finish", "retry"])] + [("b", 0, "pause"), ("b", 1, "start"), ("b", 2, "resume"), ("c", 0, "clear"), ("d", 0, "nonsense")]
    df = spark.createDataFrame(rows, "task_id string, seq int, command string")
    key = lambda d: sorted(map(tuple, d.select("task_id", "state", "refused", "last_error").collect()))
    native, model = key(lifecycle.replay_tasks(df)), key(lifecycle.fold_groups(df, "task_id", "seq", "command"))
    assert native == model
    assert ("a", "done", 1, "E_RETRY_001") in native and ("c", "removed", 0, None) in native


def test_admission():
    w = lifecycle.Waiting
    assert lifecycle.decide_admission([w("1", "text", "pending")], set(), False, False, True) == ("wait", None)
    assert lifecycle.decide_admission([w("1", "pdf", "pending")], set(), False, False, True) == ("admit", "1")
    assert lifecycle.decide_admission([w("1", "pdf", "done")], set(), False, False, False) == ("done", None)


def test_retry_budget(spark):
    rows = [("a", i, True, False) for i in range(1, 5)] + [("b", 1, None, None)]
    got = {r["task_id"]: (r["budget_left"], r["streak"], r["disabled"]) for r in lifecycle.retry_budget(spark.createDataFrame(rows, "task_id string, page_index int, retry_triggered boolean, retry_applied boolean")).collect()}
    assert got == {"a": (4, 2, True), "b": (6, 0, False)}


def test_quality():
    assert quality.agreement([["a", "1"], ["b", "2"]], [["b", "2"], ["a", "3"]]) == (3, 4)
    assert quality.agreement([], []) == (0, 0)
    assert quality.agreement([["a", "1"], ["a", "2"]], [["a", "2"]]) == (2, 4)


def test_word_distance(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("", "a"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(quality.word_distance(F.col("a"), F.col("b"))).collect()] == [1, 1, 0]


def test_attribution():
    assert attribute.tiles("abcabc", ["abc", "abc"]) and not attribute.tiles("abcd", ["abc"])
    assert attribute.locate("甲公司", [("名称:甲公司", "buyer"), ("乙", "seller")]) == "buyer"
    assert attribute.locate("甲", [("甲", "buyer"), ("甲", "seller")]) is None


def test_rollups_on_empty_tables(spark):
    pages = spark.read.parquet(f"{DATA}/ocr_pages.parquet").limit(0)
    tasks = spark.read.parquet(f"{DATA}/tasks.parquet").limit(0)
    assert rollup.document_rollup(pages).count() == 0 and rollup.queue_snapshot(tasks, pages).count() == 0
    assert rollup.status_badges(tasks).first()["total"] == 0


def test_latest_keeps_one_row_of_a_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "q")], "k string, s int, v string")
    got = {r["k"]: r["s"] for r in rollup.latest(df, ["k"], "s").collect()}
    assert got == {"a": 2, "b": None}


def test_config(tmp_path):
    c, notes = config.coerce({"extraction_passes": "x", "ocr_profile": "fast", "grounding_fuzzy_threshold": 2})
    assert c.extraction_passes == 2 and c.ocr_profile == "fast" and len(notes) == 2
    path = str(tmp_path / "c.json")
    config.save(c, path)
    assert config.load(path)[0].ocr_profile == "fast" and config.load(path + "x")[0] == config.Config()
    with pytest.raises(config.ConfigError):
        config.format_examples("[[1]]")
    with pytest.raises(config.ConfigError):
        config.rows_schema(1)
    assert config.validate_template(config.INVOICE) == []


def test_http_provider_steps_down_and_names_errors():
    calls = []

    def post(url, headers, body, timeout):
        calls.append(body.get("response_format"))
        return (400, {"error": "response_format"}) if body.get("response_format") else (200, {"choices": [{"message": {"content": "[]"}}]})

    assert providers.HttpProvider("http://x", "m", post).chat_batch([[{"role": "user", "content": "t"}]], {"type": "object"}) == [("[]", None)]
    assert [c and c["type"] for c in calls] == ["json_schema", "json_object", None]
    assert providers.HttpProvider("http://x", "m", lambda *a: (429, {})).chat_batch([[]]) == [(None, "E_LLM_005")]


def test_remote_job():
    states = iter([{"state": "running"}, {"state": "done", "resultUrl": {"jsonUrl": "u"}}])
    get = lambda url, headers: (200, '{"a": 1}\n') if url == "u" else (200, {"code": 0, "data": next(states)})
    job = providers.RemoteJob("http://x", "t", lambda *a: (200, {"code": 0, "data": {"jobId": "1"}}), get, sleep=lambda s: None)
    assert job.run(b"", "n") == [{"a": 1}]
    with pytest.raises(providers.JobError) as e:
        providers.RemoteJob("http://x", "t", lambda *a: (401, {}), get).run(b"", "n")
    assert e.value.code == "E_OCR_012"


def test_raw_blocks():
    assert readers.raw_blocks([[[[0, 0], [1, 1]], ["t", 0.5]]]) == [("t", 0.5, [[0.0, 0.0], [1.0, 1.0]], "")]
    assert readers.raw_blocks({"x": {"rec_texts": ["a"], "rec_scores": [0.1], "rec_boxes": [[0, 0, 2, 1]]}})[0][2][2] == [2.0, 1.0]


def test_sheet_is_appended(tmp_path):
    import zipfile

    path = str(tmp_path / "a.xlsx")
    assert writers.append_sheet(path, [[1, "a<b"], [None, 2.5]]) == 2 and writers.append_sheet(path, [["z"]]) == 1
    with zipfile.ZipFile(path) as z:
        assert z.read("xl/worksheets/sheet1.xml").decode().count("<row>") == 3


def test_masking(spark):
    got = one(spark, writers.masked(F.col("s")), s=json.dumps({"api_key": "k", "x": {"Authorization": "b c"}, "y": 1}))
    assert json.loads(got) == {"api_key": "****", "x": {"Authorization": "****"}, "y": 1}


def test_sql_names(spark):
    from pagewright import sql

    sql.register(spark)
    assert spark.sql("SELECT normalize_phone(' +1 2'), is_valid_phone('1234567')").first()[:] == ("+12", True)
    assert spark.sql("SELECT count(*) FROM split_passes('abc', 2, 10, 5)").first()[0] == 1


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "email", "email_raw", "label", "label_raw"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_optional_part():
    root = os.path.join(os.path.dirname(os.path.dirname(__file__)), "pagewright")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    body = open(os.path.join(folder, n)).read()
                    assert "from .llm" not in body and "pagewright.llm" not in body and "from ..llm" not in body


def test_full_sheet(tmp_path, monkeypatch):
    path = str(tmp_path / "a.xlsx")
    monkeypatch.setattr(writers, "SHEET_ROWS", 3)
    assert writers.append_sheet(path, [["a"], ["b"]]) == 2
    with pytest.raises(ValueError):
        writers.append_sheet(path, [["c"], ["d"]])
    assert writers.append_sheet(path, [["c"]]) == 1


def test_histories_are_composed():
    import random

    r = random.Random(1)
    words = [r.choice(["start", "extract", "finish", "fail", "retry", "resume", "pause", "clear", "odd"]) for _ in range(400)]
    for cut in (0, 1, 57, 400):
        first, second = lifecycle.Runs().fold(words[:cut]), lifecycle.Runs().fold(words[cut:])
        for s, name in enumerate(lifecycle.STATES):
            middle = first[0][s]
            whole = lifecycle.replay(words, name)
            assert whole == (lifecycle.STATES[second[0][middle]], first[1][s] + second[1][middle], second[2][middle] or first[2][s])

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import abuse, forms, leakage, parties, personal, pieces, scans, tokens

RANKS = f"{tokens.DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"


# --- 1 ---


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n。，中", max_size=300), st.integers(1, 40), st.integers(0, 50))
def test_pieces(body, limit, overlap):
    cut = pieces.split_text(body, limit, overlap)
    overlap = max(0, min(overlap, limit - 1))
    assert cut[0][0] == 0 and cut[-1][1] == len(body) and all(b - a <= limit or len(body) <= limit for a, b in cut)
    if len(body) > limit:
        assert all(y[0] == max(0, x[1] - overlap) and y[1] > x[1] for x, y in zip(cut, cut[1:]))


def test_pieces_end_at_boundaries():
    body = "One two three. " * 30
    assert all(body[:b].endswith(". ") for _, b in pieces.split_text(body, 100)[:-1])
    assert len(pieces.split_text("x" * 95, 10, 3)) > 10


def test_split_units(spark):
    units = spark.createDataFrame([(1, "a", "x" * 30), (2, "b", "y" * 30), (3, "c", None), (4, "a", ""), (5, None, "z" * 2300), (1, "a", "x" * 30)], "unit_id long, config_id string, text string")
    configs = spark.createDataFrame([("a", 10, 8), ("b", 0, None), ("a", 10, 8)], "config_id string, extraction_max_char_buffer int, extraction_passes_increment int")
    rows = pieces.split_units(units, configs).collect()
    assert all(len(r["piece"]) <= 10 for r in rows if r["unit_id"] == 1) and len([r for r in rows if r["unit_id"] == 2]) == 1
    assert [r["piece"] for r in rows if r["unit_id"] == 4] == [""] and not [r for r in rows if r["unit_id"] == 3]
    assert {r["unit_id"] for r in pieces.oversized_units(units, configs).collect()} == {1, 5}
    assert pieces.split_units(units.limit(0), configs).count() == 0


# --- 2 ---


def test_scan_parts():
    for line in ("p. 3", "- 12 -", "[3]", "第 2 页 共 6 页", "8 / 10", "iv", "Page 2 of 9", "7"):
        assert scans._PAGE_NUMBER.fullmatch(line), line
    for line in ("12.50", "p. x", "2024-01-01", "15460529700"):
        assert not scans._PAGE_NUMBER.fullmatch(line), line
    assert scans.skeleton("Archive v0lume AB-1  3") == scans.skeleton("Archive volume AB-1")
    assert scans.token_key("AB-1234") == "AA-0000" and scans.token_key("4.7l") == "0.0l" and scans.token_key("L0gistics") == "l0gistics"


def test_affected_lines(spark):
    body = "the service was good and the service was identification of service\n" * 3
    own = lambda i: "".join("abcdefghij"[int(c)] * 2 for c in str(100 + i))
    pages = [(i, "t", i, f"Head line of it\nbegin {own(i)}\n{body}last {own(i)} service identific-\nation done\nand {own(i)} so\nend {own(i)}\np. {i}") for i in range(1, 21)]
    pages += [(30, "u", 1, "the servicc was good\nplain line here\nmore words"), (31, None, None, None), (32, "u", 2, "")]
    df = spark.createDataFrame(pages, "page_id long, task_id string, page_index int, text string")
    got = {(r["page_id"], r["kind"]) for r in scans.affected_lines(df, df.limit(0)).collect()}
    assert (30, "misread") in got and (1, "running_line") in got and (1, "page_number") in got and (5, "broken_word") in got
    clean = {r["page_id"]: r["paragraphs"] for r in scans.clean_paragraphs(df, df.limit(0)).collect()}
    assert "identification done" in clean[3] and "Head line" not in clean[3] and "p. 3" not in clean[3] and "service was good" in clean[30]


def test_repaired_blocks(spark):
    own = lambda i: "".join("abcdefghij"[int(c)] * 2 for c in str(100 + i))
    body = "the service was good and the service was identification of service\n" * 3
    pages = [(i, "t", i, f"Head line of it\nbegin {own(i)}\n{body}{'the servicc was good' if i == 7 else own(i + 50)}\nlast {own(i)} service identific-\nation done\nend {own(i)}\np. {i}") for i in range(1, 21)]
    blocks = [(i * 100 + n, i, n, line) for i, _, _, text in pages for n, line in enumerate(text.split("\n"), 1)]
    df = spark.createDataFrame(pages, "page_id long, task_id string, page_index int, text string")
    got = {r["block_id"]: (r["kind"], r["repaired"]) for r in scans.clean_blocks(spark.createDataFrame([*blocks, blocks[0], (9, None, None, "Ｘ y"), (10, 1, 99, None)], "block_id long, page_id long, line_no int, text string"), df, df.limit(0)).collect()}
    assert len(got) == len(blocks) + 2 and got[9] == (None, "X y") and got[10] == (None, None)
    assert got[701] == ("running_line", None) and got[710] == ("page_number", None) and got[706] == ("misread", "the service was good")
    assert got[707] == ("broken_word", f"last {own(7)} service identific") and got[703] == (None, "the service was good and the service was identification of service")


def test_running_lines_shared_by_many_tasks(spark):
    say = lambda i: " ".join("abcdefghij"[int(c)] * 3 for c in str(1000 + i * 37))
    pages = []
    for t in range(30):
        for i in (1, 2, 3):
            n = t * 3 + i
            if t < 20:  # one header for all, two lines
                pages.append((n, f"t{t}", i, f"CONFIDENTIAL\nInternal copy\n{say(n)}\nsome body {say(n + 500)}\nend of {say(n + 900)}"))
            else:  # a form's title, names above posts, a form's closing line
                pages.append((n, f"t{t}", i, f"Sales invoice\nNumber: {say(n)}\nmore {say(n + 500)}\nwith {say(n + 900)}\nReceived by: Checked by:"))
    pages += [(1000 + i, "u", i, f"{say(i + 700)}\nSite Engineer\nbody {say(i)}\nmore {say(i + 300)}\nlast {say(i + 600)}") for i in (1, 2)]
    df = spark.createDataFrame(pages, "page_id long, task_id string, page_index int, text string")
    got = {(r["page_id"], r["line_no"]) for r in scans.affected_lines(df, df.limit(0)).collect() if r["kind"] == "running_line"}
    assert got == {(n, k) for n in range(1, 61) for k in (1, 2)}


# --- 3 ---


def test_forms():
    c = forms.canonical_text
    assert c(None) is None and c("") == "" and c("​ 　") == ""
    assert c("ＡＢ​Ｃ　１ ") == "ABC 1" and c("Рriсе") == "Price" and c("ﬁle") == "file" and c("é") == "é" and c("ӓ") == "ä"
    assert c("A") != c("a") and c("0") != c("O") and c("1") != c("l") and c("e") != c("é") and c("⼯") == c("工") and c("−‐‑") == "---"
    assert c("STRASSE", True) == c("straße", True)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_forms_are_stable(x):
    assert forms.canonical_text(forms.canonical_text(x)) == forms.canonical_text(x)


def test_same_looking(spark):
    blocks = spark.createDataFrame([(1, 1, "Рrice"), (2, 1, "Price"), (3, 1, "price"), (4, 2, "Рrice"), (5, 1, None), (6, 1, ""), (1, 1, "Рrice")], "block_id long, page_id long, text string")
    layers = spark.createDataFrame([(1, "x\nPrice"), (2, None)], "page_id long, text string")
    assert [r[0] for r in forms.same_looking_blocks(blocks, layers).collect()] == [1]


def test_forms_of_blocks_and_layers(spark):
    blocks = spark.createDataFrame([(1, 1, 1, "Рrice"), (2, 1, 2, None)], "block_id long, page_id long, line_no int, text string")
    layers = spark.createDataFrame([(1, "Ｐrice\n\nEnd  of"), (2, None)], "page_id long, text string")
    rows = {(r["src"], r["block_id"], r["page_id"], r["line_no"]): (r["form"], r["folded"]) for r in forms.consistent_lines(blocks, layers).collect()}
    assert rows == {("ocr_blocks", 1, 1, 1): ("Price", "price"), ("ocr_blocks", 2, 1, 2): (None, None), ("text_layers", None, 1, 1): ("Price", "price"),
                    ("text_layers", None, 1, 2): ("", ""), ("text_layers", None, 1, 3): ("End of", "end of"), ("text_layers", None, 2, None): (None, None)}


# --- 4 ---


def test_personal_lines():
    w = personal.train()
    wrong = 0
    lines = list(personal.training_lines(400, seed=99))
    for line, gold in lines:
        wrong += {k for *_, k in personal.find(line, w)} != {k for *_, k in gold}
    assert wrong / len(lines) < 0.05
    kinds = lambda s: {k for *_, k in personal.find(forms.canonical_text(s), w)}
    assert kinds("司机程景行在门口出示证件,号码997263195811212176。") == {"name", "id_number"}
    assert kinds("Order reference 2024-118-5567 replaces 2024-118-5521.") == set()
    assert kinds("Kandush Marine Logistics Ltd") == set()


def test_unlisted_given_names_are_scored():
    w = personal.train()
    names = lambda s: [s[a:b] for a, b, k in personal.find(s, w) if k == "name"]
    for who in ("王丽萍", "李玲", "张亮", "陈东山", "刘凤珍", "欧阳丹", "周鑫"):
        assert names(f"收款人:{who}") == [who] and names(f"请联系{who}。") == [who] and names(f"司机{who}在门口出示证件") == [who], who
    for plain in ("金额和方向都在附页里。", "路线由双方确认,高度不变。", "周末仓库关闭,请于周一再来。"):
        assert names(plain) == [], plain


def test_redaction_keeps_the_rest():
    w = personal.train()
    assert personal.redact_text("Ｅ-mail ａ.b@x​y.test !", w) == "Ｅ-mail [EMAIL] !"
    assert personal.redact_text("", w) == "" and personal.redact_text(None, w) is None


def test_redaction_finds_what_is_found_between_odd_blanks():
    w = personal.train()
    for line in ("Contact John  Smith today", "Contact John \u00a0Smith\ttoday", " Tel  +44 7700  900123", "at 12  Mill   Road", "Contact Jo\u200bhn \u3000 Smith"):
        form, start, end = forms.canonical_with_map(line)
        assert form == forms.canonical_text(line) and len(form) == len(start) == len(end)
        kinds = {k for *_, k in personal.find(form, w)}
        assert kinds and all(personal.PLACEHOLDERS[k] in personal.redact_text(line, w) for k in kinds)
    assert personal.redact_text("  Contact  John \u00a0Smith \t today ", w) == "  Contact  [NAME] \t today "


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aé12 \t\u00a0\u3000\u200b\u00ad\u0308Ａ中ﬁ\u2800각가½¨", max_size=20))
def test_mapped_form_is_the_form(x):
    assert forms.canonical_with_map(x)[0] == forms.canonical_text(x)


def test_segmentation_is_the_best_one():
    r = random.Random(1)
    w = {"f1": 1.0, "f2": 2.0, "f3": -1.0}
    for _ in range(100):
        spans = []
        for _ in range(6):
            a = r.randint(0, 10)
            spans.append((a, a + r.randint(1, 5), "name", (r.choice(["f1", "f2", "f3"]),)))
        best = max((sum(w[s[3][0]] for s in sub) for n in range(64) for sub in [[s for i, s in enumerate(spans) if n >> i & 1]] if all(x[1] <= y[0] or y[1] <= x[0] for i, x in enumerate(sub) for y in sub[i + 1 :])), default=0)
        chosen = personal.decode(spans, w)
        got = sum(max(w[s[3][0]] for s in spans if s[:2] == c[:2]) for c in chosen)
        assert got == pytest.approx(max(best, 0))


# --- 5 ---


def test_parties(spark):
    names = ["Margaret Dockfornor", "Dockfornor, Margaret", "Peggy Dockfornor", "Margaert Dockfornor", "Torsadeprern Urban Packaging Nettlewick Ltd", "Nettlewick - Torsadeprern Urban Packaging", "Trosadeprern Urb Packaging Nettlewick",
             "Gimvorsel Harbour Foods Pellhurst Inc.", "Gimvorsel Urban Ceramics Pellhurst Co. Ltd.", "Gimvorsel", "沐原信盛华新型仪器有限公司", "信盛华新型仪器（沐原）有限公司", "沐原信华盛新型仪器有限公司", "沐原信盛华精密五金有限公司", " ", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    by = {r["name"]: r["party"] for r in parties.party_classes(parties.spellings(df, "n")).collect()}
    assert len({by[n] for n in names[:4]}) == 1 and len({by[n] for n in names[4:7]}) == 1 and len({by[n] for n in names[10:13]}) == 1
    assert len({by[n] for n in (names[7], names[8], names[9])}) == 3 and by[names[13]] != by[names[10]] and len(by) == 14


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=6), st.text(alphabet="abc", max_size=6))
def test_one_slip(a, b):
    near = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in "abc" for k in (0, 1)} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    assert parties.one_slip(a, b) == (b in near)


# --- 6 ---


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="'strevmld  \n\tA1!。中", max_size=14), max_size=6))
def test_encoding_is_the_librarys(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.DEFAULT_FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    ids, at = tokens.encoder(RANKS).encode_batch(texts)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encoding_round_trip(spark):
    df = spark.createDataFrame([(1, "It's 3 Häuser 中文 <|endoftext|>"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in tokens.encode_texts(df, offsets=True).collect()}
    assert rows[2]["ids"] == [] and rows[3]["ids"] == [] and rows[1]["ends"][-1] == len(df.first()["text"].encode())
    assert {r["doc_id"]: r["text"] for r in tokens.decode_ids(tokens.encode_texts(df)).collect()} == {1: df.first()["text"], 2: "", 3: ""}


# --- 7 ---


def test_leakage(spark):
    r = random.Random(3)
    words = [("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))) for _ in range(900)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    items = [(i, " ".join(say(12) for _ in range(5))) for i in range(20)]
    docs = [(i, " ".join(say(14) for _ in range(8))) for i in range(150)]
    hidden = items[3][1]
    docs += [(900, say(10) + " " + hidden.upper().replace(" ", "  ") + say(9)), (901, say(20) + hidden[: len(hidden) * 6 // 10] + say(20)), (902, say(20) + hidden[:40] + say(20)), (903, None), (904, ""), (900, say(10) + hidden)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None)], "item_id long, text string")
    assert {tuple(x) for x in leakage.leaked(d, e).collect()} == {(900, 3), (901, 3)}
    assert leakage.leaked(d, e.limit(0)).count() == 0


def test_leakage_from_two_fifths_with_slips():
    r = random.Random(5)
    letters = lambda n: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    item = leakage.Item(1, letters(300), 300)
    slipped = "".join("x" if k % 16 == 8 else c for k, c in enumerate(item.text[50:175]))  # 0.417 of the item, 7 slips
    for copy, case in ((item.text[60:184], True), (slipped, True), (item.text[60:170], False)):
        assert leakage.is_leaked(leakage.coverage(letters(300) + copy + letters(300), item), item) == case
    asked = leakage.Item(2, letters(250) + letters(50), 250)
    assert leakage.is_leaked(leakage.coverage(letters(90) + asked.text[155:] + letters(90), asked), asked)  # the question and 0.38 of the item
    assert not leakage.is_leaked(leakage.coverage(letters(90) + asked.text[250:] + letters(90), asked), asked)
    scraps = "".join(item.text[k : k + 15] + letters(60) for k in range(0, 300, 30))
    assert not leakage.is_leaked(leakage.coverage(scraps, item), item)


def test_leakage_bound_loses_no_case():
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    han = lambda n: "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(n))
    items = [leakage.Item(n, make(250), 250) for n, make in enumerate([letters] * 6 + [han] * 3)]
    slip = lambda s, every: "".join("x" if k % every == every - 1 else c for k, c in enumerate(s))
    docs = [letters(80) + slip(i.text, every) + letters(80) for i in items[:6] for every in (12, 19, 20)]
    docs += [letters(80) + slip(i.text[40:180], 8) + letters(80) for i in items[:6]] + [han(60) + slip(i.text, 7) + han(60) for i in items[6:]]
    seeds = leakage.Seeds(items)
    pairs = np.array([(d, i) for d in range(len(docs)) for i in range(len(items))])
    near = {(d, i) for d, i, _ in seeds.coverages(docs, pairs, leakage.COVERED)}
    held = {(d, i) for d, i in pairs.tolist() if leakage.coverage(docs[d], items[i])[0] >= leakage.COVERED}
    for d, i in pairs.tolist():  # runs by hashes are the runs by characters
        _, *own = seeds.runs(docs, np.array([[d, i]]))
        assert sorted(zip(*map(list, own))) == sorted(zip(*map(list, leakage._common_runs(docs[d], items[i]))))
    assert held <= near and {(k, k // 3) for k in range(18)} | {(24 + k, 6 + k) for k in range(3)} <= held and len(near) < len(pairs) / 2


def test_chain_of_many_runs_and_later_stretches():
    r = random.Random(6)
    letters = lambda n: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    item = leakage.Item(1, letters(6000), 6000)
    slipped = "".join("x" if k % 12 == 11 else c for k, c in enumerate(item.text))  # 500 runs of eleven characters
    assert leakage.coverage(letters(500) + slipped + letters(500), item)[0] > 0.9
    assert leakage._is_han("a" * 500 + "中文" * 600) and not leakage._is_han("中文" * 100 + "a" * 1000)
    cells = leakage._cells(leakage._points("a" * 160 + "中" * 64))
    assert cells.max() + 1 == 4 and (np.bincount(cells) == [80, 80, 32, 32]).all()


def test_standing_questions_are_counted_over_all_items(spark):
    items = [(i, f"Own text number {i} of item {i}. What is the amount due?") for i in range(3)] + [(7, "Other text. Only here?"), (8, ""), (9, None)]
    df = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["item_id"]: r["body"] - len(r["text"]) for r in leakage.with_bodies(df).collect()}
    assert rows == {0: -len("whatistheamountdue"), 1: -len("whatistheamountdue"), 2: -len("whatistheamountdue"), 7: 0}


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9))) for _ in range(n)) + "."
    items = [(i, f"{say(40)} And what is asked?") for i in range(7)]
    docs = [(i, f"{say(30)} {items[i % 7][1] if i % 3 == 0 else say(20)} {say(30)}") for i in range(40)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(x) for x in leakage.leaked(d, e).collect()}
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 2)
    assert whole == {tuple(x) for x in leakage.leaked(d, e).collect()} == {(i, i % 7) for i in range(0, 40, 3)}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", max_size=30), st.text(alphabet="abc", max_size=30))
def test_bit_parallel_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    assert leakage._lcs(a, b) == t[-1, -1]


# --- 8 ---


def test_abuse(spark):
    bad = ["You are an idiot and a scumbag.", "Drop dead, m o r o n.", "你们客服全是白痴,去死吧。", "Lonely and horny, looking for nude pictures tonight.", "People like the Velmari are vermin and should be driven out of this town.", "Halt die Fresse, du Trottel."]
    good = ["The trash bin was replaced.", "垃圾桶的最新价目表已寄出。", "A stupid mistake on my side, please excuse the typing error.", "Please kill the print process.", "Sex: F, date of birth withheld."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(bad * 4 + good * 4)] + [(100, None), (101, "")], "doc_id long, text string")
    scored = abuse.scores(docs)
    found = {(r["doc_id"], r["kind"]) for r in abuse.found_kinds(scored).collect()}
    want = ["abuse", "abuse", "abuse", "sexual", "hate", "abuse"]
    assert {(i, want[i % 6]) for i in range(24)} <= found and not [x for x in found if x[0] >= 24]
    rates = abuse.source_rates(docs.withColumn("source", F.lit("s")), scored).first()
    assert rates["documents"] == 46 and rates["any_documents"] == 24


def test_abuse_outside_the_tables(spark):
    """Sentences that occur in no table; voters see them, plain mention they leave alone."""
    bad = {"abuse": ["You are a complete clown and nobody likes you.", "I hope you die in a fire.", "Du bist so ein Feigling, keiner mag dich."], "hate": ["Those immigrants are animals and should be driven out.", "Alle Ausländer sind Ungeziefer."], "sexual": ["Send me a naked selfie of yours tonight."]}
    plain = ["The animals are fed at noon.", "He is a member of the fire brigade.", "The pack-", "A curved trolley fol-", "Nobody was hurt in the fire.", "The clown show starts at nine."]
    texts = [t for some in bad.values() for t in some] * 6 + plain * 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(texts[r["doc_id"]], r["kind"]) for r in abuse.found_kinds(abuse.scores(docs)).collect()}
    assert {(t, k) for k, some in bad.items() for t in some} <= found and not [t for t, _ in found if t in plain]


def test_score_of_every_row(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "You idiot, drop dead.", "x"), (4, "You idiot, drop dead.", "x"), (None, "a", "x")], "doc_id long, text string, bits string")
    assert sorted(r["doc_id"] or 0 for r in abuse.scores(docs).collect()) == [0, 1, 2, 3, 4, 4]
    assert abuse.scores(docs.limit(0)).count() == 0
    report = {r["voter"]: r for r in abuse.voter_report(docs).collect()}
    assert len(report) == len(abuse.VOTERS) and report["insult"]["segments"] == 2 and report["dismiss"]["overlapping"] == 2


def test_disguises():
    assert "moron" in abuse.plain("m.o.r.o.n") and "idiot" in abuse.plain("1d1ot") and "moron" in abuse.plain("moooron") and "idiot" in abuse.plain("id**t") and "王八蛋" in abuse.plain("王 八 蛋")


def test_votes_are_not_cut_by_the_prefilter():
    r = random.Random(2)
    words = {w for *_, pattern in abuse.VOTERS for w in re.findall(r"[^\W\d_]+", pattern.pattern)} | {"you", "the", "velmari", "人", "都", "是"}
    said = ["you are disgusting, worthless and pathetic", "this damn thing", "fucking useless", "that lot again", "die velmari sind alle so", "they are all the same", "维玛人都是这样", "维玛族都是这样", "瞎了你", "nacktheit", "preise auf anfrage", "preis auf anfrage", "what filthy work", "verdammter mist", "dummer kerl"]
    said += [r.choice(["", "so "]) + " ".join(r.sample(sorted(words), r.randint(1, 5))) + r.choice(["", " too"]) for _ in range(20000)]
    said += ["".join(r.sample(sorted(words), 2)) for _ in range(2000)]
    assert abuse.votes(said) == [abuse.vote(s) for s in said] and all(abuse.vote(s) for s in said[:15])

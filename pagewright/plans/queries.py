"""Named queries over a folder of tables, and the same in SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, session
from ..functions import payload, text
from ..operators import attribute, ground, layout, lifecycle, markup, quality, rollup, segment
from ..providers import prompt_column
from ..sinks import writers
from ..sources import readers
from ..streaming import streams
from . import extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query and its SQL.  Times of arrival come out as microseconds, so that both engines show them alike."""

    def put(f):
        def run(spark, d):
            df = f(spark, d)
            return df.withColumn("ingested_at", F.unix_micros("ingested_at")) if dict(df.dtypes).get("ingested_at") == "timestamp" else df

        QUERIES[f.__name__] = run
        if sql:
            shown = "ingested_at" in sql.split("FROM")[0]
            ORACLES[f.__name__] = f"SELECT * REPLACE (epoch_us(ingested_at) AS ingested_at) FROM ({sql})" if shown else sql
        return f

    return put


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import made

    return QUERIES | made.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import made

    return ORACLES | made.ORACLES


# blanks as str.isspace knows them, as a class for RE2
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WIDE_DIGITS = "translate({0}, '０１２３４５６７８９', '0123456789')"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# --- the core query -----------------------------------------------------------------------------------


@query()
def flagship_extract(spark, d):
    columns = [{"name": "email", "type": "email"}, {"name": "label", "type": "string"}]
    return extract.wide(extract.extract_rows(T(spark, d, "documents"), columns=columns), columns)


@query()
def extract_strict(spark, d):
    return extract.extract_rows(T(spark, d, "documents"), mode="strict").select("doc_id", "values", "classification")


@query()
def extract_with_ocr_fallback(spark, d):
    layers = T(spark, d, "text_layers").select("page_id", "text")
    pages = T(spark, d, "ocr_pages").select("page_id", "text")
    return extract.with_fallback(layers, pages, lambda t: extract.extract_rows(t, key="page_id")).select("page_id", "values", "classification")


# --- sources ------------------------------------------------------------------------------------------


@query("SELECT sha256('text|' || CAST(doc_id AS VARCHAR)) AS task_id, 'text' AS source_type, text AS source_value, 'pending' AS status FROM documents WHERE text IS NOT NULL")
def text_tasks(spark, d):
    return readers.text_tasks(T(spark, d, "documents"), "doc_id", "text")


@query("""SELECT l.page_id, CASE WHEN coalesce(l.char_count, 0) >= greatest(coalesce(max(c.pdf_text_layer_min_chars), 40), 1) THEN 'text_layer' ELSE 'ocr' END AS strategy
FROM text_layers l LEFT JOIN (SELECT task_id, min(config_id) AS config_id FROM tasks GROUP BY task_id) t USING (task_id) LEFT JOIN app_configs c ON t.config_id = c.config_id GROUP BY l.page_id, l.char_count""")
def text_layer_gate(spark, d):
    tasks = T(spark, d, "tasks").groupBy("task_id").agg(F.min("config_id").alias("config_id"))
    limits = T(spark, d, "app_configs").groupBy("config_id").agg(F.max("pdf_text_layer_min_chars").alias("least"))
    joined = T(spark, d, "text_layers").select("page_id", "task_id", "char_count").join(tasks, "task_id", "left").join(limits, "config_id", "left")
    return joined.select("page_id", readers.page_strategy(F.col("char_count"), F.coalesce("least", F.lit(40))).alias("strategy"))


@query("""SELECT task_id, ingested_at, CASE WHEN source_type IS DISTINCT FROM 'pdf' THEN 'E_PDF_001' WHEN coalesce(pdf_total_pages, 0) <= 0 THEN 'E_PDF_002' WHEN length(coalesce(source_value, '')) > 60 THEN 'E_PDF_004' WHEN pdf_total_pages > 5 THEN 'E_PDF_003' END AS error_code FROM tasks""")
def pdf_limits(spark, d):
    tasks = T(spark, d, "tasks").withColumn("bytes", F.length(F.coalesce("source_value", F.lit(""))))
    return readers.pdf_limits(tasks, F.coalesce("pdf_total_pages", F.lit(0)), 60, 5).select("task_id", "ingested_at", "error_code")


@query("""SELECT p.page_id, list_avg(list(b.score)) AS ocr_confidence, min(b.score) AS confidence_min, count(*) AS n_blocks
FROM (SELECT DISTINCT page_id FROM ocr_pages) p JOIN (SELECT DISTINCT block_id, page_id, score FROM ocr_blocks) b USING (page_id) GROUP BY p.page_id""")
def remote_results(spark, d):
    blocks = layout.page_blocks(T(spark, d, "ocr_blocks")).join(T(spark, d, "ocr_pages").select("page_id").distinct(), "page_id", "left_semi")
    body = F.struct(F.lit(0).alias("errorCode"), F.struct(F.array(F.struct(F.struct(F.col("blocks.text").alias("rec_texts"), F.col("blocks.score").alias("rec_scores"), F.col("blocks.box").alias("rec_polys")).alias("prunedResult"))).alias("ocrResults")).alias("result"))
    lines = blocks.select("page_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))
    return readers.remote_pages(lines, key="page_id").select("page_id", "ocr_confidence", "confidence_min", F.size("blocks").alias("n_blocks"))


@query("SELECT block_id, text, score FROM ocr_blocks")
def raw_recognition(spark, d):
    """Legacy pairs [box, [text, score]] as JSON, decoded again."""
    pair = F.concat(F.lit("["), F.to_json("box"), F.lit(",["), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit(","), F.coalesce(F.col("score").cast("string"), F.lit("null")), F.lit("]]"))
    made = T(spark, d, "ocr_blocks").select("block_id", pair.alias("payload"))
    found = made.withColumn("blocks", readers.blocks_of_payload(F.col("payload")))
    return found.select("block_id", F.get("blocks", F.lit(0))["text"].alias("text"), F.get("blocks", F.lit(0))["score"].alias("score"))


@query("""SELECT p_partkey, greatest(1, CAST(round(p_size * 400 * least(1.0, 4000.0 / greatest(p_size * 400, p_size * 100 + 37))) AS INT)) AS width, greatest(1, CAST(round((p_size * 100 + 37) * least(1.0, 4000.0 / greatest(p_size * 400, p_size * 100 + 37))) AS INT)) AS height FROM part""")
def fitted_sizes(spark, d):
    return T(spark, d, "part").select("p_partkey", readers.fitted_size(F.col("p_size") * 400, F.col("p_size") * 100 + 37).alias("s")).select("p_partkey", "s.width", "s.height")


# --- functions ----------------------------------------------------------------------------------------


@query(f"SELECT row_id, ingested_at, {strip_sql('buyer_name')} AS name FROM invoices")
def stripped_names(spark, d):
    return T(spark, d, "invoices").select("row_id", "ingested_at", text.strip_u("buyer_name").alias("name"))


@query(f"""SELECT row_id, ingested_at, CASE WHEN starts_with(s, '+') THEN '+' ELSE '' END || regexp_replace(s, '[^0-9]', '', 'g') AS phone, length(regexp_replace(s, '[^0-9]', '', 'g')) BETWEEN 7 AND 18 AS valid
FROM (SELECT row_id, ingested_at, {strip_sql(WIDE_DIGITS.format('buyer_addr_phone'))} AS s FROM invoices)""")
def phone_extract_typed(spark, d):
    s = F.translate("buyer_addr_phone", "０１２３４５６７８９", "0123456789")
    return T(spark, d, "invoices").select("row_id", "ingested_at", text.normalize_phone(s).alias("phone"), text.is_valid_phone(s).alias("valid"))


@query(r"""SELECT block_id, lower(e) AS email FROM (SELECT DISTINCT block_id, text FROM ocr_blocks), unnest(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+')) AS u(e)
WHERE NOT ends_with(e, '.') AND NOT contains(e, '..') AND NOT contains(split_part(e, '@', 2), '-.')""")
def email_extract_typed(spark, d):
    blocks = T(spark, d, "ocr_blocks").select("block_id", "text").distinct()
    found = blocks.select("block_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"), F.lit(0))).alias("e"))
    return found.where(text.is_valid_email("e") & ~F.contains(F.split_part("e", F.lit("@"), F.lit(2)), F.lit("-.")) & ~F.contains("e", F.lit(".."))).select("block_id", text.normalize_email("e").alias("email"))


_AMOUNT = strip_sql("amount")


@query(f"""SELECT row_id, ingested_at, TRY_CAST(replace({strip_sql(f"regexp_replace({_AMOUNT}, '^[¥￥$€£]+|[¥￥$€£]+$', '', 'g')")}, ',', '') AS DOUBLE) AS amount FROM invoices""")
def number_cast(spark, d):
    return T(spark, d, "invoices").select("row_id", "ingested_at", text.parse_number("amount").alias("amount"))


_DATE = strip_sql("issue_date")
_DATE_SQL = "coalesce(" + ", ".join(f"CAST(try_strptime({_DATE}, '{f}') AS DATE)" for f in ("%Y年%m月%d日", "%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y")) + ")"
_FORMATS = ["%Y年%m月%d日", "%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y"]


@query(f"SELECT row_id, ingested_at, {_DATE_SQL} AS issued FROM invoices")
def date_cast(spark, d):
    return T(spark, d, "invoices").select("row_id", "ingested_at", text.parse_date("issue_date", _FORMATS).alias("issued"))


_SPECS = [{"name": "issue_date", "type": "date", "formats": _FORMATS}, {"name": "amount", "type": "number"}, {"name": "buyer_addr_phone", "type": "phone"}]


@query(f"""SELECT count_if({strip_sql("coalesce(issue_date, '')")} <> '' AND {_DATE_SQL} IS NULL) AS w_norm_date,
count_if({strip_sql("coalesce(amount, '')")} <> '' AND TRY_CAST(replace({strip_sql(f"regexp_replace({_AMOUNT}, '^[¥￥$€£]+|[¥￥$€£]+$', '', 'g')")}, ',', '') AS DOUBLE) IS NULL) AS w_norm_num FROM invoices""")
def cast_warnings(spark, d):
    typed = T(spark, d, "invoices").select(quality.canonical_cells(F.array("issue_date", "amount", "buyer_addr_phone"), _SPECS).alias("t"))
    return typed.agg(F.count_if(F.get("t", F.lit(0))["warning"] == "W_NORM_DATE").alias("w_norm_date"), F.count_if(F.get("t", F.lit(1))["warning"] == "W_NORM_NUM").alias("w_norm_num"))


@query()
def typed_cells(spark, d):
    return T(spark, d, "invoices").select("row_id", F.inline(quality.canonical_cells(F.array("issue_date", "amount", "buyer_addr_phone"), _SPECS)))


_PAD = ", ".join(f"coalesce(nullif({strip_sql(c)}, ''), ' ')" for c in ("invoice_no", "buyer_name", "amount"))


@query(f"SELECT row_id, ingested_at, [{_PAD}, ' ', ' '] AS cells, [{_PAD}][1:2] AS cut FROM invoices")
def normalize_pad_truncate(spark, d):
    rows = F.array(F.array("invoice_no", "buyer_name", "amount"))
    return T(spark, d, "invoices").select("row_id", "ingested_at", F.get(payload.normalize_rows(rows, 5), F.lit(0)).alias("cells"), F.get(payload.normalize_rows(rows, 2), F.lit(0)).alias("cut"))


_INFER = ("invoice_no", "buyer_name", "seller_addr_phone", "amount", "item_name")


@query(f"""WITH v AS ({' UNION ALL '.join(f"SELECT '{c}' AS name, {c} AS value FROM invoices" for c in _INFER)} UNION ALL SELECT 'mail' , lower(regexp_extract(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+')) FROM ocr_blocks WHERE regexp_matches(text, '[A-Za-z0-9]@[A-Za-z0-9-]+\\.[a-z]')),
s AS (SELECT name, {strip_sql('value')} AS v FROM v WHERE {strip_sql("coalesce(value, '')")} <> ''), e AS (SELECT name, bool_and(regexp_matches(v, '[^\\s]@[^\\s]+\\.[^\\s]')) AS mail,
bool_or(regexp_matches(lower(v), '有限公司|有限责任公司|股份有限公司|集团|分公司|研究院|事务所|co\\., ltd|inc\\.|llc|ltd\\.')) AS company, bool_and(length(regexp_replace(translate(v, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g')) BETWEEN 7 AND 18 AND NOT regexp_matches(v, '^[0-9]+$') AND regexp_matches(v, '[+ ()-]')) AS phone FROM s GROUP BY name)
SELECT name, CASE WHEN mail THEN 'email' WHEN company THEN 'company' WHEN phone THEN 'phone' ELSE 'string' END AS type FROM e""")
def infer_types(spark, d):
    values = T(spark, d, "invoices").select(F.explode(F.create_map(*[x for c in _INFER for x in (F.lit(c), F.col(c))])).alias("name", "value"))
    mails = T(spark, d, "ocr_blocks").where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).select(F.lit("mail").alias("name"), F.lower(F.regexp_extract("text", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+", 0)).alias("value"))
    return values.unionByName(mails).groupBy("name").agg(text.infer_type(F.col("name"), F.col("value")).alias("type"))


@query(rf"SELECT block_id, {strip_sql(f"regexp_replace(text, '{WS}+', ' ', 'g')")} AS text FROM (SELECT DISTINCT block_id, text FROM ocr_blocks)")
def normalized_blocks(spark, d):
    return T(spark, d, "ocr_blocks").select("block_id", "text").distinct().select("block_id", text.normalize_block_text("text").alias("text"))


@query("SELECT task_id, ingested_at, CASE WHEN length(display_name) > 15 THEN substr(display_name, 1, 15) || '…' ELSE display_name END AS label, CASE WHEN status = 'done' THEN 100 ELSE greatest(0, least(100, coalesce(pdf_total_pages, 0) * 7)) END AS progress FROM tasks")
def task_labels(spark, d):
    return T(spark, d, "tasks").select("task_id", "ingested_at", text.truncate_label("display_name").alias("label"), text.clamp_progress(F.col("pdf_total_pages") * 7, F.col("status")).alias("progress"))


@query(r"""SELECT task_id, ingested_at, CASE WHEN length(c) > room THEN CASE WHEN regexp_replace(substr(c, 1, room), '[ ._]+$', '') = '' THEN 'export' ELSE regexp_replace(substr(c, 1, room), '[ ._]+$', '') END ELSE c END || e AS file_name FROM
(SELECT *, CASE WHEN k = '' THEN 'export' ELSE k END AS c, greatest(1, 120 - length(e)) AS room FROM
(SELECT task_id, ingested_at, CASE WHEN x <> '' THEN x ELSE '.xlsx' END AS e, regexp_replace(trim(regexp_replace(CASE WHEN x <> '' THEN substr(l, 1, length(l) - length(x)) ELSE n END, '[<>:"/\\|?*\x00-\x1f]', '', 'g')), '\.+$', '') AS k FROM
(SELECT *, regexp_extract(l, '^.+(\.[^.]+)$', 1) AS x FROM (SELECT *, regexp_replace(regexp_replace(n, '/+$', ''), '^.*/', '') AS l FROM (SELECT task_id, ingested_at, coalesce(nullif(trim(display_name), ''), 'example.xlsx') AS n FROM tasks)))))""")
def export_names(spark, d):
    return T(spark, d, "tasks").select("task_id", "ingested_at", text.safe_file_name("display_name").alias("file_name"))


@query("SELECT config_id, CASE WHEN extraction_max_char_buffer > 0 THEN extraction_max_char_buffer ELSE 2200 END AS buffer, CASE WHEN extraction_passes_increment > 0 THEN extraction_passes_increment ELSE 800 END AS step FROM app_configs")
def coerced_configs(spark, d):
    return T(spark, d, "app_configs").select("config_id", text.safe_positive_int("extraction_max_char_buffer", 2200).alias("buffer"), text.safe_positive_int("extraction_passes_increment", 800).alias("step"))


@query("""SELECT t.task_id, t.ingested_at, coalesce(c.extraction_profile, 'balanced') AS profile FROM tasks t LEFT JOIN app_configs c ON t.config_id = c.config_id""")
def config_lookup(spark, d):
    configs = T(spark, d, "app_configs").select("config_id", "extraction_profile")
    return T(spark, d, "tasks").join(configs, "config_id", "left").select("task_id", "ingested_at", F.coalesce("extraction_profile", F.lit("balanced")).alias("profile"))


@query()
def template_columns(spark, d):
    return config.default_catalog().frame(spark)


# --- payloads -----------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_event_props(spark, d):
    return T(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT row_id, ingested_at, [coalesce(invoice_no, ' '), coalesce(amount, ' ')] AS cells, NULL::VARCHAR AS error_code FROM invoices")
def parse_json_rows(spark, d):
    answer = F.concat(F.lit("<think>rows [1]</think>```json\n{\"rows\": "), F.to_json(F.array(F.array(F.coalesce("invoice_no", F.lit(" ")), F.coalesce("amount", F.lit(" "))))), F.lit("}\n```"))
    made = T(spark, d, "invoices").select("row_id", "ingested_at", payload.parse_rows(answer).alias("p"))
    return made.select("row_id", "ingested_at", F.get("p.rows", F.lit(0)).alias("cells"), "p.error_code")


@query("SELECT row_id, ingested_at, [coalesce(amount, ' '), ' ', coalesce(invoice_no, ' ')] AS cells FROM invoices")
def parse_object_rows(spark, d):
    answer = F.to_json(F.array(F.struct(F.coalesce("invoice_no", F.lit(" ")).alias("no"), F.coalesce("amount", F.lit(" ")).alias("amount"))))
    made = T(spark, d, "invoices").select("row_id", "ingested_at", payload.parse_object_rows(answer)["rows"].alias("r"))
    return made.select("row_id", "ingested_at", F.get(payload.objects_to_arrays(F.col("r"), ["amount", "gone", "no"]), F.lit(0)).alias("cells"))



@query("""SELECT unit_id, length(text) + length('rows' || chr(10) || chr(10) || 'examples:' || chr(10) || '[["a", "b"]]' || chr(10) || chr(10) || 'pass: 1/2' || chr(10) || 'text:' || chr(10) || '<<<' || chr(10) || chr(10) || '>>>' || chr(10) || 'Do not copy the examples.') AS prompt_chars FROM chunk_units WHERE text IS NOT NULL""")
def chunk_prompts(spark, d):
    prompts = T(spark, d, "chunk_units").where("text is not null").withColumn("m", prompt_column(F.col("text"), F.lit(1), F.lit(2), "rows", [["a", "b"]]))
    return prompts.select("unit_id", F.length(F.get("m", F.lit(1))["content"]).alias("prompt_chars"))


# --- segmentation -------------------------------------------------------------------------------------



@query("SELECT doc_id, CAST(k AS INT) AS fragment, substr(text, CAST(k AS INT) * 500 + 1, 500) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 500.0) AS BIGINT)))) AS k FROM documents WHERE text IS NOT NULL)")
def char_fragments(spark, d):
    docs = T(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("text") / 500.0).cast("int")) - 1)).alias("fragment")).select("doc_id", "fragment", F.substr("text", F.col("fragment") * 500 + 1, F.lit(500)).alias("piece"))


def _passes(profile: str):
    def run(spark, d):
        return segment.chunk_passes(T(spark, d, "documents").select("doc_id", "text"), "text", profile).select("doc_id", "pass_index", "total_passes", "start", "end", "chunk")

    return run


QUERIES["chunk_passes_balanced"], QUERIES["chunk_passes_accurate"] = _passes("balanced"), _passes("accurate")


@query("SELECT doc_id, 1 AS pass_index, 1 AS total_passes, 0 AS start, length(text) AS \"end\", text AS chunk FROM documents WHERE text IS NOT NULL")
def chunk_passes_fast(spark, d):
    return _passes("fast")(spark, d)


@query()
def markdown_passes(spark, d):
    return segment.markdown_chunks(T(spark, d, "ocr_pages").select("page_id", "markdown_text"), limit=600)


@query()
def line_rule_items(spark, d):
    pages = T(spark, d, "ocr_pages").select("page_id", "text")
    rows = segment.line_rule_rows(pages, config.INVOICE.line_rules)
    return rows.select("page_id", "block_index", "row_index", F.col("fields")["项目名称"].alias("item"), F.col("fields")["金额"].alias("amount"), F.col("fields")["税率"].alias("rate"))


@query()
def line_rule_parents(spark, d):
    pages = T(spark, d, "ocr_pages").select("page_id", "text")
    rows = segment.line_rule_rows(pages, config.INVOICE.line_rules).select("page_id", "block_index", "row_index", "fields")
    number = F.regexp_extract("text", "发票号码[:：](\\d+)", 1)
    parents = pages.where(number != "").select("page_id", F.lit(0).alias("block_index"), F.create_map(F.lit("发票号码"), number).alias("parent"))
    return segment.backfill_parents(rows, parents, ["page_id"], ["发票号码"]).select("page_id", "block_index", "row_index", F.col("fields")["发票号码"].alias("invoice_no"))


@query("SELECT task_id, string_agg('[PAGE ' || page_index || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY page_index, text) AS document_text FROM ocr_pages GROUP BY task_id")
def document_text(spark, d):
    return rollup.document_text(T(spark, d, "ocr_pages"))


# --- grounding ----------------------------------------------------------------------------------------

_CELLS = "(SELECT DISTINCT i.row_id, i.seller_name AS v, p.page_id, p.text AS t FROM invoices i JOIN ocr_pages p ON i.task_id = p.task_id AND i.page_index = p.page_index WHERE p.text IS NOT NULL)"
def _cells(spark, d):
    i, p = T(spark, d, "invoices"), T(spark, d, "ocr_pages").where("text is not null")
    return i.select("row_id", "task_id", "page_index", F.col("seller_name").alias("v")).join(p.select("task_id", "page_index", "page_id", F.col("text").alias("t")), ["task_id", "page_index"]).select("row_id", "v", "page_id", "t").distinct()


def _edge_sql(x: str) -> str:
    return f"({x} = '' OR regexp_matches({x}, '^{WS}$') OR {x} IN ('。', '，', '；', '！', '？', chr(10), ',', ':', '：', ';'))"


_EXACT_SQL = f"""CASE WHEN coalesce(v, '') = '' OR instr(t, v) = 0 THEN NULL WHEN {_edge_sql("(CASE WHEN instr(t, v) > 1 THEN substr(t, instr(t, v) - 1, 1) ELSE '' END)")} AND {_edge_sql('substr(t, instr(t, v) + length(v), 1)')} THEN 'ASSIGNED' ELSE 'ASSIGNED_PARTIAL' END"""


@query(f"SELECT row_id, page_id, v, {_EXACT_SQL} AS status FROM {_CELLS}")
def ground_exact(spark, d):
    return _cells(spark, d).select("row_id", "page_id", "v", ground.exact_status(F.col("v"), F.col("t")).alias("status"))


@query(f"SELECT row_id, page_id, v, CASE WHEN regexp_replace(v, '{WS}+', '', 'g') <> '' AND instr(lower(regexp_replace(t, '{WS}+', '', 'g')), lower(regexp_replace(v, '{WS}+', '', 'g'))) > 0 OR regexp_replace(v, '[^\\p{{L}}\\p{{N}}]+', '', 'g') <> '' AND instr(lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lower(regexp_replace(v, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) > 0 THEN 'ASSIGNED' END AS status FROM {_CELLS}")
def ground_compact(spark, d):
    return _cells(spark, d).select("row_id", "page_id", "v", ground.compact_status(F.col("v"), F.col("t")).alias("status"))


@query()
def ground_cells(spark, d):
    cells = _cells(spark, d).select("row_id", "page_id", F.array("v").alias("values"), F.col("t").alias("source_text"))
    return ground.ground_cells(cells).select("row_id", "page_id", F.inline("cells"))


@query(f"SELECT count(*) AS rows, count_if(s = 'ASSIGNED') AS assigned, count_if(s = 'ASSIGNED_PARTIAL') AS partial, sum(CASE s WHEN 'ASSIGNED' THEN 5 WHEN 'ASSIGNED_PARTIAL' THEN 4 ELSE 1 END) AS ranks FROM (SELECT {_EXACT_SQL} AS s FROM {_CELLS})")
def grounding_ranks(spark, d):
    s = _cells(spark, d).select(ground.exact_status(F.col("v"), F.col("t")).alias("s"))
    return s.agg(F.count("*").alias("rows"), F.count_if(F.col("s") == "ASSIGNED").alias("assigned"), F.count_if(F.col("s") == "ASSIGNED_PARTIAL").alias("partial"), F.sum(ground.status_rank(F.coalesce("s", F.lit("UNCERTAIN")))).alias("ranks"))




@query(r"SELECT row_id, ingested_at, list_filter(string_split_regex(seller_addr_phone, '[；;、，,\n]'), lambda s: regexp_replace(s, '" + WS + r"+', '', 'g') <> '') AS parts FROM invoices")
def value_segments(spark, d):
    return T(spark, d, "invoices").select("row_id", "ingested_at", ground.value_segments(F.col("seller_addr_phone")).alias("parts"))


# --- distinct rows ------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedupe_rows(spark, d):
    docs = T(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return ground.distinct_on_aggregated(docs, ["text"], F.lit(1), ["doc_id"]).select("doc_id", "text")


@query("SELECT seller_name, row_id FROM (SELECT *, row_number() OVER (PARTITION BY seller_name ORDER BY ocr_confidence DESC NULLS LAST, row_id, ingested_at) AS n FROM invoices) WHERE n = 1")
def distinct_on_rank(spark, d):
    rows = T(spark, d, "invoices").select("seller_name", "row_id", "ingested_at", "ocr_confidence")
    return ground.distinct_on_aggregated(rows, ["seller_name"], F.coalesce("ocr_confidence", F.lit(-1.0)), ["row_id", "ingested_at"]).select("seller_name", "row_id")


@query()
def near_dup_contacts(spark, d):
    i = T(spark, d, "invoices").where("seller_name is not null")
    contacts = i.select("task_id", "row_id", F.array("seller_name", "seller_name", F.lit(" "), F.coalesce("seller_addr_phone", F.lit(" ")), F.lit(" "), F.lit(" "), F.lit(" ")).alias("values"), F.lit(1).alias("rank"))
    return ground.near_duplicate_contacts(contacts, "task_id", "row_id").select("task_id", "row_id", "values")


@query("""SELECT count(*) AS pairs FROM (SELECT DISTINCT task_id, regexp_replace(seller_tax_no, '[^0-9]', '', 'g') AS x FROM invoices WHERE seller_tax_no IS NOT NULL) a JOIN (SELECT DISTINCT task_id, regexp_replace(seller_tax_no, '[^0-9]', '', 'g') AS y FROM invoices WHERE seller_tax_no IS NOT NULL) b USING (task_id) WHERE x < y AND x <> '' AND levenshtein(x, y) <= 1""")
def phone_equivalence(spark, d):
    n = T(spark, d, "invoices").where("seller_tax_no is not null").select("task_id", F.regexp_replace("seller_tax_no", "[^0-9]", "").alias("x")).distinct()
    return n.join(n.withColumnRenamed("x", "y"), "task_id").where((F.col("x") < F.col("y")) & text.phone_equivalent("x", "y")).agg(F.count("*").alias("pairs"))


# --- layout and geometry ------------------------------------------------------------------------------

_AREAS = [(0.0, 0.0, 200.0, 120.0), (300.0, 400.0, 250.0, 380.0)]
_BOXED = "(SELECT DISTINCT block_id, list_min([p[1] for p in box]) AS l, list_min([p[2] for p in box]) AS t, list_max([p[1] for p in box]) AS r, list_max([p[2] for p in box]) AS b FROM ocr_blocks)"


@query(f"SELECT * FROM {_BOXED}")
def block_edges(spark, d):
    e = layout.box_edges(F.col("box"))
    return T(spark, d, "ocr_blocks").select("block_id", e["left"].alias("l"), e["top"].alias("t"), e["right"].alias("r"), e["bottom"].alias("b")).distinct()


@query(f"SELECT block_id FROM {_BOXED} WHERE NOT coalesce(((l + r) / 2 BETWEEN 0 AND 200 AND (t + b) / 2 BETWEEN 0 AND 120) OR ((l + r) / 2 BETWEEN 250 AND 300 AND (t + b) / 2 BETWEEN 380 AND 400), false)")
def ignore_areas(spark, d):
    return T(spark, d, "ocr_blocks").where(~layout.inside_any(F.col("box"), _AREAS)).select("block_id").distinct()


@query(f"SELECT block_id, l + 10.5 AS l, t - 3.0 AS t FROM {_BOXED}")
def shifted_blocks(spark, d):
    moved = T(spark, d, "ocr_blocks").select("block_id", layout.box_edges(layout.shift_box(F.col("box"), F.lit(10.5), F.lit(-3.0))).alias("e"))
    return moved.select("block_id", F.col("e.left").alias("l"), F.col("e.top").alias("t")).distinct()


_PAGES = "(SELECT page_id, list(score ORDER BY line_no, block_id) AS s FROM (SELECT DISTINCT block_id, page_id, line_no, score FROM ocr_blocks) GROUP BY page_id)"


@query(f"SELECT page_id, list_avg(s) AS avg_score, list_min(s) AS min_score, len(list_filter(s, lambda x: x IS NOT NULL)) > 0 AND (len(list_filter(s, lambda x: x < 0.8)) >= 6 OR (len(list_filter(s, lambda x: x < 0.8)) >= 2 AND len(list_filter(s, lambda x: x < 0.8)) / len(list_filter(s, lambda x: x IS NOT NULL)) >= 0.5 AND list_avg(s) < 0.7)) AS retry FROM {_PAGES}")
def page_confidence(spark, d):
    pages = layout.page_blocks(T(spark, d, "ocr_blocks"))
    s = F.col("blocks.score")
    c = layout.page_confidence(s)
    return pages.select("page_id", c["avg"].alias("avg_score"), c["min"].alias("min_score"), layout.needs_retry(s, 0.8).alias("retry"))


@query("""SELECT page_id, coalesce(b2 >= block_count - 2 AND 0.5 * m2 + 0.5 * a2 > 0.5 * confidence_min + 0.5 * ocr_confidence + 0.03, false) AS better FROM
(SELECT *, block_count - page_id % 5 AS b2, confidence_min + 0.1 * (page_id % 3) AS m2, ocr_confidence + 0.02 AS a2 FROM ocr_pages)""")
def retry_choice(spark, d):
    second = (F.col("block_count") - F.col("page_id") % 5, F.col("confidence_min") + F.lit(0.1) * (F.col("page_id") % 3), F.col("ocr_confidence") + 0.02)
    return T(spark, d, "ocr_pages").select("page_id", layout.second_is_better(F.col("block_count"), F.col("confidence_min"), F.col("ocr_confidence"), *second).alias("better"))


def _layout(parser: str):
    def run(spark, d):
        pages = layout.page_blocks(T(spark, d, "ocr_blocks"))
        return pages.select("page_id", layout.layout(F.col("blocks"), F.lit(parser))["text"].alias("text"))

    return run


for _p in ("multi_para", "multi_line", "multi_none", "single_para", "single_line", "single_none", "single_code", "none"):
    QUERIES[f"layout_{_p}"] = _layout(_p)


@query()
def layout_by_config(spark, d):
    configs = T(spark, d, "app_configs").select("config_id", "ocr_layout_parser")
    of = T(spark, d, "ocr_blocks").groupBy("page_id").agg(F.min("config_id").alias("config_id")).join(configs, "config_id", "left")
    pages = layout.page_blocks(T(spark, d, "ocr_blocks")).join(of, "page_id")
    return pages.select("page_id", "ocr_layout_parser", layout.layout(F.col("blocks"), F.coalesce("ocr_layout_parser", F.lit("none")))["text"].alias("text"))


@query("""SELECT page_id, string_agg(text, chr(10) ORDER BY t, l, line_no, block_id) AS text FROM (SELECT DISTINCT b.block_id, page_id, line_no, text, l, t FROM ocr_blocks b JOIN """ + _BOXED + """ x ON b.block_id = x.block_id WHERE text IS NOT NULL AND trim(text, ' ') <> '') GROUP BY page_id""")
def merged_fragments(spark, d):
    pages = layout.page_blocks(T(spark, d, "ocr_blocks"))
    fragments = F.transform("blocks", lambda b: F.struct((-layout.box_edges(b["box"])["top"]).alias("top"), layout.box_edges(b["box"])["left"].alias("left"), b["text"].alias("text")))
    return pages.select("page_id", layout.merge_fragments(fragments).alias("text")).where("text <> ''")


@query()
def uncovered_regions(spark, d):
    rows = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity") * 8, F.col("l_quantity") * 10).alias("i"), F.array(F.lit(0.0), F.lit(0.0), (F.col("l_discount") * 2000), F.lit(100.0)).alias("t"))
    pages = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("i")).alias("images"), F.array_sort(F.collect_list("t")).alias("texts"))
    return pages.select("l_orderkey", F.size(layout.uncovered_regions(F.col("images"), F.col("texts"), F.lit(600.0), F.lit(800.0))).alias("regions"))




@query("""SELECT task_id, row_id, attempt FROM (SELECT task_id, row_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY row_id, ingested_at) AS INT) AS attempt FROM invoices WHERE coalesce(buyer_tax_no, ' ') = ' ') WHERE attempt <= 5""")
def rescue_budget(spark, d):
    cells = T(spark, d, "invoices").select("task_id", "row_id", F.struct("row_id", "ingested_at").alias("row_ordinal"), F.lit(1).alias("column_ordinal"), F.lit("buyer_tax_no").alias("field_name"), F.when(F.coalesce("buyer_tax_no", F.lit(" ")) == " ", "UNCERTAIN").otherwise("ASSIGNED").alias("status"))
    regions = spark.createDataFrame([("buyer_tax_no", 0.18, 0.26, 0.64, 0.34)], "field_name string, l double, t double, r double, b double")
    return attribute.rescue_candidates(cells, regions).select("task_id", "row_id", "attempt")


# --- markup -------------------------------------------------------------------------------------------


@query()
def html_markdown(spark, d):
    return T(spark, d, "ocr_pages").select("page_id", markup.normalize_markdown(F.col("markdown_text")).alias("markdown"), markup.markdown_to_text(F.col("markdown_text")).alias("text"))


def _html(spark, d):
    cells = F.concat(F.lit("<tr><td colspan='2'>"), F.coalesce("item_name", F.lit("")), F.lit("</td><td>"), F.coalesce("amount", F.lit("")), F.lit("</td></tr>"))
    rows = T(spark, d, "invoices").select("task_id", "row_id", "ingested_at", cells.alias("c"))
    return rows.groupBy("task_id").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "ingested_at", "c"))), lambda x: x["c"]), ""), F.lit("</table>")).alias("html"))


@query()
def html_table_cells(spark, d):
    return markup.html_tables(_html(spark, d), "task_id", "html")


# --- roll-ups and views -------------------------------------------------------------------------------


@query("""SELECT task_id, count(*) AS n_pages, avg(ocr_confidence) AS ocr_confidence, min(confidence_min) AS confidence_min, sum(coalesce(block_count, 0)) AS block_count, coalesce(bool_or(retry_triggered), false) AS retry_triggered, coalesce(bool_or(retry_applied), false) AS retry_applied FROM ocr_pages GROUP BY task_id""")
def page_rollup(spark, d):
    return rollup.document_rollup(T(spark, d, "ocr_pages"))


@query("""SELECT task_id, count(*) AS n_pages, avg(ocr_confidence) AS ocr_confidence, min(confidence_min) AS confidence_min, sum(coalesce(block_count, 0)) AS block_count, false AS retry_triggered, false AS retry_applied FROM ocr_pages GROUP BY task_id""")
def page_rollup_online(spark, d):
    return rollup.document_rollup(T(spark, d, "ocr_pages"), with_retry=False)


_PAGE_STATUS = "CASE WHEN ocr_confidence IS NULL THEN 'failed' WHEN block_count < 8 THEN 'empty' ELSE 'success' END"


@query(f"""WITH p AS (SELECT p.task_id, t.source_type, page_index, {_PAGE_STATUS} AS status FROM ocr_pages p JOIN (SELECT task_id, min(source_type) AS source_type FROM tasks GROUP BY task_id) t USING (task_id)),
c AS (SELECT task_id, source_type, count(*) AS pages, count_if(status = 'success') AS succeeded, count_if(status = 'empty') AS empty, count_if(status = 'failed') AS failed, min(CASE WHEN status = 'failed' THEN page_index END) AS first FROM p GROUP BY ALL)
SELECT task_id, pages, succeeded, empty, failed, CASE WHEN succeeded > 0 OR source_type <> 'pdf' THEN 'done' ELSE 'failed' END AS task_status,
CASE WHEN succeeded > 0 OR source_type <> 'pdf' THEN NULL WHEN failed = pages THEN 'E_OCR_004' ELSE 'E_PDF_005' END AS error_code,
CASE WHEN succeeded > 0 OR source_type <> 'pdf' THEN NULL WHEN failed = pages THEN 'page ' || first ELSE 'no rows: ' || pages || ' pages, ' || empty || ' empty, ' || failed || ' failed, first failed page ' || coalesce(CAST(first AS VARCHAR), '-') END AS error_message FROM c""")
def task_reducer(spark, d):
    kind = T(spark, d, "tasks").groupBy("task_id").agg(F.min("source_type").alias("source_type"))
    status = F.when(F.col("ocr_confidence").isNull(), "failed").when(F.col("block_count") < 8, "empty").otherwise("success")
    pages = T(spark, d, "ocr_pages").join(kind, "task_id").select("task_id", "source_type", "page_index", status.alias("status"), F.lit("E_OCR_004").alias("error_code"), F.concat(F.lit("page "), F.col("page_index").cast("string")).alias("error_message"))
    return rollup.task_completion(pages)


@query("SELECT count(*) AS total, count_if(status IN ('done', 'completed', 'success')) AS success, count_if(status = 'failed') AS failed, count_if(status = 'pending') AS pending, count_if(status = 'paused') AS paused FROM tasks")
def status_badges(spark, d):
    return rollup.status_badges(T(spark, d, "tasks"))


def _results(spark, d):
    return T(spark, d, "invoices").withColumn("action", F.coalesce("row_action", F.lit("write")))


@query("SELECT count_if(coalesce(row_action, 'write') = 'write' AND NOT is_error_row) AS selected, count(*) - count_if(coalesce(row_action, 'write') = 'write' AND NOT is_error_row) AS skipped, count(*) AS total FROM invoices")
def write_summary(spark, d):
    return rollup.write_summary(_results(spark, d))


@query("SELECT row_id, ingested_at FROM invoices WHERE coalesce(row_action, 'write') = 'write' AND NOT is_error_row")
def export_rows(spark, d):
    return rollup.export_rows(_results(spark, d)).select("row_id", "ingested_at")


@query("SELECT count(*) AS tasks, 100.0 * count_if(status IN ('done', 'failed')) / count(*) AS queue_complete_rate, true AS perf_001, true AS perf_002, count(*) > 0 AS perf_003, 100.0 * count_if(status IN ('done', 'failed')) / count(*) >= 99 AS rel_001, true AS rel_002 FROM tasks")
def reliability_report(spark, d):
    return rollup.reliability_report(T(spark, d, "tasks"))


@query("""WITH t AS (SELECT task_id, max(pdf_total_pages) AS declared, min(status) AS status FROM tasks GROUP BY task_id), s AS (SELECT task_id, count(DISTINCT page_index) AS n, max(page_index) AS top FROM ocr_pages GROUP BY task_id),
b AS (SELECT task_id, status, greatest(coalesce(declared, 0), coalesce(n, 0), coalesce(top, 0)) AS page_count FROM t LEFT JOIN s USING (task_id))
SELECT task_id, 'task' AS row_kind, NULL::INT AS page_index, page_count, status FROM b UNION ALL
SELECT b.task_id, 'page', CAST(i AS INT), page_count, CASE WHEN p.task_id IS NULL THEN 'missing' ELSE status END FROM (SELECT *, unnest(range(1, CAST(page_count AS BIGINT) + 1)) AS i FROM b WHERE page_count > 1) b LEFT JOIN (SELECT DISTINCT task_id, page_index FROM ocr_pages) p ON b.task_id = p.task_id AND b.i = p.page_index""")
def queue_snapshot(spark, d):
    tasks = T(spark, d, "tasks").groupBy("task_id").agg(F.max("pdf_total_pages").alias("pdf_total_pages"), F.min("status").alias("status"))
    return rollup.queue_snapshot(tasks, T(spark, d, "ocr_pages"))


@query("SELECT task_id, max(ingested_at) AS ingested_at FROM tasks GROUP BY task_id")
def latest_tasks(spark, d):
    return rollup.latest(T(spark, d, "tasks"), ["task_id"], "ingested_at").select("task_id", "ingested_at")


@query("SELECT row_id, task_id, amount FROM invoices WHERE task_id NOT IN (SELECT task_id FROM tasks WHERE status = 'failed' AND task_id IS NOT NULL) OR task_id IS NULL UNION ALL SELECT DISTINCT 'error-' || task_id, task_id, 'error' FROM tasks WHERE status = 'failed'")
def upsert_projection(spark, d):
    changes = T(spark, d, "tasks").where("status = 'failed'").select(F.concat(F.lit("error-"), "task_id").alias("row_id"), "task_id", F.lit("error").alias("amount")).distinct()
    return rollup.upsert(T(spark, d, "invoices").select("row_id", "task_id", "amount"), changes)


@query("""SELECT i.row_id, i.ingested_at, CASE WHEN is_error_row THEN coalesce(row_action, 'write') WHEN length(i.row_id) > 0 AND right(i.row_id, 1) = 'a' THEN 'skip' ELSE coalesce(row_action, 'write') END AS action FROM invoices i""")
def projected_results(spark, d):
    base = _results(spark, d)
    actions = base.where(F.right("row_id", F.lit(1)) == "a").select("row_id", F.lit("skip").alias("action"), F.lit(1).alias("seq")).distinct()
    return rollup.project_results(base, base.limit(0), actions).select("row_id", "ingested_at", "action")


@query("""SELECT code, event_type, count(*) AS n FROM (SELECT 'EVT-TASK-001' AS code, 'created' AS event_type FROM tasks UNION ALL SELECT 'EVT-TASK-002', 'started' FROM tasks WHERE started_at IS NOT NULL UNION ALL SELECT 'EVT-TASK-003', 'progressed' FROM ocr_pages
UNION ALL SELECT 'EVT-TASK-003', 'succeeded' FROM tasks WHERE status = 'done' UNION ALL SELECT 'EVT-TASK-004', 'failed' FROM tasks WHERE status = 'failed' UNION ALL SELECT 'EVT-TASK-005', 'row_extracted' FROM invoices) GROUP BY ALL""")
def task_events(spark, d):
    return rollup.task_events(T(spark, d, "tasks"), T(spark, d, "ocr_pages"), T(spark, d, "invoices")).groupBy("code", "event_type").agg(F.count("*").alias("n"))


@query("SELECT sha256(task_id || '|error') AS row_id, task_id, 'skip' AS action, true AS is_error_row, ['error', 'error', 'error'] AS values FROM (SELECT DISTINCT task_id FROM tasks WHERE status = 'failed')")
def failed_rows(spark, d):
    return rollup.build_failed_rows(T(spark, d, "tasks").where("status = 'failed'").select("task_id").distinct(), 3)


@query("SELECT sha256(task_id || '|' || page_index || '|0') AS row_id, task_id, page_index, [text] AS values, 'INFERRED' AS classification FROM ocr_pages WHERE task_id IS NOT NULL AND page_index IS NOT NULL")
def success_rows(spark, d):
    made = T(spark, d, "ocr_pages").where("task_id is not null and page_index is not null").select("task_id", "page_index", "ocr_confidence", F.array(F.array("text")).alias("values"), F.array(F.struct(F.array("text").alias("cells"), F.lit("INFERRED").alias("classification"))).alias("cells"))
    return rollup.build_success_rows(made).select("row_id", "task_id", "page_index", "values", "classification")


@query("SELECT page_id, task_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY page_index, page_id) AS INT) AS ordinal FROM ocr_pages")
def page_ordinals(spark, d):
    return rollup.with_ordinals(T(spark, d, "ocr_pages").select("page_id", "task_id", "page_index"), ["task_id"], ["page_index", "page_id"]).select("page_id", "task_id", "ordinal")


# --- states -------------------------------------------------------------------------------------------

_COMMANDS = {"click": "start", "view": "extract", "purchase": "finish", "error": "fail", "signup": "retry"}


def _commands(spark, d):
    e = T(spark, d, "events")
    mapped = F.col("event_type")
    for k, v in _COMMANDS.items():
        mapped = F.when(F.col("event_type") == k, v).otherwise(mapped)
    # a tenth of the events resumes what a retry has paused
    return e.select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 10 == 0, "resume").otherwise(mapped).alias("command"))


_STEP_SQL = "CASE " + " ".join(f"WHEN x.c = '{c}' AND a.s = '{s}' THEN '{n}'" for (c, s), n in lifecycle.TRANSITIONS.items()) + " END"


@query(f"""WITH RECURSIVE c AS (SELECT CAST(user_id AS VARCHAR) AS task_id, CASE WHEN event_id % 10 = 0 THEN 'resume' ELSE {'CASE event_type ' + ' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _COMMANDS.items()) + ' ELSE event_type END'} END AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT DISTINCT task_id, 'pending' AS s, 0 AS refused, NULL::VARCHAR AS e, 0::BIGINT AS n FROM c UNION ALL
SELECT a.task_id, coalesce({_STEP_SQL}, a.s), a.refused + CASE WHEN {_STEP_SQL} IS NULL THEN 1 ELSE 0 END, CASE WHEN {_STEP_SQL} IS NULL THEN {'CASE x.c ' + ' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in lifecycle.REFUSED.items()) + " ELSE 'E_UI_001' END"} ELSE a.e END, a.n + 1 FROM r a JOIN c x ON a.task_id = x.task_id AND x.n = a.n + 1)
SELECT task_id, s AS state, refused, e AS last_error FROM r QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC) = 1""")
def task_fsm_replay(spark, d):
    return lifecycle.replay_tasks(_commands(spark, d))


@query("""WITH RECURSIVE p AS (SELECT task_id, coalesce(retry_triggered, false) AS t, coalesce(retry_applied, false) AS a, row_number() OVER (PARTITION BY task_id ORDER BY page_index, coalesce(retry_triggered, false), coalesce(retry_applied, false)) AS n FROM ocr_pages),
r AS (SELECT DISTINCT task_id, 6 AS l, 0 AS k, false AS off, 0::BIGINT AS n FROM p UNION ALL SELECT r.task_id, CASE WHEN p.t AND NOT r.off THEN r.l - 1 ELSE r.l END, CASE WHEN p.t AND NOT r.off THEN CASE WHEN p.a THEN 0 ELSE r.k + 1 END ELSE r.k END,
r.off OR CASE WHEN p.t AND NOT r.off THEN r.l - 1 ELSE r.l END <= 0 OR CASE WHEN p.t AND NOT r.off THEN CASE WHEN p.a THEN 0 ELSE r.k + 1 END ELSE r.k END >= 2, r.n + 1 FROM r JOIN p ON r.task_id = p.task_id AND p.n = r.n + 1)
SELECT task_id, l AS budget_left, k AS streak, off AS disabled FROM r QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC) = 1""")
def retry_budget_replay(spark, d):
    return lifecycle.retry_budget(T(spark, d, "ocr_pages").where("task_id is not null"))


# --- quality ------------------------------------------------------------------------------------------

_PHASES = {"baseline": ("e", "c"), "improved": ("red", "rcd"), "final": ("zz", "z")}


def _samples(spark, d):
    parts = T(spark, d, "part")
    phases = F.explode(F.array(*[F.struct(F.lit(n).alias("phase"), F.replace("p_name", F.lit(a), F.lit(b)).alias("prediction")) for n, (a, b) in _PHASES.items()]))
    x = parts.select("p_name", "p_brand", "p_type", phases.alias("x"))
    return x.select("x.phase", F.col("p_name").alias("truth"), "x.prediction", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name")).alias("truth_fields"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("x.prediction")).alias("predicted_fields"))


_CER = " UNION ALL ".join(f"SELECT '{n}' AS phase, p_name AS t, replace(p_name, '{a}', '{b}') AS p FROM part" for n, (a, b) in _PHASES.items())


@query(f"SELECT phase, sum(levenshtein(t, p)) AS char_edits, sum(length(t)) AS chars, sum(levenshtein(t, p)) / sum(length(t)) AS cer, sum(len(string_split(t, ' '))) AS words, sum(CASE WHEN t = p THEN 2 ELSE 1 END) AS fields_right, count(*) * 2 AS fields FROM ({_CER}) GROUP BY phase")
def cer_by_phase(spark, d):
    return quality.accuracy_by_phase(_samples(spark, d)).select("phase", "char_edits", "chars", "cer", "words", "fields_right", "fields")


@query()
def wer_by_phase(spark, d):
    return quality.accuracy_by_phase(_samples(spark, d)).select("phase", "word_edits", "words", "wer")


@query(f"WITH c AS (SELECT phase, sum(levenshtein(t, p)) / sum(length(t)) AS cer FROM ({_CER}) GROUP BY phase) SELECT phase, coalesce(((SELECT cer FROM c WHERE phase = 'baseline') - cer) / nullif((SELECT cer FROM c WHERE phase = 'baseline'), 0), 0) AS cer_improvement FROM c")
def phase_comparison(spark, d):
    return quality.compare_to_baseline(quality.accuracy_by_phase(_samples(spark, d))).select("phase", "cer_improvement")


@query()
def agreement(spark, d):
    rows = T(spark, d, "invoices").where("task_id is not null").select("task_id", "row_id", "ingested_at", F.array("invoice_no", "amount", "tax_rate").alias("r"))
    every = F.array_sort(F.collect_list(F.struct("row_id", "ingested_at", "r")))
    samples = rows.groupBy("task_id").agg(F.transform(every, lambda x: x["r"]).alias("candidate_rows"), F.transform(F.reverse(every), lambda x: x["r"]).alias("reference_rows"))
    return quality.agreement_scores(samples).select("task_id", "matched", "compared")



# --- sinks and streams --------------------------------------------------------------------------------


@query("""SELECT event_id, CAST(ts AS DATE) AS event_date, '{"api_key":"****","event":"' || event_type || '"}' AS line FROM events""")
def event_log_masked(spark, d):
    e = T(spark, d, "events")
    secret = F.to_json(F.struct(F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("api_key"), F.col("event_type").alias("event")))
    return e.select("event_id", F.to_date("ts").alias("event_date"), writers.masked(secret).alias("line"))


@query()
def event_log_lines(spark, d):
    e = T(spark, d, "events").select(F.col("ts").alias("event_time"), "event_type", F.col("props").alias("payload"))
    return writers.log_lines(e)


def _streamed(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read back what it wrote, from the shared folder."""
    base = f"{session.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    streams.run_available(stream, lambda batch, n: batch.write.mode("append").parquet(f"{base}/out"), f"{base}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _stream(spark, d, name):
    return streams.table_stream(spark, f"{d}/{name}.parque[t]", T(spark, d, name).schema)


@query("SELECT DISTINCT task_id FROM tasks")
def stream_dedupe(spark, d):
    return _streamed(spark, streams.deduplicated(_stream(spark, d, "tasks"), ["task_id"], "ingested_at", "3650 days").select("task_id"), "append")


@query()
def stream_task_states(spark, d):
    e = _stream(spark, d, "events")
    commands = e.select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "extract").otherwise("finish").alias("command"))
    return _streamed(spark, streams.task_states(commands), "update")


@query()
def stream_badges(spark, d):
    return _streamed(spark, streams.windowed_badges(_stream(spark, d, "tasks").where("ingested_at is not null")), "append")

"""From pages to documents to queues: roll-ups, completion, views.  All of it is aggregation with map-side combining,
or a join on the task's key; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered_text(page: str = "page_index", text: str = "text") -> Column:
    """Aggregate: the pages' texts in page order, each under its mark, joined by a blank line."""
    pages = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return F.array_join(F.transform(pages, lambda x: F.concat(F.lit("[PAGE "), x["p"].cast("string"), F.lit("]\n"), F.coalesce(x["t"], F.lit("")))), "\n\n")


def document_rollup(pages: DataFrame, with_retry: bool = True) -> DataFrame:
    """One row a task: pages, blocks, average and least confidence, whether any page was read again, its first profile and scores of the passes."""
    has = set(pages.columns)
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False)) if with_retry and c in has else F.lit(False)
    aggregates = [
        F.count("*").alias("n_pages"),
        F.avg("ocr_confidence").alias("ocr_confidence"),
        F.min("confidence_min").alias("confidence_min"),
        F.sum(F.coalesce("block_count", F.lit(0))).alias("block_count"),
        flag("retry_triggered").alias("retry_triggered"),
        flag("retry_applied").alias("retry_applied"),
    ]
    for c in ("retry_profile_from", "retry_profile_to"):
        if c in has and with_retry:
            filled = F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.struct("page_index", c))
            aggregates.append(F.min(filled)[c].alias(c))
    for c in ("first_pass_min", "second_pass_min"):
        if c in has and with_retry:
            aggregates.append(F.min(c).alias(c))
    return pages.groupBy("task_id").agg(*aggregates)


def document_text(pages: DataFrame) -> DataFrame:
    return pages.groupBy("task_id").agg(ordered_text().alias("document_text"))


def task_completion(pages: DataFrame, kind: str = "source_type") -> DataFrame:
    """Task status from pages (task_id, source_type, page_index, status success/empty/failed, error_code, error_message).

    Done with any successful page, or for a task that is no PDF; failed with the lowest page's error if all pages failed; else failed as
    empty, with counts in its message."""
    failed = F.col("status") == "failed"
    per = pages.groupBy("task_id", kind).agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "empty").alias("empty"),
        F.count_if(failed).alias("failed"),
        F.min(F.when(failed, F.struct("page_index", F.col("error_code").alias("code"), F.col("error_message").alias("message")))).alias("first"),
    )
    done = (F.col("succeeded") > 0) | (F.col(kind) != "pdf")
    all_failed = (F.col("failed") == F.col("pages")) & (F.col("pages") > 0)
    message = F.format_string("no rows: %d pages, %d empty, %d failed, first failed page %s", F.col("pages"), F.col("empty"), F.col("failed"), F.coalesce(F.col("first.page_index").cast("string"), F.lit("-")))
    return per.select(
        "task_id",
        "pages",
        "succeeded",
        "empty",
        "failed",
        F.when(done, "done").otherwise("failed").alias("task_status"),
        F.when(done, F.lit(None)).when(all_failed, F.col("first.code")).otherwise("E_PDF_005").alias("error_code"),
        F.when(done, F.lit(None)).when(all_failed, F.col("first.message")).otherwise(message).alias("error_message"),
    )


def status_badges(tasks: DataFrame, status: str = "status") -> DataFrame:
    """One row of counts for the queue's badges."""
    s = F.col(status)
    return tasks.agg(
        F.count("*").alias("total"),
        F.count_if(s.isin("done", "completed", "success")).alias("success"),
        F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "pending").alias("pending"),
        F.count_if(s == "paused").alias("paused"),
    )


def write_summary(rows: DataFrame) -> DataFrame:
    """How many rows would be written, skipped, and are there."""
    writes = (F.col("action") == "write") & ~F.coalesce(F.col("is_error_row"), F.lit(False))
    return rows.agg(F.count_if(writes).alias("selected"), (F.count("*") - F.count_if(writes)).alias("skipped"), F.count("*").alias("total"))


def export_rows(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("action") == "write") & ~F.coalesce(F.col("is_error_row"), F.lit(False)))


def reliability_report(tasks: DataFrame, freeze_ms: float = 0.0, render_ms: float = 0.0, crashes: int = 0) -> DataFrame:
    """Completion rate of a run and its five checks."""
    rate = 100.0 * F.count_if(F.col("status").isin("done", "failed")) / F.nullif(F.count("*"), F.lit(0))
    one = tasks.agg(F.count("*").alias("tasks"), F.coalesce(rate, F.lit(0.0)).alias("queue_complete_rate"))
    checks = {"PERF-001": F.lit(freeze_ms) <= 1000, "PERF-002": F.lit(render_ms) <= 300, "PERF-003": F.col("tasks") > 0, "REL-001": F.col("queue_complete_rate") >= 99, "REL-002": F.lit(crashes) == 0}
    return one.select("tasks", "queue_complete_rate", *[c.alias(n.replace("-", "_").lower()) for n, c in checks.items()])


def page_count(declared: Column, snapshots: Column, highest: Column) -> Column:
    return F.greatest(*[F.coalesce(c, F.lit(0)) for c in (declared, snapshots, highest)])


def queue_snapshot(tasks: DataFrame, pages: DataFrame, collapsed: DataFrame | None = None) -> DataFrame:
    """One row a task and, for tasks of several pages that are not collapsed, one a page; ``page_index`` is null on task rows.
    The text shown is the page's, else the task's."""
    seen = pages.groupBy("task_id").agg(F.count_distinct("page_index").alias("n"), F.max("page_index").alias("top"))
    base = tasks.join(seen, "task_id", "left").withColumn("page_count", page_count(F.col("pdf_total_pages"), F.col("n"), F.col("top")))
    if collapsed is not None:
        base = base.join(collapsed.select("task_id").distinct().withColumn("__hide", F.lit(True)), "task_id", "left")
    else:
        base = base.withColumn("__hide", F.lit(None).cast("boolean"))
    head = base.select("task_id", F.lit("task").alias("row_kind"), F.lit(None).cast("int").alias("page_index"), "page_count", "status")
    some = base.where("page_count > 1 and __hide is null").select("task_id", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page_index"), "page_count", "status")
    known = pages.select("task_id", "page_index").distinct().withColumn("__seen", F.lit(True))
    body = some.join(known, ["task_id", "page_index"], "left").select("task_id", F.lit("page").alias("row_kind"), "page_index", "page_count", F.when(F.col("__seen"), F.col("status")).otherwise("missing").alias("status"))
    return head.unionByName(body)


def upsert(base: DataFrame, changes: DataFrame, key: str = "task_id") -> DataFrame:
    """All rows of a key replaced by the changes' rows for it; keys that are new are added."""
    return base.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last version of each key: an aggregation with map-side combining, so a key with a third of the rows is no hot spot."""
    whole = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(whole, F.struct(F.col(sequence), F.xxhash64(*df.columns))).alias("__b")).select("__b.*")


def project_results(base: DataFrame, stream: DataFrame, actions: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Result rows shown: a task's stream rows in place of its base rows, an operator's action kept by row (never on error rows),
    tasks that are suppressed left out."""
    rows = upsert(base, stream)
    if suppressed is not None:
        rows = rows.join(suppressed.select("task_id").distinct(), "task_id", "left_anti")
    chosen = actions.groupBy("row_id").agg(F.max_by("action", "seq").alias("__action"))
    joined = rows.join(chosen, "row_id", "left")
    return joined.withColumn("action", F.when(F.coalesce(F.col("is_error_row"), F.lit(False)), F.col("action")).otherwise(F.coalesce("__action", "action"))).drop("__action")


#: Events that replace all rows of a task, and the one that replaces those of a page.
WHOLE_EVENTS, PAGE_EVENT = ("progressed", "succeeded", "failed"), "page_streamed"


def review_texts(events: DataFrame) -> DataFrame:
    """(task_id, page_index, text, markdown, retry_triggered, retry_applied) after all events (task_id, seq, event_type, page_index, text, markdown,
    retry_triggered, retry_applied): the last one of each task and page that says something, page null for the whole task.

    Text comes from any event of the task; markdown and the retry's outcome only from completed recognition, and its markdown replaces the one before even by
    nothing.  Events without a task say nothing."""
    own = events.where("coalesce(task_id, '') <> ''")
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col("seq"))).alias(c)
    seen = F.col("event_type") == "ocr_completed"
    return own.groupBy("task_id", "page_index").agg(last("text", F.col("text").isNotNull()), *[last(c, seen) for c in ("markdown", "retry_triggered", "retry_applied")])


def review_rows(events: DataFrame) -> DataFrame:
    """(task_id, page_index, seq, row) shown after all events with ``rows`` (array of struct(page_index, value)): those of the task's last event that
    replaces all rows, but for pages that a later page event has replaced.

    Only the deciding events' rows are exploded: sequence numbers are aggregated first, so a long history costs no more than a short one."""
    own = events.where("coalesce(task_id, '') <> ''")
    whole = own.where(F.col("event_type").isin(*WHOLE_EVENTS)).groupBy("task_id").agg(F.max("seq").alias("seq"))
    page = own.where(F.col("event_type") == PAGE_EVENT).groupBy("task_id", "page_index").agg(F.max("seq").alias("seq"))
    later = page.join(whole.withColumnRenamed("seq", "since"), "task_id", "left").where("since is null or seq > since").select("task_id", "page_index", "seq")
    base = own.select("task_id", "seq", "rows").join(whole, ["task_id", "seq"], "left_semi").select("task_id", "seq", F.explode("rows").alias("row")).select("task_id", F.col("row.page_index").alias("page_index"), "seq", "row")
    base = base.join(later.select("task_id", "page_index"), ["task_id", "page_index"], "left_anti")
    streamed = own.select("task_id", "page_index", "seq", "rows").join(later, ["task_id", "page_index", "seq"], "left_semi").select("task_id", "page_index", "seq", F.explode("rows").alias("row"))
    return base.unionByName(streamed)


def task_events(tasks: DataFrame, pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Typed events of a run: admitted, started, page results, finished or failed, rows."""
    def event(df: DataFrame, code: str, kind: str, when: str, payload: Column) -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.lit(kind).alias("event_type"), "task_id", F.col(when).alias("event_time"), payload.alias("payload"))

    out = event(tasks, "EVT-TASK-001", "created", "created_at", F.to_json(F.struct("source_type", "display_name")))
    out = out.unionByName(event(tasks.where("started_at is not null"), "EVT-TASK-002", "started", "started_at", F.to_json(F.struct("status"))))
    out = out.unionByName(event(pages, "EVT-TASK-003", "progressed", "ingested_at", F.to_json(F.struct("page_index", "ocr_confidence"))))
    out = out.unionByName(event(tasks.where("status = 'done'"), "EVT-TASK-003", "succeeded", "finished_at", F.to_json(F.struct("status"))))
    out = out.unionByName(event(tasks.where("status = 'failed'"), "EVT-TASK-004", "failed", "finished_at", F.to_json(F.struct("error_code"))))
    return out.unionByName(event(rows, "EVT-TASK-005", "row_extracted", "ingested_at", F.to_json(F.struct("row_id", "page_index"))))


def build_success_rows(rows: DataFrame, values: str = "values", cells: str = "cells") -> DataFrame:
    """Result rows (task_id, page_index) from arrays of normalised rows and of grounded cells, by place; ids are hashes of what identifies a row."""
    zipped = rows.select("task_id", "page_index", "ocr_confidence", F.posexplode(F.arrays_zip(F.col(values).alias("v"), F.col(cells).alias("c"))).alias("ordinal", "z"))
    known = ("ASSIGNED", "INFERRED", "UNCERTAIN")
    label = F.col("z.c.classification")
    return zipped.select(
        F.sha2(F.concat_ws("|", "task_id", F.col("page_index").cast("string"), F.col("ordinal").cast("string")), 256).alias("row_id"),
        "task_id", "page_index", "ordinal", F.col("z.v").alias("values"), F.col("z.c.cells").alias("cells"), F.when(label.isin(*known), label).otherwise("UNCERTAIN").alias("classification"), F.lit("write").alias("action"), "ocr_confidence", F.lit(False).alias("is_error_row"),
    )


def build_failed_rows(tasks: DataFrame, width: int) -> DataFrame:
    return tasks.select(F.sha2(F.concat_ws("|", "task_id", F.lit("error")), 256).alias("row_id"), "task_id", F.array_repeat(F.lit("error"), width).alias("values"), F.lit("skip").alias("action"), F.lit(True).alias("is_error_row"))


def with_ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

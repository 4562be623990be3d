"""Texts, images, folders, PDF pages, remote results and raw recognition output as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

IMAGES = ("png", "jpg", "jpeg", "bmp", "tiff")


def text_tasks(df: DataFrame, key: str, text: str) -> DataFrame:
    """One text task a row; ids are hashes, so a repeated run makes the same ones."""
    return df.where(F.col(text).isNotNull()).select(F.sha2(F.concat_ws("|", F.lit("text"), F.col(key).cast("string")), 256).alias("task_id"), F.lit("text").alias("source_type"), F.col(text).alias("source_value"), F.lit("pending").alias("status"))


def files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """The files of a folder (not of its subfolders) with their kind; unsupported ones have kind null, for a side output."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    kind = F.when(suffix == "pdf", "pdf").when(suffix.isin(*IMAGES), "image")
    return df.select("path", name.alias("display_name"), kind.alias("source_type"), F.col("length").alias("bytes"), "content")


def file_tasks(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks in order of folded names, rejected files)."""
    ok = listing.where("source_type is not null").orderBy(F.lower("display_name"))
    return ok.select(F.sha2(F.concat_ws("|", "source_type", "path"), 256).alias("task_id"), "source_type", F.col("path").alias("source_path"), "display_name"), listing.where("source_type is null").select("path", "display_name")


def pdf_limits(listing: DataFrame, pages: Column, max_bytes: int, max_pages: int) -> DataFrame:
    """``error_code`` of each PDF: not a PDF or missing, unreadable or empty, too large, too many pages, in this order."""
    return listing.withColumn(
        "error_code",
        F.when(F.coalesce(F.col("source_type") != "pdf", F.lit(True)), "E_PDF_001").when(F.coalesce(pages <= 0, F.lit(True)), "E_PDF_002").when(F.col("bytes") > max_bytes, "E_PDF_004").when(pages > max_pages, "E_PDF_003"),
    )


def page_strategy(char_count: Column, min_chars: Column, prefer_layer: Column | bool = True) -> Column:
    """text_layer where the layer is preferred and long enough, else ocr."""
    prefer = F.lit(prefer_layer) if isinstance(prefer_layer, bool) else prefer_layer
    return F.when(prefer & (F.coalesce(char_count, F.lit(0)) >= F.greatest(min_chars, F.lit(1))), "text_layer").otherwise("ocr")


class PdfPages(DataSource):
    """``spark.read.format("pdf_pages").option("engine", "module:factory").load(path)``: one row a page with its text layer and geometry.

    The engine is a plug-in (``factory(path)`` gives an object with ``page_count`` and ``page(i)`` -> dict); without one, reading fails with a clear error.
    Each file is a partition; a page that cannot be read is a row with an error, not a failed task."""

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return "path string, page_index int, text string, char_count int, page_width double, page_height double, error_code string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PdfReader(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        self.value = path


class _PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.engine = options.get("engine", "")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        if ":" not in self.engine:
            raise ValueError("pdf_pages needs option engine=module:factory")
        module, factory = self.engine.split(":")
        try:
            document = getattr(importlib.import_module(module), factory)(partition.value)
            count = document.page_count
        except Exception:
            yield (partition.value, None, None, None, None, None, "E_PDF_002")
            return
        for i in range(1, count + 1):
            try:
                p = document.page(i)
                text = (p.get("text") or "").strip() or None
                yield (partition.value, i, text, len(text or ""), p.get("width"), p.get("height"), None)
            except Exception:
                yield (partition.value, i, None, 0, None, None, None)


_LINE = (
    "errorCode string, result struct<layoutParsingResults:array<struct<markdown:struct<text:string>>>,"
    "ocrResults:array<struct<prunedResult:struct<rec_texts:array<string>,rec_scores:array<double>,rec_polys:array<array<array<double>>>>>>>"
)


def remote_pages(lines: DataFrame, column: str = "value", key: str | None = None) -> DataFrame:
    """Pages of remote results, one JSON line a document part: layout results (markdown only) before recognised lines before one empty page.

    All in the JVM: typed decoding, a union of two explodes, confidences by array functions.  An error code on the line is the page's error."""
    keys = [key] if key else []
    d = lines.withColumn("__d", F.from_json(column, _LINE)).withColumn("__line", F.monotonically_increasing_id()) if key is None else lines.withColumn("__d", F.from_json(column, _LINE)).withColumn("__line", F.col(key))
    bad = F.coalesce(~F.col("__d.errorCode").isin("0", "None", "null"), F.lit(False))
    layouts, recognised = F.col("__d.result.layoutParsingResults"), F.col("__d.result.ocrResults")
    page = "struct<markdown:string,texts:array<string>,scores:array<double>,polys:array<array<array<double>>>>"
    none = F.lit(None)
    from_layout = F.transform(layouts, lambda x: F.struct(x["markdown"]["text"].alias("markdown"), none.cast("array<string>").alias("texts"), none.cast("array<double>").alias("scores"), none.cast("array<array<array<double>>>").alias("polys")))
    from_lines = F.transform(recognised, lambda x: F.struct(none.cast("string").alias("markdown"), x["prunedResult"]["rec_texts"].alias("texts"), x["prunedResult"]["rec_scores"].alias("scores"), x["prunedResult"]["rec_polys"].alias("polys")))
    empty = F.array(F.lit(None).cast(page))
    pages = F.when(bad, empty).when(F.size(layouts) > 0, from_layout).when(F.size(recognised) > 0, from_lines).otherwise(empty)
    out = d.select(*keys, F.when(bad, F.concat(F.lit("E_OCR_"), F.col("__d.errorCode"))).alias("error_code"), F.posexplode(pages).alias("__i", "p"))
    scores = F.filter("p.scores", lambda s: s.isNotNull())
    return out.select(
        *keys, (F.col("__i") + 1).alias("page_in_line"), F.col("p.markdown").alias("markdown_text"), F.when(F.col("p.texts").isNotNull(), F.array_join("p.texts", "\n")).alias("text"),
        F.transform(F.arrays_zip(F.col("p.texts").alias("t"), F.col("p.scores").alias("s"), F.col("p.polys").alias("b")), lambda z: F.struct(z["t"].alias("text"), z["s"].alias("score"), z["b"].alias("box"), F.lit("\n").alias("end"))).alias("blocks"),
        (F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0))).alias("ocr_confidence"), F.array_min(scores).alias("confidence_min"), "error_code",
    )


_BOXES = ("rec_polys", "dt_polys", "rec_boxes", "text_det_polys", "polys", "boxes")


def raw_blocks(value: Any) -> list[tuple[str, float | None, list | None, str]]:
    """Blocks of arbitrarily nested recognition output, depth first: dicts of parallel lists, or pairs of a box and (text, score)."""
    if isinstance(value, dict):
        texts = value.get("rec_texts")
        if isinstance(texts, list):
            scores = value.get("rec_scores") or []
            boxes = next((value[k] for k in _BOXES if isinstance(value.get(k), list)), [])
            return [(str(t), float(scores[i]) if i < len(scores) and isinstance(scores[i], (int, float)) else None, _points(boxes[i]) if i < len(boxes) else None, "") for i, t in enumerate(texts)]
        return [b for v in value.values() for b in raw_blocks(v)]
    if isinstance(value, list):
        if len(value) == 2 and isinstance(value[0], list) and isinstance(value[1], (list, tuple)) and len(value[1]) == 2 and isinstance(value[1][0], str):
            score = value[1][1]
            return [(value[1][0], float(score) if isinstance(score, (int, float)) else None, _points(value[0]), "")]
        return [b for v in value for b in raw_blocks(v)]
    return []


def _points(box: Any) -> list | None:
    if isinstance(box, list) and len(box) == 4 and all(isinstance(x, (int, float)) for x in box):
        l, t, r, b = map(float, box)
        return [[l, t], [r, t], [r, b], [l, b]]
    points = [[float(p[0]), float(p[1])] for p in box if isinstance(p, (list, tuple)) and len(p) >= 2] if isinstance(box, list) else []
    return points if len(points) >= 2 else None


def blocks_of_payload(payload: Column) -> Column:
    """The blocks of a JSON payload of a recognition engine; null for what is no JSON."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("box", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("end", T.StringType())])))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append([dict(zip(("text", "score", "box", "end"), b)) for b in raw_blocks(json.loads(t))])
            except (TypeError, ValueError):
                out.append(None)
        return pd.Series(out)

    return run(payload)


def fitted_size(width: Column, height: Column, limit: int = 4000) -> Column:
    """struct(width, height) of an image whose long side is brought down to the limit; at least one pixel."""
    long_side = F.greatest(width, height)
    scale = F.least(F.lit(1.0), F.lit(float(limit)) / long_side)
    return F.struct(F.greatest(F.lit(1), F.round(width * scale).cast("int")).alias("width"), F.greatest(F.lit(1), F.round(height * scale).cast("int")).alias("height"))


def crop_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """struct(left, top, right, bottom) inside the image; a crop without area is the whole image."""
    l, t = F.greatest(F.lit(0.0), F.least(left, right)), F.greatest(F.lit(0.0), F.least(top, bottom))
    r, b = F.least(width.cast("double"), F.greatest(left, right)), F.least(height.cast("double"), F.greatest(top, bottom))
    ok = (r > l) & (b > t)
    return F.struct(F.when(ok, l).otherwise(0.0).alias("left"), F.when(ok, t).otherwise(0.0).alias("top"), F.when(ok, r).otherwise(width.cast("double")).alias("right"), F.when(ok, b).otherwise(height.cast("double")).alias("bottom"))

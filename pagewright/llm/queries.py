"""Named queries of the sub-package (p1_ to p8_) and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import abuse, forms, leakage, parties, personal, pieces, scans, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized_units(_table(spark, sf_dir, "chunk_units"), _table(spark, sf_dir, "app_configs"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_units(_table(spark, sf_dir, "chunk_units"), _table(spark, sf_dir, "app_configs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.affected_lines(_table(spark, sf_dir, "ocr_pages"), _table(spark, sf_dir, "text_layers"))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.clean_paragraphs(_table(spark, sf_dir, "ocr_pages"), _table(spark, sf_dir, "text_layers"))


def p2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.clean_blocks(*(_table(spark, sf_dir, t) for t in ("ocr_blocks", "ocr_pages", "text_layers")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.same_looking_blocks(_table(spark, sf_dir, "ocr_blocks"), _table(spark, sf_dir, "text_layers"))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.consistent_lines(_table(spark, sf_dir, "ocr_blocks"), _table(spark, sf_dir, "text_layers"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found_kinds(_table(spark, sf_dir, "ocr_blocks"))


def p4_blocks_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redact(_table(spark, sf_dir, "ocr_blocks"), "block_id")


def p4_pages_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redact(_table(spark, sf_dir, "ocr_pages"), "page_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = parties.spellings(_table(spark, sf_dir, "invoices"), "buyer_name", "seller_name")
    return parties.same_party_pairs(parties.party_classes(names))


def p5_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parties.party_classes(parties.spellings(_table(spark, sf_dir, "invoices"), "buyer_name", "seller_name"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(_table(spark, sf_dir, "documents"))


def p6_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(_table(spark, sf_dir, "documents"), offsets=True)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p7_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), with_part=True)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.found_kinds(abuse.scores(_table(spark, sf_dir, "documents")))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(_table(spark, sf_dir, "documents"))


def p8_voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.voter_report(_table(spark, sf_dir, "documents"))


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return abuse.source_rates(documents, abuse.scores(documents))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name[0] == "p" and name[1].isdigit()}


_P1_LIMIT = "coalesce(c.extraction_max_char_buffer, 2200)"

ORACLES = {
    "p1_found": f"""
        SELECT DISTINCT u.unit_id FROM chunk_units u LEFT JOIN app_configs c ON u.config_id = c.config_id
        WHERE u.text IS NOT NULL AND {_P1_LIMIT} > 0 AND length(u.text) > {_P1_LIMIT}""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""Queries of the training-data operators over the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.llm import boilerplate, host_lines, languages, mixing, near_duplicates, packing, prose, residue, splitting, term_counts
from corpusmill.llm.records import crawl_records
from corpusmill.session import read_table

ALIKE = near_duplicates.Settings(width=3, min_words=100, weighted=0, exact=0.7)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.alike_pairs(crawl_records(spark, sf_dir), ALIKE)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.alike_groups(crawl_records(spark, sf_dir), ALIKE)


def _common(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """The fixed table of common words."""
    return sorted((r.lang, r.word) for r in read_table(spark, sf_dir, "commonword").where("lang is not null and word is not null").collect())


def _words(spark: SparkSession, sf_dir: str) -> list[str]:
    return [w for _, w in _common(spark, sf_dir)]


def _limit(spark: SparkSession, sf_dir: str, name: str) -> int:
    return read_table(spark, sf_dir, "sizelimit").where(F.col("name") == name).first()["tokens"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.not_prose(crawl_records(spark, sf_dir), _words(spark, sf_dir))


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.text_statistics(crawl_records(spark, sf_dir), _words(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.boilerplate_lines(crawl_records(spark, sf_dir), _words(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.wrong_labels(crawl_records(spark, sf_dir), _common(spark, sf_dir))


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.record_languages(crawl_records(spark, sf_dir), _common(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_records(crawl_records(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_lines.repeated_places(crawl_records(spark, sf_dir))


def p6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_lines.line_templates(crawl_records(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.marked_terms(crawl_records(spark, sf_dir)).where("mark is not null").select("term", "mark")


def p7_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.marked_terms(crawl_records(spark, sf_dir))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), _limit(spark, sf_dir, "container_capacity"))


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_pack(spark, sf_dir), _limit(spark, sf_dir, "container_capacity"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mixtarget"))


def p9_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mixtarget"))


def p9_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.slot_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mixtarget"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf_dir), read_table(spark, sf_dir, "mixtarget"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splitting.Settings(*(_limit(spark, sf_dir, k) for k in ("piece_limit", "piece_overlap", "oversized_above")))
    return splitting.split_oversized(read_table(spark, sf_dir, "documents"), s)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece_no = 1").select("doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}

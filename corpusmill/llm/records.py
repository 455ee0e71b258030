"""The crawled records every page operator reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.operators.dedup import without_repeats  # noqa: F401
from corpusmill.session import read_table


def host_of(url: Column) -> Column:
    """Lower-cased text between `://` and the next `/`, `:`, `?` or `#`; null without one."""
    host = F.regexp_extract(F.lower(url), r"://([^/:?#]*)", 1)
    return F.when(host != "", host)


def crawl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, host, title, doc_type, declared_lang, content of the rows that have content.

    Rows that repeat a record are still there: operators whose result is a set of rows drop
    repeats from their (small) results, and counting operators see to them as they count.
    """
    t = read_table(spark, sf_dir, "crawldoc").where(F.col("content").isNotNull() & F.col("metadata.id").isNotNull())
    return t.select(
        F.col("metadata.id").alias("id"), host_of(F.col("metadata.source_url")).alias("host"), F.col("metadata.title").alias("title"),
        F.col("metadata.doc_type").alias("doc_type"), "declared_lang", "ingested_at", "content",
    )

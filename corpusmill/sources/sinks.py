"""Sinks: documents, manifest, corpus text, segments, statistics, models."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F


def documents(df: DataFrame, path: str, by: str = "doc_type") -> None:
    """Documents as JSON, one folder per value of `by`."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def manifest(df: DataFrame, path: str) -> None:
    """One JSON line per document, with the total in each."""
    total = df.agg(F.count(F.lit(1)).alias("total_documents"))
    df.join(F.broadcast(total)).write.mode("overwrite").json(path)


def corpus_text(df: DataFrame, tokens: str, path: str) -> None:
    """One space-joined token sequence per line."""
    df.select(F.array_join(tokens, " ").alias("value")).write.mode("overwrite").text(path)


def segments(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def save_model(vectors: DataFrame, config: dict, path: str) -> None:
    """Vectors as Parquet, settings as JSON beside them."""
    vectors.write.mode("overwrite").parquet(os.path.join(path, "vectors"))
    spark = vectors.sparkSession
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "config"))


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    config = spark.read.text(os.path.join(path, "config")).first().value
    return spark.read.parquet(os.path.join(path, "vectors")), json.loads(config)

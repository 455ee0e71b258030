"""The page pipeline as a stream: the same column functions, with state for what was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions import url as U
from corpusmill.operators import cleaning, dedup, filters
from corpusmill.sources.readers import DOCUMENT

C, lit = F.col, F.lit


def read_documents(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON documents as they arrive in a folder."""
    return spark.readStream.schema(DOCUMENT).option("multiLine", "true").option("maxFilesPerTrigger", files_per_trigger).json(path)


def process(documents: DataFrame, delay: str = "7 days") -> DataFrame:
    """id, url, doc_type, content, content_key, event_time of kept documents, each content once.

    Contents are remembered for `delay` behind the newest event time; later repeats of older ones pass again.
    """
    m = documents.select("metadata.*", "content")
    typed = m.withColumn("doc_type", F.coalesce("doc_type", U.doc_type(C("source_url")))).withColumn("event_time", F.coalesce(F.try_to_timestamp(C("timestamp")), F.current_timestamp()))
    clean = typed.withColumn("content", cleaning.clean_scraped(C("content")))
    judged = clean.withColumn("reason", filters.scraped_reason(C("doc_type"), C("title"), C("source_url"), C("content"))).where("reason = 'kept'")
    keyed = judged.withColumn("content_key", dedup.content_key(C("content"))).where("content_key is not null")
    return keyed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["content_key"]).select("id", C("source_url").alias("url"), "doc_type", "content", "content_key", "event_time")


def counts_by_type(documents: DataFrame, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Documents per window and type, with late ones up to `delay`."""
    m = documents.select(F.coalesce("metadata.doc_type", lit("")).alias("doc_type"), F.try_to_timestamp(C("metadata.timestamp")).alias("event_time")).where("event_time is not null")
    return m.withWatermark("event_time", delay).groupBy(F.window("event_time", window), "doc_type").agg(F.count(lit(1)).alias("documents"))


def write(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet; the checkpoint folder makes a restart continue where it stopped."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()

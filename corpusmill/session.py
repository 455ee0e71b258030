"""Session helpers shared by every operator."""

from __future__ import annotations

import logging
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def get_session(app: str = "corpusmill", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; existing sessions are reused."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def logger(name: str = "corpusmill") -> logging.Logger:
    """A logger that writes time, level and message; set up once."""
    log = logging.getLogger(name)
    if not log.handlers:
        h = logging.StreamHandler()
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
        log.setLevel(logging.INFO)
    return log


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; an own one only on one machine, where none is set. On a cluster without one this is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "corpusmill-checkpoints"))


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and go on from there.

    The copy survives the loss of executors; what is built on it is not recomputed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """Mark `df` for broadcast only if it is measured to have at most `max_rows` rows and `max_bytes` bytes.

    Beyond that the join is left to Spark, which shuffles both sides. `df` should be
    materialized, since it is measured here and read again by the join.
    """
    sizes = [F.octet_length(F.col(f"`{f.name}`").cast("string")) if f.dataType.typeName() in ("string", "binary", "array", "struct", "map") else F.lit(8) for f in df.schema.fields]
    per_row = sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(16))
    r = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(per_row), F.lit(0))).first()
    return F.broadcast(df) if r[0] <= max_rows and r[1] <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, for work that costs far more than moving the rows.

    A table of fewer partitions than cores (a small file has one) is dealt out; a large table stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

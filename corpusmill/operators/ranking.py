"""Global ranks and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.session import materialize


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with its 0-based position in the given order.

    Rows are range-partitioned and sorted; a partition's first rank is the number of rows ahead of it. The
    sorted rows are written once, as range bounds are sampled and must not change between the two passes. The counts
    have one row per partition.
    """
    at = F.monotonically_increasing_id()
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    ahead, rows = 0, []
    for r in counts.orderBy("_part").collect():
        rows.append((r._part, ahead))
        ahead += r.n
    first = df.sparkSession.createDataFrame(rows, "_part bigint, _first bigint")
    ranked = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(first), "_part")
    return ranked.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_first")


def running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` over the rows before each in the given order.

    As `global_rank`: sums within sorted partitions, and one row per partition for what lies ahead of it.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    rows, ahead = [], 0
    for r in placed.groupBy("_part").agg(F.sum(value).alias("s")).orderBy("_part").collect():
        rows.append((r._part, ahead))
        ahead += r.s
    first = df.sparkSession.createDataFrame(rows, "_part bigint, _first bigint")
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_inner", inner).join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_inner")).drop("_at", "_part", "_first", "_inner")

"""Problem 9: sources mixed to target shares.

The documents of a source are put into the order of a hash and cut into blocks of equal tokens. A
fixed number of slots is dealt to the sources by a golden-ratio sequence: the point of a slot falls into a
source's stretch of the cumulative weights, so every run of slots is mixed nearly to target. The n-th slot of a source takes its
n-th block, and starts over when the blocks end, at most `max_repeats` times in all.

The total is the largest at which every source that has documents reaches its share. Sources
without documents get nothing; the others' shares are scaled up, and the shares reached are reported.

Running sums are taken over hash ranges of a source, so a source with a third of all rows is spread over
tasks. Slots, and with them blocks, are bounded by a setting. Nulls: documents without a source, or of one
without a target, are left out; null texts have no tokens. Targets with null or non-positive share are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from corpusmill.llm import tokens
from corpusmill.llm.packing import with_tokens
from corpusmill.session import materialize

GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class Settings:
    """slots bounds the schedule; shares are met to about 1 / slots, or a document. ranges: parts of a source."""

    slots: int = 1 << 16
    ranges: int = 256
    vocabulary: str = tokens.DEFAULT_VOCABULARY


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


def golden_points(n: int) -> np.ndarray:
    """Fractional parts of (i + 1/2) times the golden ratio; exact arithmetic modulo 2**64."""
    k = np.uint64(int(GOLDEN * 2**64) | 1)
    with np.errstate(over="ignore"):
        x = np.arange(n, dtype=np.uint64) * k + (k >> np.uint64(1))
    return x.astype(np.float64) / 2**64


def schedule(targets: list[Target], have: dict[str, int], slots: int) -> tuple[float, dict[str, np.ndarray], list[tuple[int, str, int, int]]]:
    """(tokens of a block, uses of each block by source, slots as (slot, source, block, round))."""
    live = [t for t in targets if have.get(t.source, 0) > 0 and t.share > 0 and t.repeats > 0]
    if not live:
        return 1.0, {}, []
    whole = sum(t.share for t in live)
    total = min(have[t.source] * t.repeats / (t.share / whole) for t in live)
    block = total / slots
    ends = np.cumsum([t.share / whole for t in live])
    owner = np.minimum(np.searchsorted(ends, golden_points(slots), side="right"), len(live) - 1)
    uses, out = {}, []
    for i, t in enumerate(live):
        blocks = max(1, int(np.ceil(have[t.source] / block - 1e-9)))
        mine = np.flatnonzero(owner == i)
        rank = np.arange(len(mine))
        ok = rank < blocks * t.repeats
        uses[t.source] = np.bincount(rank[ok] % blocks)  # blocks that are met, at most as many as slots
        out += zip(mine[ok].tolist(), [t.source] * int(ok.sum()), (rank[ok] % blocks).tolist(), (rank[ok] // blocks).tolist())
    return block, uses, out


def _targets(targets: DataFrame) -> list[Target]:
    rows = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("s"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r"))
    return [Target(r.source, r.s, int(r.r)) for r in rows.orderBy("source").collect()]  # one row per source of the target table


def _placed(docs: DataFrame, targets: list[Target], s: Settings) -> tuple[DataFrame, dict[str, int]]:
    """doc_id, source, tokens, before (tokens of the source's documents ahead of it), and the tokens of each source."""
    wanted = docs.where(F.col("source").isin([t.source for t in targets]))
    sized = with_tokens(wanted, ["doc_id", "source"], vocabulary=s.vocabulary)
    key = F.xxhash64("doc_id", F.lit(11))
    sized = materialize(sized.withColumn("h", key).withColumn("r", F.pmod(F.shiftrightunsigned("h", 40), F.lit(s.ranges)).cast("int")))
    sums = sized.groupBy("source", "r").agg(F.sum("tokens").alias("t")).collect()  # at most sources * ranges rows
    have: dict[str, int] = {}
    ahead = []
    for x in sorted(sums, key=lambda x: (x.source, x.r)):
        ahead.append((x.source, x.r, have.get(x.source, 0)))
        have[x.source] = have.get(x.source, 0) + x.t
    spark = docs.sparkSession
    offsets = spark.createDataFrame(ahead, "source string, r int, ahead bigint")
    w = Window.partitionBy("source", "r").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("tokens").over(w), F.lit(0))
    placed = sized.withColumn("inner", inner).join(F.broadcast(offsets), ["source", "r"])
    # the offsets have at most sources * ranges rows
    return placed.select("doc_id", "source", "tokens", (F.col("ahead") + F.col("inner")).alias("before")), have


def mix(docs: DataFrame, targets: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, source, tokens, uses, first_slot of every document of a target source: how often it is used, and the slot of the schedule
    in which it is read first (null if it is not used)."""
    placed, _, _, out = _blocks(docs, targets, s)
    met: dict[tuple[str, int], list[int]] = {}
    for slot, source, i, _ in out:
        met.setdefault((source, i), []).append(slot)
    rows = [(k, i, len(v), min(v)) for (k, i), v in met.items()]
    table = docs.sparkSession.createDataFrame(rows, "source string, block bigint, uses bigint, first_slot bigint")
    joined = placed.join(F.broadcast(table), ["source", "block"], "left")  # the table has at most `slots` rows
    return joined.select("doc_id", "source", "tokens", F.coalesce("uses", F.lit(0)).cast("long").alias("uses"), "first_slot")


def _blocks(docs: DataFrame, targets: DataFrame, s: Settings) -> tuple[DataFrame, float, dict[str, np.ndarray], list[tuple[int, str, int, int]]]:
    """The placed documents with their block, and the schedule."""
    goal = _targets(targets)
    placed, have = _placed(docs, goal, s)
    block, uses, out = schedule(goal, have, s.slots)
    at = F.floor((F.col("before") + F.col("tokens") / 2) / F.lit(float(block))).cast("long")  # by its middle a document is off by half its size at most
    return placed.withColumn("block", at), block, uses, out


def mixed_order(docs: DataFrame, targets: DataFrame, s: Settings = Settings()) -> DataFrame:
    """slot, place, doc_id, source, tokens, round: every use of every document in the order of the mixture, a slot's documents by
    their place within its block."""
    placed, _, _, out = _blocks(docs, targets, s)
    table = docs.sparkSession.createDataFrame(out, "slot bigint, source string, block bigint, round bigint")
    joined = placed.join(F.broadcast(table), ["source", "block"])  # the table has at most `slots` rows
    return joined.select("slot", F.col("before").alias("place"), "doc_id", "source", "tokens", "round")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, documents, max_uses, used_tokens, actual_share of each source of the target table."""
    by = mixed.groupBy("source").agg(F.sum((F.col("uses") > 0).cast("long")).alias("documents"), F.max("uses").alias("max_uses"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"))
    total = by.agg(F.sum("used_tokens").alias("total"))
    goal = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = goal.join(by, "source", "left").join(F.broadcast(total))
    zero = F.lit(0).cast("long")
    return out.select("source", "target_share", "max_repeats", F.coalesce("documents", zero).alias("documents"), F.coalesce("max_uses", zero).alias("max_uses"), F.coalesce("used_tokens", zero).alias("used_tokens"), F.coalesce(F.col("used_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"))


def slot_table(docs: DataFrame, targets: DataFrame, s: Settings = Settings()) -> DataFrame:
    """slot, source, block, round: the order in which blocks are read."""
    _, _, _, out = _blocks(docs, targets, s)
    return docs.sparkSession.createDataFrame(out, "slot bigint, source string, block bigint, round bigint")

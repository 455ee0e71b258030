"""Problem 8: documents into containers of fixed capacity.

The sizes' histogram (at most `bins` counts, whatever the number of documents) decides everything: combinations
of up to four sizes that fill a container are enumerated, non-negative least squares finds how often to
repeat each so that the histogram is used up, the counts are rounded down, and what is left is packed
greedily, many equal containers at a time. The resulting plan gives ranges of ranks within a size a place; documents
are ranked within their size and look theirs up. Ranks are taken over salted parts of a size, as many as the number of items asks for, so a size
that a third of all documents share is spread over tasks of about `part_rows` items at any number of documents. The driver gets the histogram, one row per
size.

Documents over the capacity are cut into full containers and a rest. Nulls: a null text has no tokens. Documents
without tokens take no room and go to container 1. Repeated rows are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusmill.llm import tokens
from corpusmill.session import materialize, small_side


@dataclass(frozen=True)
class Settings:
    """bins: sizes are rounded up to this many steps of the capacity. part_rows: items that one task ranks."""

    bins: int = 512
    part_rows: int = 200_000
    rounds: int = 400
    max_broadcast_rows: int = 100_000
    vocabulary: str = tokens.DEFAULT_VOCABULARY


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = tokens.counter(path)
        for b in batches:
            rest = [b.column(i) for i in range(b.num_columns - 1)]
            n = pa.array([c.count(t.as_py()) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*rest, n], [*b.schema.names[:-1], "tokens"])

    return run


def with_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """The columns `keep` and tokens, the number of tokens of the text (0 for null)."""
    tokens.ship(df.sparkSession, vocabulary)
    src = df.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", tokens bigint"
    return src.mapInArrow(_count(vocabulary), schema)


def patterns(bins: int) -> np.ndarray:
    """Rows of up to four sizes (0: none) that fill a container of `bins` steps; fours on a coarser grid."""
    out = [(bins, 0, 0, 0)]
    out += [(a, t - a, 0, 0) for t in (bins, bins - 1) for a in range((t + 1) // 2, t)]
    out += [(a, b, bins - a - b, 0) for a in range((bins + 2) // 3, bins - 1) for b in range((bins - a + 1) // 2, min(a, bins - a - 1) + 1)]
    g = max(1, bins // 64)
    m = bins // g
    out += [(a * g, b * g, c * g, bins - (a + b + c) * g) for a in range((m + 3) // 4, m - 2) for b in range((m - a + 2) // 3, min(a, m - a - 2) + 1) for c in range((m - a - b + 1) // 2, min(b, m - a - b - 1) + 1)]
    return np.array(out, np.int64)


def least_squares(p: np.ndarray, h: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 that minimizes |A x - h|, A counting the sizes in each pattern (accelerated projected gradient)."""
    size = len(h)
    flat = p.ravel()
    pat = np.repeat(np.arange(len(p)), p.shape[1])
    pat, flat = pat[flat > 0], flat[flat > 0]
    scale = max(1.0, h.max())
    goal = h / scale

    def forward(x):
        return np.bincount(flat, weights=x[pat], minlength=size)

    v = np.ones(len(p))
    for _ in range(20):  # largest eigenvalue of A'A
        v = np.bincount(pat, weights=forward(v)[flat], minlength=len(p))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (norm * 1.05)
    x = y = np.zeros(len(p))
    t = 1.0
    for _ in range(rounds):
        r = forward(y) - goal
        new = np.maximum(0, y - step * np.bincount(pat, weights=r[flat], minlength=len(p)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * scale


def plan(h: np.ndarray, rounds: int = 400) -> list[tuple[dict[int, int], int]]:
    """Containers as (size: number, repeats); h[s] counts the items of s steps, s <= len(h) - 1, the capacity."""
    cap = len(h) - 1
    left = h.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[dict[int, int], int]] = []

    def take(mult: dict[int, int], n: int) -> None:
        if n > 0:
            for s, m in mult.items():
                left[s] -= m * n
            out.append((mult, int(n)))

    p = patterns(cap)
    p = p[((p == 0) | (left[p] > 0)).all(axis=1)]
    if len(p):
        x = least_squares(p, left.astype(float), rounds)
        for i in np.argsort(-x, kind="stable"):
            n = int(x[i] + 1e-6)
            if n < 1:
                break
            mult: dict[int, int] = {}
            for s in p[i][p[i] > 0].tolist():
                mult[s] = mult.get(s, 0) + 1
            take(mult, min(n, *(left[s] // m for s, m in mult.items())))
    # largest first; each step uses up a size, so the steps are bounded by the sizes
    while left.any():
        room, mult = cap, {}
        for s in np.flatnonzero(left)[::-1].tolist():
            m = min(room // s, int(left[s]))
            if m:
                mult[s] = m
                room -= s * m
            if not room:
                break
        take(mult, min(left[s] // m for s, m in mult.items()))
    return out


@dataclass(frozen=True)
class Places:
    """Per size: first ranks of the ranges, first container of each, items of the size per container."""

    first: dict[int, np.ndarray]
    container: dict[int, np.ndarray]
    each: dict[int, np.ndarray]


def places(containers: list[tuple[dict[int, int], int]], base: int = 1) -> Places:
    f: dict[int, list] = {}
    used: dict[int, int] = {}
    for mult, n in containers:
        for s, m in mult.items():
            f.setdefault(s, []).append((used.get(s, 0), base, m))
            used[s] = used.get(s, 0) + m * n
        base += n
    arrays = {s: np.array(v, np.int64).T for s, v in f.items()}
    return Places({s: a[0] for s, a in arrays.items()}, {s: a[1] for s, a in arrays.items()}, {s: a[2] for s, a in arrays.items()})


def _assign(where: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (np.asarray(b.column(i)) for i in (3, 4))
            out = np.ones(len(size), np.int64)
            for s in np.unique(size[size > 0]).tolist():
                mine = np.flatnonzero(size == s)
                r = rank[mine] - 1
                i = np.searchsorted(where.first[s], r, side="right") - 1
                out[mine] = where.container[s][i] + (r - where.first[s][i]) // where.each[s][i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out)], ["doc_id", "piece_no", "tokens", "container"])

    return run


def pack(docs: DataFrame, capacity: int, s: Settings = Settings()) -> DataFrame:
    """doc_id, piece_no, tokens, container: one row per document, or per piece of a document over the capacity."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    width = -(-capacity // s.bins)
    steps = capacity // width
    sized = with_tokens(docs, ["doc_id"], vocabulary=s.vocabulary)
    full = F.floor(F.col("tokens") / F.lit(capacity)).cast("long")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(capacity))).cast("long")
    cut = sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), pieces)).alias("piece_no"))
    own = F.when(F.col("piece_no") <= full, F.lit(capacity)).otherwise(F.col("tokens") - F.lit(capacity) * (F.col("piece_no") - 1)).cast("long")
    items = cut.select("doc_id", "piece_no", own.alias("tokens"))
    step = F.least(F.lit(steps), F.ceil(F.col("tokens") / F.lit(width))).cast("int")
    items = materialize(items.withColumn("step", step))
    sizes = items.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    h = np.zeros(steps + 1, np.int64)
    for r in sizes.collect():  # at most bins + 1 rows
        h[r.step] = r.n
    where = places(plan(h, s.rounds))
    salts = F.element_at(F.lit([max(1, -(-int(n) // s.part_rows)) for n in h]), F.col("step") + 1)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), salts).cast("int"))
    counts = materialize(salted.groupBy("step", "salt").agg(F.count(F.lit(1)).alias("n")))
    # parts of a size before this one; a window over the parts, of which there is one for `part_rows` items
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("step").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = small_side(counts.select("step", "salt", ahead.alias("ahead")), s.max_broadcast_rows)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("step", "salt").orderBy("doc_id", "piece_no"))).join(offsets, ["step", "salt"])
    placed = ranked.select("doc_id", "piece_no", "tokens", "step", (F.col("rank") + F.col("ahead")).cast("long").alias("rank"))
    return placed.mapInArrow(_assign(where), "doc_id bigint, piece_no bigint, tokens bigint, container bigint")


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """containers, documents, tokens, used (share of the room that is used), fewest (containers that any packing needs)."""
    by = packed.groupBy("container").agg(F.sum("tokens").alias("t"))
    c = by.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("tokens"), F.max("t").alias("largest"))
    d = packed.agg(F.count_distinct("doc_id").alias("documents"))
    return c.join(F.broadcast(d)).select("containers", "documents", "tokens", "largest", (F.col("tokens") / (F.col("containers") * capacity)).alias("used"), F.ceil(F.col("tokens") / F.lit(capacity)).cast("long").alias("fewest"))

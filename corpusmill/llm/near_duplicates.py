"""Problem 1: near-duplicate records by consistent weighted sampling.

1. Each record becomes the multiset of its shingles (runs of `width` words) as 64-bit hashes.
   Records with the same shingle set form one class, found by a hash of the set; only one
   representative of a class goes on.
2. Shingles are weighted by TF-IDF with both factors bounded: TF from 1 to `tf_most`, and IDF from 1 (a shingle of every record) to
   `spread / tf_most` (shingles in at most the share `common` of the records). Document frequencies of all
   records are added up in counters addressed by hash, enough of them that a counter's noise stays below a quarter of `common`; their
   number follows from the mean length of a record, not from the number of records.
   As weights differ by at most `spread`, a pair of exact set similarity e has a weighted similarity of at
   least e / (tf_most * e + spread * (1 - e)), however frequent its common and however rare its differing shingles are. Where the
   exact similarity decides, the sampling plan and the digests below follow from that bound.
3. Improved consistent weighted sampling (Ioffe) draws `bands * rows` samples per record. Two records agree in a
   sample with probability equal to their weighted Jaccard similarity. Samples are cut into
   bands; records that agree in a whole band are candidates.
4. Pairs (`alike_pairs`): bands are shuffled with a four-bit digest per sample; where the exact similarity decides, the digests are of as many
   minwise samples, which estimate it. Buckets of more than `block` members are
   cut into blocks and every pair of blocks becomes a cell of its own, so a bucket that holds
   a third of all records is spread over many tasks. A cell puts out only pairs whose digests agree in enough places.
   Groups (`alike_groups`): each member of a bucket meets only the bucket's hub first, which joins most of a
   family over links to a few records; then only members of a bucket that are still in different groups meet each other. A family of
   n variants so takes n * bands rows, not n * n, and the groups are those of all pairs.
5. Candidates are verified by weighted Jaccard similarity, and, for an exact set similarity, by that.

Nulls: rows without id or content, and records of fewer than `min_words` words, take no part. Repeated rows
of an id count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm import blocks as B
from corpusmill.session import materialize, small_side


@dataclass(frozen=True)
class Settings:
    """width: words in a shingle. weighted: least weighted Jaccard similarity, or 0 to let `exact` alone
    decide. exact: least share of common distinct shingles in the union, or 0 for no such check. bands, rows: sampling plan;
    at weighted similarity 0.57, the least one of an exact 0.7, a pair is missed with probability (1 - 0.57**3)**24 = 0.007, at 0.61 with
    0.002, at 0.7 with 0.00004. spread, tf_most, common, levels: weights, see above; they are rounded to `levels` steps. block: members of a
    bucket that one task compares. most_bits: bound of the frequency table, 2**most_bits counters."""

    width: int = 5
    min_words: int = 0
    weighted: float = 0.8
    exact: float = 0.0
    bands: int = 24
    rows: int = 3
    spread: float = 1.5
    tf_most: float = 1.1
    common: float = 0.002
    levels: int = 16
    most_bits: int = 22
    block: int = 512
    seed: int = 20177
    max_broadcast_rows: int = 100_000

    @property
    def bound(self) -> float:
        """The least weighted similarity of a pair that counts."""
        return self.weighted or self.exact / (self.tf_most * self.exact + self.spread * (1 - self.exact))

    @property
    def least(self) -> int:
        """Samples in which the digests of a pair that counts agree, but for three deviations of the estimate."""
        n, b = self.bands * self.rows, self.weighted or self.exact
        return int(np.ceil(n * max(b - 3 * np.sqrt(b * (1 - b) / n), 0.5 * b)))


_TABLE_BITS = 14


@dataclass(frozen=True)
class Frequencies:
    """ln(N / df) of every counter, float32."""

    table: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.table).bit_length() - 1

    def levels(self, keys: np.ndarray, count: np.ndarray, s: Settings) -> np.ndarray:
        """Step of the TF-IDF weight of each shingle, 0 .. levels - 1."""
        idf = np.clip(self.table[(keys >> np.uint64(64 - self.bits)).astype(np.int64)] / -np.log(s.common), 0, 1)
        tf = np.minimum(np.log2(count) / 3, 1)
        w = (1 + (s.tf_most - 1) * tf) * (1 + (s.spread / s.tf_most - 1) * idf)
        return np.rint((w - 1) / (s.spread - 1) * (s.levels - 1)).astype(np.int64)


def weight_of(level: np.ndarray, s: Settings) -> np.ndarray:
    return 1 + level * ((s.spread - 1) / (s.levels - 1))


def _draws(s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per sample an odd multiplier; per slot and weight level the rank of ln c - r (t - beta + 1) among all, and t."""
    g = np.random.default_rng(s.seed)
    k, size = s.bands * s.rows, 1 << _TABLE_BITS
    odd = g.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    r, c, beta = g.gamma(2.0, 1.0, size)[:, None], g.gamma(2.0, 1.0, size)[:, None], g.random(size)[:, None]
    t = np.floor(np.log(weight_of(np.arange(s.levels), s))[None, :] / r + beta)
    a = (np.log(c) - r * (t - beta + 1)).ravel()
    rank = np.empty(len(a), np.uint64)
    rank[np.argsort(a, kind="stable")] = np.arange(len(a), dtype=np.uint64)
    return odd, rank << np.uint64(32), t.ravel().astype(np.int64).astype(np.uint64)


def _shingles(texts: list[bytes], width: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles, the text of each, and the texts with at least `min_words` words.

    A text of fewer words than `width` is one shingle; an empty one has none.
    """
    buf, starts = B.joined(texts)
    ws, we = B.words(buf)
    h = B.span_hashes(buf, ws, we)
    doc = np.searchsorted(starts, ws, side="right") - 1
    n = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        key, last = np.zeros(max(0, len(h) - width + 1), np.uint64), len(h) - width + 1
        for i in range(width):
            key = B.mix(key * np.uint64(3) + h[i : i + max(0, last)]) if last > 0 else key
    same = doc[: len(key)] == doc[width - 1 :] if len(key) else np.zeros(0, bool)
    keys, docs = key[same], doc[: len(key)][same]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.array([np.bitwise_xor.reduce(B.mix(h[a : a + n[d]] + np.arange(n[d], dtype=np.uint64))) for a, d in zip(first, short)], np.uint64)
        keys, docs = np.concatenate([keys, extra]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        keys, docs = keys[order], docs[order]
    fit = n >= max(1, min_words)
    use = fit[docs]
    return keys[use], docs[use], np.flatnonzero(fit)


def _grouped(batch: pa.RecordBatch, s: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of rows: first row, rows that fit, start of each, distinct shingles, their counts."""
    ids, texts = batch.column(0), batch.column(1)
    for lo, hi in B.text_chunks(texts):
        lower = [t.lower().encode("utf-8", "surrogatepass") for t in texts.slice(lo, hi - lo).to_pylist()]
        keys, docs, fit = _shingles(lower, s.width, s.min_words)
        order = np.lexsort((keys, docs))
        keys, docs = keys[order], docs[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(keys)))
        yield lo, fit, np.searchsorted(docs[at], fit), keys[at], count


def _sketch_frequencies(s: Settings, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, docs = 1 << bits, 0
        df = np.zeros(size, np.int64)
        for batch in batches:
            for _, fit, _, keys, _ in _grouped(batch, s):
                df += np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=size)
                docs += len(fit)
        part = max(1, size >> 6)
        if docs:
            blocks = range(0, size, part)
            kind = np.int32 if df.max() < 2**31 else np.int64
            cut = [df[i : i + part].astype(kind).tobytes() for i in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([docs if i == 0 else 0 for i in blocks]), pa.array(cut, pa.binary())], ["block", "docs", "df"])

    return run


def _add_blocks(part: int):
    """Add up partial tables as they stream by; holds one sum per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n, df in zip(*(c.to_pylist() for c in batch.columns)):
                docs[block] = docs.get(block, 0) + n
                got = np.frombuffer(df, np.int32 if len(df) == 4 * part else np.int64).astype(np.int64)
                sums[block] = sums[block] + got if block in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(docs.values()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "docs", "df"])

    return run


def frequencies(docs: DataFrame, s: Settings) -> Frequencies:
    """Document frequencies of all records, in at most `2**most_bits` counters of which the driver holds one table."""
    chars = docs.agg(F.avg(F.length("content"))).first()[0] or 1.0
    bits = int(np.clip(np.ceil(np.log2(4 * (chars / 6 + 1) / s.common)), 14, s.most_bits))
    form = "block int, docs bigint, df binary"
    parts = docs.select("id", "content").mapInArrow(_sketch_frequencies(s, bits), form)
    rows = parts.repartition("block").mapInArrow(_add_blocks((1 << bits) >> 6), form).collect()
    if not rows:
        return Frequencies(np.zeros(1 << bits, np.float32))
    df = np.concatenate([np.frombuffer(r.df, np.int64) for r in sorted(rows, key=lambda r: r.block)])
    n = max(1, sum(r.docs for r in rows))
    return Frequencies(np.log(n / np.clip(df, 1, n)).astype(np.float32))


def _sample(keys: np.ndarray, level: np.ndarray, starts: np.ndarray, draws: tuple[np.ndarray, ...], s: Settings) -> np.ndarray:
    """One 64-bit sample per record and draw: the hash of the chosen shingle and its level t. Shingles that tie in slot and weight
    go by their hash."""
    odd, rank, t = draws
    out = np.zeros((len(odd), len(starts)), np.uint64)
    place = np.arange(len(keys), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for k, m in enumerate(odd):
            slot = ((keys * m) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64) * s.levels + level
            hit = (np.minimum.reduceat(rank[slot] | place, starts) & low).astype(np.int64)
            out[k] = B.mix(keys[hit] ^ (m + t[slot[hit]]))
    return out


def _minima(keys: np.ndarray, starts: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """One 64-bit minwise sample per record and draw: two records agree with probability equal to their exact set similarity."""
    out = np.zeros((len(odd), len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for k, m in enumerate(odd):
            out[k] = B.mix(np.minimum.reduceat(keys * m, starts) + m)
    return out


def _packed(got: np.ndarray) -> np.ndarray:
    """Four bits of each sample, two samples a byte, one row per record; an odd sample is paired with zeros."""
    d = (got & np.uint64(15)).astype(np.uint8)
    if len(d) % 2:
        d = np.concatenate([d, np.zeros_like(d[:1])])
    return np.ascontiguousarray((d[0::2] | d[1::2] << 4).T)


def _sign(s: Settings, idf: Frequencies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = _draws(s)
        for batch in batches:
            for lo, fit, starts, keys, count in _grouped(batch, s):
                if not len(fit):
                    continue
                got = _sample(keys, idf.levels(keys, count, s), starts, draws, s)
                with np.errstate(over="ignore"):
                    whole = np.add.reduceat(B.mix(keys ^ np.uint64(s.seed)), starts)
                    band = np.zeros((s.bands, len(fit)), np.uint64)
                    for j in range(s.bands):
                        x = np.full(len(fit), j + 1, np.uint64)
                        for q in range(s.rows):
                            x = B.mix(x * np.uint64(5) + got[j * s.rows + q])
                        band[j] = x
                size = np.diff(np.append(starts, len(keys)))
                digest = _packed(got if s.weighted else _minima(keys, starts, draws[0]))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fit) * s.bands + 1, s.bands), pa.int32()), pa.array(np.ascontiguousarray(band.T).view(np.int64).ravel()))
                ids = batch.column(0).slice(lo).take(pa.array(fit))
                yield pa.RecordBatch.from_arrays([ids, pa.array(whole.view(np.int64)), pa.array(size), bands, pa.array([x.tobytes() for x in digest], pa.binary())], ["id", "whole", "size", "bands", "digest"])

    return run


def _pairs_in_cells(samples: int, least: int):
    """Pairs of a cell whose digests of `samples` places agree in at least `least` of them. Rows come sorted by cell; a cell has at
    most two blocks of members, which bounds what is carried from batch to batch. With a column g, pairs of equal g are left out."""

    def compare(key, digest, part, lo, hi):
        n = hi - lo
        if n < 2:
            return None
        d = digest[lo:hi]
        out = []
        step = max(1, 4_000_000 // (n * d.shape[1]))
        for a in range(0, n, step):
            agree = (d[a : a + step, None, :] == d[None, :, :]).sum(axis=2)
            x, y = np.nonzero(agree >= least)
            x = x + a
            ok = x < y
            out.append((x[ok], y[ok]))
        x, y = (np.concatenate([p[i] for p in out]) for i in (0, 1))
        p = part[lo:hi]
        if p.max() > 0:  # a cell of two blocks compares across them only
            ok = p[x] != p[y]
            x, y = x[ok], y[ok]
        return x + lo, y + lo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pa.Table) -> pa.RecordBatch:
            key = np.stack([t.column(c).to_numpy() for c in ("key", "a", "b")])
            rep, part = t.column("rep").combine_chunks(), t.column("part").to_numpy()
            packed = np.frombuffer(b"".join(t.column("digest").to_pylist()), np.uint8).reshape(len(part), -1)
            digest = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(part), -1)[:, :samples]
            new = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            size = np.diff(np.append(new, len(part)))
            two = new[(size == 2) & (part[new] == 0)]
            ok = two[(digest[two] == digest[two + 1]).sum(axis=1) >= least]
            xs, ys = [ok], [ok + 1]
            for lo, n in zip(new[size > 2], size[size > 2]):
                if (r := compare(key, digest, part, lo, lo + n)) is not None:
                    xs.append(r[0])
                    ys.append(r[1])
            two = new[(size == 2) & (part[new] != part[np.minimum(new + 1, len(part) - 1)])]
            ok = two[(digest[two] == digest[two + 1]).sum(axis=1) >= least]
            x, y = np.concatenate([*xs, ok]).astype(np.int64), np.concatenate([*ys, ok + 1]).astype(np.int64)
            if "g" in t.column_names:
                g = t.column("g").to_numpy()
                x, y = x[g[x] != g[y]], y[g[x] != g[y]]
            return pa.RecordBatch.from_arrays([rep.take(pa.array(x)), rep.take(pa.array(y))], ["x", "y"])

        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            key = np.stack([t.column(c).to_numpy() for c in ("key", "a", "b")])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield emit(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).combine_chunks()
        if held is not None and held.num_rows > 1:
            yield emit(held)

    return run


def _candidates(classes: DataFrame, s: Settings) -> DataFrame:
    """x, y: representatives whose samples agree in a band and, by their digests, in enough places overall."""
    bands = classes.select(F.explode("bands").alias("key"), "rep", "digest")
    counts = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {s.block}")
    large = materialize(counts)
    sized = bands.join(small_side(large, s.max_broadcast_rows), "key", "left")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(s.block))).cast("int")
    placed = sized.withColumn("blocks", F.coalesce(blocks, F.lit(1))).withColumn("g", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = placed.select("key", "rep", "digest", "g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    cells = cells.select("key", F.least("g", "j").alias("a"), F.greatest("g", "j").alias("b"), (F.col("g") == F.greatest("g", "j")).cast("int").alias("hi"), "g", "j", "rep", "digest")
    part = F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("hi") + 1)
    cells = cells.select("key", "a", "b", part.cast("int").alias("part"), "rep", "digest")
    return _compared(cells, s)


def _compared(cells: DataFrame, s: Settings) -> DataFrame:
    keyed = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    pairs = keyed.mapInArrow(_pairs_in_cells(s.bands * s.rows, s.least), "x string, y string")
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct()


def _stars(classes: DataFrame, s: Settings) -> DataFrame:
    """x, y: each member of a bucket with the bucket's hub, where their digests agree in enough places. The hub is the member of
    the smallest hash with the bucket's key, so a family has another one in each band."""
    bands = classes.select(F.explode("bands").alias("key"), "rep", "digest")
    hubs = bands.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "rep").alias("h"), "rep", "digest")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = bands.join(hubs.select("key", "hub"), "key").where("rep <> hub.rep")
    agreed = met.select("rep", F.col("hub.rep").alias("hub"), "digest", F.col("hub.digest").alias("other")).mapInArrow(_agreeing(s), "x string, y string")
    return agreed.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _agreeing(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            n = ((a & 15) == (b & 15)).sum(axis=1) + ((a >> 4) == (b >> 4)).sum(axis=1)  # an odd last sample is paired with zeros
            ok = pa.array(np.flatnonzero(n - s.bands * s.rows % 2 >= s.least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok)], ["x", "y"])

    return run


def _apart(classes: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """x, y: members of one bucket that are in different groups and whose digests agree in enough places.

    Of a bucket, the members outside its largest group (few, after `_stars`) meet all others, in blocks.
    """
    named = classes.join(labels, "rep", "left").select("rep", "digest", "bands", F.xxhash64(F.coalesce("label", "rep")).alias("g"))
    bands = named.select(F.explode("bands").alias("key"), "rep", "digest", "g")
    by_group = bands.groupBy("key", "g").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_group.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "g")).alias("top"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    sizes = mixed.select("key", F.col("top.g").alias("main"), F.ceil(F.col("n") / s.block).cast("int").alias("all"), F.ceil((F.col("n") - F.col("top.n")) / s.block).cast("int").alias("few"))
    placed = bands.join(small_side(materialize(sizes), s.max_broadcast_rows), "key")
    h = F.xxhash64("rep", F.lit(3))
    every = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("a"), F.pmod(h, F.col("all")).cast("int").alias("b"), F.lit(2).alias("part"), "rep", "digest", "g")
    few = placed.where("g <> main").select("key", F.pmod(h, F.col("few")).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("b"), F.lit(1).alias("part"), "rep", "digest", "g")
    return _compared(every.unionByName(few), s)


def _bags(s: Settings):
    """id and the record's shingles as sorted hashes, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, fit, starts, keys, count in _grouped(batch, s):
                ends = np.append(starts[1:], len(keys)) if len(starts) else starts
                bags = [np.repeat(keys[a:b], count[a:b]).tobytes() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo).take(pa.array(fit)), pa.array(bags, pa.binary())], ["id", "bag"])

    return run


def _verify(s: Settings, idf: Frequencies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weighted, exact = [], []
            for a, b in zip(batch.column(2), batch.column(3)):
                (p, m), (q, n) = (np.unique(np.frombuffer(z.as_py(), np.uint64), return_counts=True) for z in (a, b))
                both, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
                exact.append(len(both) / max(1, len(p) + len(q) - len(both)))
                u, v = (weight_of(idf.levels(h, c, s), s) for h, c in ((p, m), (q, n)))
                common = np.minimum(u[i], v[j]).sum()
                weighted.append(float(common / max(u.sum() + v.sum() - common, 1e-12)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weighted, pa.float64()), pa.array(exact, pa.float64())], ["x", "y", "weighted", "jaccard"])

    return run


@dataclass(frozen=True)
class _Signed:
    """docs: id, content. members: id and rep of every record that takes part. classes: rep, bands, digest of the representatives."""

    docs: DataFrame
    members: DataFrame
    classes: DataFrame
    idf: Frequencies


def _signed(records: DataFrame, s: Settings) -> _Signed:
    docs = records.where("id is not null and content is not null").select("id", "content")
    idf = frequencies(docs, s)
    signed = materialize(docs.mapInArrow(_sign(s, idf), "id string, whole bigint, size bigint, bands array<bigint>, digest binary"))
    first = signed.groupBy("whole", "size").agg(F.min("id").alias("rep"))
    members = materialize(signed.select("id", "whole", "size").distinct().join(first, ["whole", "size"]).select("id", "rep"))
    reps = members.where("id = rep").select("rep").distinct()
    classes = signed.dropDuplicates(["id"]).join(reps, signed.id == reps.rep, "left_semi").select(F.col("id").alias("rep"), "bands", "digest")
    return _Signed(docs, members, classes, idf)


def _verified(pairs: DataFrame, g: _Signed, s: Settings) -> DataFrame:
    """x, y, weighted, jaccard of the pairs that are alike."""
    pairs = materialize(pairs)
    wanted = materialize(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct())
    bags = g.docs.join(small_side(wanted, s.max_broadcast_rows), "id", "left_semi").mapInArrow(_bags(s), "id string, bag binary").dropDuplicates(["id"])
    bags = materialize(bags)
    left, right = bags.select(F.col("id").alias("x"), F.col("bag").alias("p")), bags.select(F.col("id").alias("y"), F.col("bag").alias("q"))
    joined = pairs.join(left, "x").join(right, "y").select("x", "y", "p", "q")
    links = joined.mapInArrow(_verify(s, g.idf), "x string, y string, weighted double, jaccard double")
    return links.where((F.col("weighted") >= s.weighted) & (F.col("jaccard") >= s.exact))


def near_duplicates(records: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(members, links): id and rep of every record that takes part; x, y, weighted, jaccard of the linked
    representatives. Records with the same shingle set have the same representative."""
    g = _signed(records, s)
    return g.members, _verified(_candidates(g.classes, s), g, s)


def alike_pairs(records: DataFrame, s: Settings, expand: int = 64) -> DataFrame:
    """id_a, id_b (id_a < id_b) of alike records.

    Links between different texts are put out for every record of either class. Records of one class are
    paired with each other, unless the class has more than `expand` members; such a class appears as
    pairs of each member with its representative, and its links by its representative, which loses none.
    """
    members, links = near_duplicates(records, s)
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    small = members.join(sizes.where(F.col("n") <= expand), "rep").select("rep", "id")
    huge = sizes.where(F.col("n") > expand).select("rep")
    stand_ins = small.unionByName(huge.select("rep", F.col("rep").alias("id")))
    # classes of one member pass without joins
    multi = materialize(stand_ins.join(sizes.where("n > 1"), "rep", "left_semi"))
    links = materialize(links.select("x", "y"))
    a = multi.select(F.col("rep").alias("x"), F.col("id").alias("ia"))
    b = multi.select(F.col("rep").alias("y"), F.col("id").alias("ib"))
    across = links.join(a, "x", "left").join(b, "y", "left").select(F.coalesce("ia", "x").alias("p"), F.coalesce("ib", "y").alias("q"))
    within = multi.join(huge, "rep", "left_anti").alias("m").join(multi.alias("o"), "rep").where("m.id < o.id").select(F.col("m.id").alias("p"), F.col("o.id").alias("q"))
    star = members.join(huge, "rep", "left_semi").where("id <> rep").select(F.col("rep").alias("p"), F.col("id").alias("q"))
    every = across.unionByName(within).unionByName(star)
    return every.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()


def _components(links: DataFrame) -> DataFrame:
    """rep, label: the smallest representative that can be reached over links x, y.

    Labels spread along links (large-star and small-star steps) on tables of links; each round is written to the
    checkpoint folder. The rounds end when no edge changes, whatever their number.
    """
    edges = links
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("m").alias("x"), "y").where("x <> y")
        down = large.select(F.col("y").alias("x"), F.col("x").alias("y")).distinct()
        low = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(low, "x").select(F.col("m").alias("a"), F.col("y").alias("b")).where("a <> b").unionByName(low.select(F.col("m").alias("a"), F.col("x").alias("b")))
        after = materialize(small.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct())
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    one = after.groupBy(F.col("y").alias("rep")).agg(F.min("x").alias("label"))
    return one.unionByName(one.select(F.col("label").alias("rep"), "label").distinct())


def alike_groups(records: DataFrame, s: Settings) -> DataFrame:
    """id, rep, group_id of every record that takes part: group_id is the smallest representative that can be
    reached over links. The groups are those of all pairs, found without putting out all pairs of a family."""
    g = _signed(records, s)
    near = materialize(_verified(_stars(g.classes, s), g, s).select("x", "y"))
    labels = materialize(_components(near))
    rest = materialize(_verified(_apart(g.classes, labels, s), g, s).select("x", "y"))
    if not rest.isEmpty():
        labels = _components(labels.where("rep <> label").select(F.col("label").alias("x"), F.col("rep").alias("y")).unionByName(rest).distinct())
    return g.members.join(labels, "rep", "left").select("id", "rep", F.coalesce("label", "rep").alias("group_id"))

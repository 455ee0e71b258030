"""Problem 6: lines repeated across the documents of one host.

Each text is parsed once, as bytes: its lines are normalized, cut into tokens and placed in a tree of fixed depth: host, number of
tokens, the first `depth` tokens. What is kept of a line is its number, its node, a hash of its tokens, and its slots: a
byte for each of the eight positions behind the first `depth`, the last one for all that follow. A node covers lines and
holds the bits that all their slots have and the bits that any has, so trees of different partitions merge by adding counts and by `and` and `or` of slots
(a groupBy with map-side combine). A slot whose bits differ is a wildcard; nodes with their wildcards are the templates.

A template covers at least as many records as any line in it, so nodes below the threshold are cut without loss, and
what is removed are the places of the templates that remain. Where lines must repeat as they are (`exact`), the lines of these templates alone are counted.

Nulls: rows without id, host or content are left out. Empty texts have no lines. Repeated
rows of a record count once, as do repeats of a line within a record; every place is put out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm import blocks as B, page_lines as P
from corpusmill.session import materialize, small_side

# The ASCII digits and punctuation that are deleted before lines are compared.
DELETED = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KEPT = np.ones(256, bool)
_KEPT[list(DELETED.encode())] = False
SLOTS = 8
_PARSED = "id string, h bigint, no array<int>, node array<bigint>, line array<bigint>, slots array<bigint>"


def normal_line(line: Column) -> Column:
    """Lower case, no ASCII digits or punctuation, single spaces, trimmed."""
    return F.btrim(F.regexp_replace(F.translate(F.lower(line), DELETED, ""), r"[ \t\r\n]+", " "), F.lit(" "))


def parse(texts: list[bytes], hosts: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """text, line number, node, line hash and slots of every line that is not empty after normalization; texts are in lower case."""
    buf, _ = B.joined(texts)
    buf = buf[_KEPT[buf]]
    ends = np.flatnonzero(buf == 10)
    lines_in = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    start, end = B.words(buf)
    tok = B.span_hashes(buf, start, end)
    of = np.searchsorted(ends, start)
    n = np.bincount(of, minlength=len(ends))
    key = P.sequence_keys(tok, of, len(ends), n)
    at = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[at]
    doc = np.repeat(np.arange(len(texts)), lines_in)[at]
    no = at - (np.cumsum(lines_in) - lines_in)[doc] + 1
    with np.errstate(over="ignore"):
        node = B.mix(hosts[doc].view(np.uint64) + n[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for j in range(depth):
            has = n[at] > j
            node[has] = B.mix(node[has] * np.uint64(5) + tok[first[has] + j])
        slots = np.zeros(len(at), np.uint64)
        for j in range(SLOTS - 1):
            has = n[at] > depth + j
            slots[has] |= (tok[first[has] + depth + j] & np.uint64(255)) << np.uint64(8 * j)
        long = np.flatnonzero(n[at] >= depth + SLOTS)  # the last slot is a hash of all that follows
        slots[long] |= (key[at[long]] & np.uint64(255)) << np.uint64(8 * (SLOTS - 1))
    return doc, no, node, key[at], slots


def _parse(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in B.text_chunks(batch.column(2)):
                texts = [t.lower().encode("utf-8", "surrogatepass") for t in batch.column(2).slice(lo, hi - lo).to_pylist()]
                doc, no, node, line, slots = parse(texts, hosts[lo:hi], depth)
                offset = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offset, pa.array(x)) for x in (no.astype(np.int32), *(y.view(np.int64) for y in (node, line, slots)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *lists], ["id", "h", "no", "node", "line", "slots"])

    return run


def _usable(records: DataFrame) -> DataFrame:
    return records.where("id is not null and host is not null and content is not null")


def parsed_lines(records: DataFrame, depth: int = 3) -> DataFrame:
    """id, h (hash of the host), and the parsed lines as arrays: the one pass over the texts, written once."""
    return materialize(_usable(records).select("id", F.xxhash64("host").alias("h"), "content").mapInArrow(_parse(depth), _PARSED))


def _host_limits(records: DataFrame, min_records: int, min_share: float) -> DataFrame:
    n = _usable(records).select("host", "id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_records"))
    least = F.greatest(F.lit(min_records), F.ceil(F.col("host_records") * F.lit(min_share) - F.lit(1e-9))).cast("long")
    return materialize(n.select(F.xxhash64("host").alias("h"), "host", least.alias("least")))


def _lines(parsed: DataFrame) -> DataFrame:
    return parsed.select("id", "h", F.explode(F.arrays_zip("no", "node", "line", "slots")).alias("x")).select("id", "h", "x.*")


def templates(parsed: DataFrame, limits: DataFrame, max_broadcast_rows: int = 100_000) -> DataFrame:
    """h, node, cover, every, some, least: nodes of the merged tree that cover enough lines for their host."""
    tree = _lines(parsed).groupBy("h", "node").agg(F.count(F.lit(1)).alias("cover"), F.bit_and("slots").alias("every"), F.bit_or("slots").alias("some"))
    return materialize(tree.join(small_side(limits.select("h", "least"), max_broadcast_rows), "h").where("cover >= least"))


def repeated_places(records: DataFrame, min_records: int = 5, min_share: float = 0.1, depth: int = 3, max_broadcast_rows: int = 100_000, exact: bool = True) -> DataFrame:
    """id, line_no of every place of a repeated line.

    A line is repeated if it stands in at least `min_records` records and in at least the share `min_share` of its host's
    records. Without `exact` the same is asked of its template.
    """
    parsed, limits = parsed_lines(records, depth), _host_limits(records, min_records, min_share)
    found = templates(parsed, limits, max_broadcast_rows).select("h", "node", "least")
    places = materialize(_lines(parsed).join(small_side(found, max_broadcast_rows), ["h", "node"]).select("id", "h", "node", F.when(F.lit(exact), F.col("line")).otherwise(0).alias("line"), "no", "least"))
    per_record = places.select("h", "node", "line", "least", "id").distinct()
    cases = materialize(per_record.groupBy("h", "node", "line", "least").agg(F.count(F.lit(1)).alias("records")).where("records >= least").select("h", "node", "line"))
    kept = places.join(small_side(cases, max_broadcast_rows), ["h", "node", "line"], "left_semi")
    return kept.select("id", F.col("no").cast("long").alias("line_no")).distinct()


def line_templates(records: DataFrame, min_records: int = 5, min_share: float = 0.1, depth: int = 3, max_broadcast_rows: int = 100_000) -> DataFrame:
    """host, template, lines, records: the templates in enough records, with `<*>` for wildcard slots (one for all positions of the
    last slot). `lines` counts the distinct normalized lines of the template, `records` the records with any of them."""
    parsed, limits = parsed_lines(records, depth), _host_limits(records, min_records, min_share)
    found = templates(parsed, limits, max_broadcast_rows)
    places = materialize(_lines(parsed).join(small_side(found.select("h", "node", "least", "every", "some"), max_broadcast_rows), ["h", "node"]))
    lines = places.select("h", "node", "line").distinct().groupBy("h", "node").agg(F.count(F.lit(1)).alias("lines"))
    ids = places.select("h", "node", "least", "every", "some", "id").distinct().groupBy("h", "node", "least", "every", "some").agg(F.count(F.lit(1)).alias("records")).where("records >= least")
    example = places.groupBy("h", "node").agg(F.min(F.struct("id", "no")).alias("at"))
    shown = materialize(ids.join(lines, ["h", "node"]).join(example, ["h", "node"]).join(limits.select("h", "host"), "h").select("host", "lines", "records", "every", "some", "at.id", "at.no"))
    texts = _usable(records).select("id", "content").join(small_side(shown.select("id").distinct(), max_broadcast_rows), "id", "left_semi").groupBy("id").agg(F.min("content").alias("content"))
    words = F.split(normal_line(F.element_at(F.split("content", "\n"), F.col("no"))), " ")
    open_at = lambda j: F.shiftrightunsigned(F.col("some").bitwiseXOR(F.col("every")), 8 * j).bitwiseAND(F.lit(255)) != 0
    opened = F.array(*[open_at(j) for j in range(SLOTS)])
    last = depth + SLOTS - 1
    slot = lambda w, i: F.when((i >= depth) & F.element_at(opened, F.least(F.greatest(i - depth, F.lit(0)), F.lit(SLOTS - 1)) + 1), F.lit("<*>")).otherwise(w)
    cut = F.when(F.element_at(opened, SLOTS), F.slice("w", 1, last + 1)).otherwise(F.col("w"))
    return shown.join(texts, "id").withColumn("w", words).select("host", F.array_join(F.transform(cut, slot), " ").alias("template"), F.col("lines").cast("long"), F.col("records").cast("long"))


def remove_repeated(records: DataFrame, **options) -> DataFrame:
    """id, content with the repeated lines taken out; the first row of a repeated record is kept."""
    from corpusmill.llm.records import without_repeats

    places = repeated_places(records, **options).groupBy("id").agg(F.collect_set("line_no").alias("drop_lines"))
    rows = without_repeats(records.where("content is not null")).join(places, "id", "left")
    gone = F.coalesce("drop_lines", F.array().cast("array<bigint>"))
    kept = F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains(gone, (i + 1).cast("long")))
    return rows.select("id", F.array_join(kept, "\n").alias("content"))

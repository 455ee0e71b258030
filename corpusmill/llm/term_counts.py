"""Problem 7: occurrences and record frequency of every term.

Every term has a last-seen counter: occurrences, records, and the record in which it was last seen. A record is
counted when it differs from the one last seen, so no set of terms is kept per record.

Tokens are combined where they are read: a task numbers its records in the order in which it reads them, counts their
tokens, and puts out one row per term with the first and the last record of the count. Only these rows are hash-partitioned by term; ordered by
record they are added up, and a record that two neighbouring rows share (a task puts its counters out when
they fill its memory, which may be in the midst of a record) is counted once. Texts are never shuffled, but for the few
rows whose id repeats.

Nulls: rows without id or content are left out. Empty texts count as records without terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.records import without_repeats

# The ASCII punctuation stripped from both ends of a term.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TO_SPACE = str.maketrans("\t\r\n", "   ")
PIECE = 1 << 20
_PARTIAL = "term string, first bigint, last bigint, occ bigint, rec bigint"


class Counters:
    """Last-seen counters of the terms met so far."""

    def __init__(self) -> None:
        self.raw: dict[str, int] = {}
        self.terms: dict[str, int] = {}
        self.occ, self.rec, self.first, self.last = (np.full(1 << 12, x, np.int64) for x in (0, 0, -1, -1))

    def _index(self, word: str) -> int:
        term = word.strip(PUNCTUATION)
        k = self.terms.setdefault(term, len(self.terms)) if term else -1
        self.raw[word] = k
        return k

    def add(self, record: int, words: list[str]) -> None:
        get, index = self.raw.get, self._index
        found = [k if (k := get(w)) is not None else index(w) for w in words]
        ids = np.fromiter(found, np.int64, len(found))
        ids = ids[ids >= 0]
        while len(self.terms) > len(self.occ):
            self.occ, self.rec = (np.concatenate([x, np.zeros_like(x)]) for x in (self.occ, self.rec))
            self.first, self.last = (np.concatenate([x, np.full_like(x, -1)]) for x in (self.first, self.last))
        np.add.at(self.occ, ids, 1)
        new = ids[self.last[ids] != record]
        self.last[new] = record
        self.rec[new] += 1  # buffered: a term met twice in the record is added once
        fresh = new[self.first[new] < 0]
        self.first[fresh] = record

    def rows(self) -> pa.RecordBatch:
        n = len(self.terms)
        cols = [pa.array(self.terms.keys(), pa.string()), *(pa.array(x[:n]) for x in (self.first, self.last, self.occ, self.rec))]
        return pa.RecordBatch.from_arrays(cols, ["term", "first", "last", "occ", "rec"])


def _pieces(content: str, size: int) -> Iterator[list[str]]:
    """Words of a text, about `size` characters at a time; never cut within a word."""
    text = content.translate(_TO_SPACE)
    at = 0
    while at < len(text):
        end = text.find(" ", at + size) if at + size < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].lower().split(" ")
        at = end


def _count(max_terms: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        record = (task.partitionId() if task else 0) << 40
        counters = Counters()
        for batch in batches:
            for content in batch.column(0):
                record += 1
                for words in _pieces(content.as_py(), piece):
                    counters.add(record, words)
                    if len(counters.raw) > max_terms:  # what has been counted is put out; nothing is dropped
                        yield counters.rows()
                        counters = Counters()
        if counters.terms:
            yield counters.rows()

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each term, which come ordered by (term, first); holds the sum of one term from batch to batch."""
    names = ["term", "occurrences", "records"]
    held: tuple[str, int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        term = batch.column(0).dictionary_encode()
        code = term.indices.to_numpy(zero_copy_only=False)
        first, last, occ, rec = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
        begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        shared = np.append(False, (code[1:] == code[:-1]) & (first[1:] == last[:-1]))
        o, r = np.add.reduceat(occ, begin), np.add.reduceat(rec - shared, begin)
        words = batch.column(0).take(pa.array(begin)).to_pylist()
        if held is not None and held[0] == words[0]:
            o[0] += held[2]
            r[0] += held[3] - (held[1] == first[0])
        elif held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[2]]), pa.array([held[3]])], names)
        held = (words[-1], int(last[-1]), int(o[-1]), int(r[-1]))
        if len(words) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(words[:-1], pa.string()), pa.array(o[:-1]), pa.array(r[:-1])], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[2]]), pa.array([held[3]])], names)


def term_counts(records: DataFrame, max_terms: int = 1_000_000, piece: int = PIECE) -> DataFrame:
    """term, occurrences, records over all records, each id counted once.

    `max_terms` bounds a worker's memory: with more distinct words it puts out its counters and starts
    anew, which changes no sum. Long texts are read `piece` characters at a time.
    """
    rows = without_repeats(records.where("id is not null and content is not null").select("id", "content"), order_col=None)
    partial = rows.select("content").mapInArrow(_count(max_terms, piece), _PARTIAL)
    ordered = partial.repartition("term").sortWithinPartitions("term", "first", "last")
    return ordered.mapInArrow(_add, "term string, occurrences bigint, records bigint")


def marked_terms(records: DataFrame, min_records: int = 3, max_share: float = 0.2) -> DataFrame:
    """term, occurrences, records, mark: `rare` below `min_records` records, `common` above the share
    `max_share` of all records, else null."""
    total = records.where("id is not null and content is not null").select("id").distinct().agg(F.count(F.lit(1)).alias("total"))
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > F.col("total") * F.lit(max_share), "common")
    return term_counts(records).join(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))

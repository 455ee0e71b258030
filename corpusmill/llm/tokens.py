"""Token counts of a public byte-level BPE, fast enough for whole corpora.

No token of such a tokenizer crosses from a word into the white space after it, so a text's tokens are
those of its chunks, each a run of white space with the word that follows. Chunks repeat; the
count of each is kept, and the tokenizer only sees new ones. Counts equal those of the whole text.
"""

from __future__ import annotations

import base64
import os
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this family of tokenizers cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


@dataclass
class Counter:
    """Counts tokens of texts with the vocabulary at `path` (lines of base64 token and rank)."""

    path: str = DEFAULT_VOCABULARY
    limit: int = 1_000_000
    known: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        import tiktoken

        with open(_found(self.path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("corpusmill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _new(self, chunk: str) -> int:
        n = len(self._bpe.encode_ordinary(chunk))
        if len(self.known) < self.limit:
            self.known[chunk] = n
        return n

    def chunks(self, text: str) -> tuple[list[str], np.ndarray]:
        """Chunks of a text and the tokens of each."""
        parts = CHUNK.findall(text)
        get, new = self.known.get, self._new
        return parts, np.fromiter((n if (n := get(c)) is not None else new(c) for c in parts), np.int64, len(parts))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        get, new = self.known.get, self._new
        return sum([n if (n := get(c)) is not None else new(c) for c in CHUNK.findall(text)])


def ship(spark: SparkSession, path: str) -> None:
    """Send the vocabulary to the workers, which need not have the file where the driver has it."""
    if os.path.exists(path) and (spark.sparkContext.applicationId, path) not in _sent:
        _sent.add((spark.sparkContext.applicationId, path))
        spark.sparkContext.addFile(path)


def _found(path: str) -> str:
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


_sent: set[tuple[str, str]] = set()
_counters: dict[str, Counter] = {}


def counter(path: str = DEFAULT_VOCABULARY) -> Counter:
    """The worker's counter for a vocabulary; loaded once."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]

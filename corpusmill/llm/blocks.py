"""Numpy work on Arrow text columns: lines, tokens and hashes without per-row Python.

Every function takes the UTF-8 bytes of many texts at once. Texts are handled whole; the
chunking only bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, (1 << 20) + 2)
        with np.errstate(over="ignore"):
            p = np.full(size, _BASE, np.uint64)
            p[0] = 1
            q = np.full(size, _BASE_INV, np.uint64)
            q[0] = 1
            _pow, _inv = np.cumprod(p), np.cumprod(q)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes give equal hashes anywhere. Spans come in order of their starts.

    Works through the buffer in blocks, so memory does not grow with it unless one span does.
    """
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + block, side="right")))
        hi = int(ends[j - 1])
        power, inverse = _powers(hi - lo + 1)
        with np.errstate(over="ignore"):
            prefix = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=prefix[1:])
            out[i:j] = mix((prefix[ends[i:j] - lo] - prefix[starts[i:j] - lo]) * inverse[starts[i:j] - lo])
        i = j
    return out


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text stands alone."""
    n = len(texts)
    if not n:
        return
    size = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    at, total = 0, 0
    for i in range(n):
        if i > at and total + size[i] > limit:
            yield at, i
            at, total = i, 0
        total += int(size[i])
    yield at, n


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, each followed by a newline, and the start of each (with an end)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8), starts


_FLAGS = np.zeros(256, np.uint8)
WS, LETTER, DIGIT, UPPER, PUNCT, HIGH = 1, 2, 4, 8, 16, 32
for _b in b" \t\r\n":
    _FLAGS[_b] |= WS
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _FLAGS[_b] |= LETTER | (UPPER if chr(_b).isupper() else 0)
    elif 48 <= _b <= 57:
        _FLAGS[_b] |= DIGIT
    elif 33 <= _b <= 126:
        _FLAGS[_b] |= PUNCT
    elif _b >= 128:
        _FLAGS[_b] |= HIGH
FLAGS = _FLAGS
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, byte for byte."""
    low = LOWER[buf]
    if len(buf) > 1:
        up = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[1:][up] += 0x20
    return low


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    edge = np.concatenate([[0] if mask[0] else [], edge, [len(mask)] if mask[-1] else []]).astype(np.int64)
    return edge[::2], edge[1::2]


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes other than space, tab, CR and LF."""
    return runs((FLAGS[buf] & WS) == 0)


@dataclass
class Lines:
    """Lines of many texts. start/end: bytes without the break; no: 1-based number in the text."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    no: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def total(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a per-byte quantity over each line."""
        c = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=c[1:])
        return c[self.end] - c[self.start]


def lines_of(buf: np.ndarray, starts: np.ndarray) -> Lines:
    """Split joined texts (see `joined`) at newlines."""
    breaks = np.flatnonzero(buf == 10)
    begin = np.zeros(len(breaks), np.int64)
    begin[1:] = breaks[:-1] + 1
    doc = np.searchsorted(starts, begin, side="right") - 1
    first = np.searchsorted(doc, doc, side="left")
    end = breaks.astype(np.int64)
    cr = (end > begin) & (buf[np.maximum(end - 1, 0)] == 13)
    return Lines(buf, begin, end - cr, doc, np.arange(len(begin)) - first + 1)

"""Problem 10: oversized documents into overlapping pieces at natural boundaries.

The least number of pieces follows from the size, the limit and the overlap. Equal targets are placed
and each is moved to the strongest boundary near it: a heading, a blank line, a line end, a sentence
end, a clause end, a word. A piece that breaks the limit makes the count grow by one and all targets be placed anew. The
next piece begins at the last word limit that leaves at least the overlap. Words longer than the room are cut into parts. Pieces are
substrings of the text; without the overlaps they give the text again.

Nulls: rows with a null text, and texts that are not oversized, give no pieces. Repeated rows are pieces of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm import tokens

KINDS = ("end", "part", "word", "clause", "sentence", "line", "paragraph", "heading")
_HEADING = re.compile(r"\s*\n\s*(?:#{1,6}|\d+(?:\.\d+)*[.)]?|[IVXLC]+\.)$")
_SENTENCE = re.compile(r"[.!?।॥…][\"')\]»”]*$")
_CLAUSE = re.compile(r"[,;:–—][\"')\]»”]*$")


@dataclass(frozen=True)
class Settings:
    """limit, overlap: in tokens. above: documents of more tokens are cut. reach: how far a target may move, as a share of the limit."""

    limit: int = 512
    overlap: int = 64
    above: int = 8192
    reach: float = 0.2
    vocabulary: str = tokens.DEFAULT_VOCABULARY


def _units(text: str, c: tokens.Counter, room: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Chunks with their tokens and the strength (index into KINDS) of the boundary before each."""
    parts, size = c.chunks(text)
    if len(size) and size.max() > room:
        out, n = [], []
        for p, k in zip(parts, size.tolist()):
            if k <= room:
                out.append(p)
                n.append(k)
                continue
            step = max(1, room // 4)
            for i in range(0, len(p), step):  # a character has at most four bytes, so a part has at most `room` tokens
                out.append(p[i : i + step])
                n.append(-c.count(p[i : i + step]) if i else c.count(p[i : i + step]))
        parts, size = out, np.array(n, np.int64)
    before = np.full(len(parts), KINDS.index("word"))
    before[size < 0] = KINDS.index("part")
    for i in range(1, len(parts)):
        if size[i] < 0:
            continue
        chunk, last = parts[i], parts[i - 1]
        lead = chunk[: len(chunk) - len(chunk.lstrip())]
        breaks = lead.count("\n")
        if breaks:
            before[i] = KINDS.index("heading") if _HEADING.match(chunk) else KINDS.index("paragraph") if breaks > 1 else KINDS.index("line")
        elif _SENTENCE.search(last):
            before[i] = KINDS.index("sentence")
        elif _CLAUSE.search(last):
            before[i] = KINDS.index("clause")
    return parts, np.abs(size), before


def cuts(size: np.ndarray, before: np.ndarray, limit: int, overlap: int, reach: float) -> list[tuple[int, int]]:
    """Unit ranges [a, b) of the pieces."""
    ends = np.concatenate([[0], np.cumsum(size)])
    total, n = int(ends[-1]), len(size)
    if total <= limit:
        return [(0, n)]
    pieces = max(2, -(-(total - overlap) // max(1, limit - overlap)))
    while True:
        out, a, ok = [], 0, True
        for k in range(1, pieces):
            goal = overlap + k * (total - overlap) / pieces
            top = int(np.searchsorted(ends, ends[a] + limit, side="right")) - 1
            back = int(np.searchsorted(ends, ends[out[-1][1]], side="left")) if out else 0
            low = max(back + 1, int(np.searchsorted(ends, goal - reach * limit, side="left")))
            high = min(top, n - 1, int(np.searchsorted(ends, goal + reach * limit, side="right")) - 1)
            if high < low:
                low = high = min(top, n - 1)
            if high <= back:
                ok = False
                break
            at = np.arange(low, high + 1)
            b = int(at[np.lexsort((np.abs(ends[at] - goal), -before[at]))[0]])
            out.append((a, b))
            a = max(int(np.searchsorted(ends, ends[b] - overlap, side="right")) - 1, a + 1)
        if ok and ends[n] - ends[a] <= limit:
            return [*out, (a, n)]
        pieces += 1
        if pieces > 4 * n + 4:
            raise ValueError("the overlap leaves no room for a unit")


def split_text(text: str, c: tokens.Counter, s: Settings) -> list[tuple[int, int, int, int, str]]:
    """(first character, end, tokens, tokens shared with the piece before, boundary at its end) of each piece."""
    if s.overlap * 2 > s.limit or s.limit < 8:
        raise ValueError("the overlap must be at most half of the limit, and the limit at least 8")
    parts, size, before = _units(text, c, max(1, min(s.limit - s.overlap - 1, s.limit // 4)))
    chars = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    ends = np.concatenate([[0], np.cumsum(size)])
    out, last = [], 0
    for a, b in cuts(size, before, s.limit, s.overlap, s.reach):
        out.append((int(chars[a]), int(chars[b]), int(ends[b] - ends[a]), int(ends[last] - ends[a]) if out else 0, KINDS[before[b]] if b < len(before) else KINDS[0]))
        last = b
    return out


def _split(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = tokens.counter(s.vocabulary)
        names = ["doc_id", "piece_no", "pieces", "first_char", "end_char", "tokens", "shared", "boundary", "text"]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if c.count(text) <= s.above:
                    continue
                got = split_text(text, c, s)
                cols = list(zip(*got))
                n = len(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * n, pa.int64()), pa.array(range(1, n + 1), pa.int64()), pa.array([n] * n, pa.int64()), *(pa.array(x, pa.int64()) for x in cols[:4]), pa.array(cols[4]), pa.array([text[a:b] for a, b in zip(cols[0], cols[1])])], names
                )

    return run


def split_oversized(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, piece_no, pieces, first_char, end_char, tokens, shared, boundary, text of the pieces of oversized documents."""
    long = docs.where(F.octet_length("text") > s.above)  # a token has at least one byte
    schema = "doc_id bigint, piece_no bigint, pieces bigint, first_char bigint, end_char bigint, tokens bigint, shared bigint, boundary string, text string"
    tokens.ship(docs.sparkSession, s.vocabulary)
    return long.select("doc_id", "text").mapInArrow(_split(s), schema)

"""Lines of pages as numbers: shapes, words and neighbours, for the models of problems 2 to 4."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from corpusmill.llm import blocks as B

SPACE_BITS = 18
_SEPARATORS = np.zeros(256, bool)
for _c in b"|>/\t":
    _SEPARATORS[_c] = True


def word_hashes(words: list[str]) -> np.ndarray:
    """Sorted token hashes of given words, as `Page.of` computes them for texts."""
    buf, starts = B.joined([w.lower().encode() for w in words])
    return np.unique(B.span_hashes(B.lowered(buf), starts[:-1], starts[1:] - 1))


def _in(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(h), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)] == h


@dataclass
class Page:
    """Non-blank lines of a chunk of texts, and their tokens (runs of letters).

    tok_line indexes the non-blank lines. All arrays are per non-blank line unless named tok_ or doc_.
    """

    raw: np.ndarray
    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    no: np.ndarray
    chars: np.ndarray
    n_docs: int
    tok_start: np.ndarray
    tok_end: np.ndarray
    tok_hash: np.ndarray
    tok_line: np.ndarray
    tok_common: np.ndarray
    n_tok: np.ndarray
    n_words: np.ndarray
    common: np.ndarray
    sentence: np.ndarray
    gap: np.ndarray
    shape: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def of(texts: list[bytes], common_words: np.ndarray) -> "Page":
        buf, starts = B.joined(texts)
        ln = B.lines_of(buf, starts)
        flags = B.FLAGS[buf]
        black = (flags & B.WS) == 0
        chars = ln.total(black)
        keep = np.flatnonzero(chars > 0)
        start, end, doc, no = ln.start[keep], ln.end[keep], ln.doc[keep], ln.no[keep]
        low = B.lowered(buf)
        # a line's visible extent
        seen = np.flatnonzero(black)
        start = seen[np.searchsorted(seen, start)] if len(keep) else start
        end = seen[np.searchsorted(seen, end) - 1] + 1 if len(keep) else end
        ts, te = B.runs((flags & (B.LETTER | B.HIGH)) != 0)
        th = B.span_hashes(low, ts, te)
        tl = np.searchsorted(start, ts, side="right") - 1
        tc = _in(th, common_words)
        n = len(keep)
        n_tok = np.bincount(tl, minlength=n) if len(tl) else np.zeros(n, np.int64)
        common = np.bincount(tl[tc], minlength=n) if len(tl) else np.zeros(n, np.int64)
        ws, _ = B.words(buf)
        n_words = np.bincount(np.searchsorted(start, ws, side="right") - 1, minlength=n) if len(ws) else np.zeros(n, np.int64)
        sentence = (n_tok >= 5) & (common >= 2) & (common >= 0.15 * n_tok)
        gap = np.ones(n, np.int64)
        if n:
            gap[1:] = np.where(doc[1:] == doc[:-1], no[1:] - no[:-1] - 1, 99)
            gap[0] = 99
        page = Page(buf, low, start, end, doc, no, chars[keep], len(texts), ts, te, th, tl, tc, n_tok, n_words, common, sentence, gap)
        page._shapes(ln, flags, keep)
        if n:  # scattered letters are no words
            letters = page.shape["letters"]
            page.sentence &= (letters >= 0.5 * page.chars) & (letters >= 2.6 * page.n_tok)
        return page

    def __len__(self) -> int:
        return len(self.start)

    def _shapes(self, ln: B.Lines, flags: np.ndarray, keep: np.ndarray) -> None:
        n, raw = len(self), self.raw
        s = self.shape
        if not n:
            return
        at = lambda i: raw[np.clip(i, 0, len(raw) - 1)]
        c0, c1 = at(self.start), at(self.start + 1)
        e0, e1, e2 = at(self.end - 1), at(self.end - 2), at(self.end - 3)
        s["digits"] = ln.total((flags & B.DIGIT) != 0)[keep]
        s["upper"] = ln.total((flags & B.UPPER) != 0)[keep]
        s["letters"] = ln.total((flags & (B.LETTER | B.HIGH)) != 0)[keep]
        sep = _SEPARATORS[raw]
        if len(raw) > 1:  # the middle dot and the guillemet of menus, and pairs of colons
            sep[1:] |= (raw[:-1] == 0xC2) & ((raw[1:] == 0xB7) | (raw[1:] == 0xBB))
            sep[1:] |= (raw[:-1] == 58) & (raw[1:] == 58)
        s["separators"] = ln.total(sep)[keep]
        s["punct"] = ln.total((flags & B.PUNCT) != 0)[keep]
        dot3 = (e0 == 46) & (e1 == 46)
        danda = (e0 == 0xA4) & (e1 == 0xA5) & (e2 == 0xE0)
        s["stop"] = (((e0 == 46) & ~dot3) | (e0 == 63) | (e0 == 33) | danda).astype(np.int64)
        s["dots"] = dot3.astype(np.int64)
        s["bullet"] = np.select([(c0 == 45) & (c1 == 32), (c0 == 62) & (c1 == 32), (c0 == 0xE2) & (c1 == 0x80), c0 == 35, (c0 == 91) | (c0 == 40), (c0 == 42) & (c1 == 32)], [1, 2, 3, 4, 5, 6], 0)
        s["counted"] = ((e0 == 41) & ((flags[np.clip(self.end - 2, 0, None)] & B.DIGIT) != 0)).astype(np.int64)
        body = self.start + np.where(s["bullet"] > 0, 2, 0)
        d = [(flags[np.clip(body + k, 0, len(raw) - 1)] & B.DIGIT) != 0 for k in range(3)]
        s["dated"] = (d[0] & d[1] & ((d[2] & np.isin(at(body + 4), (45, 47, 46))) | np.isin(at(body + 2), (45, 47, 46)))).astype(np.int64)
        s["numbered"] = (d[0] & ~(s["dated"] > 0)).astype(np.int64)
        s["answer"] = (((c0 == 81) | (c0 == 65)) & (c1 == 58)).astype(np.int64)
        s["colon"] = ((e0 == 58)).astype(np.int64)

    def line_keys(self) -> np.ndarray:
        """Hash of the token sequence of each line: equal for lines that differ in digits, case, punctuation or spacing."""
        return sequence_keys(self.tok_hash, self.tok_line, len(self), self.n_tok)

    def per_doc(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=x, minlength=self.n_docs)


def sequence_keys(tok_hash: np.ndarray, tok_line: np.ndarray, n: int, n_tok: np.ndarray) -> np.ndarray:
    key = np.zeros(n, np.uint64)
    if len(tok_hash):
        first = np.cumsum(n_tok) - n_tok
        rank = (np.arange(len(tok_hash)) - first[tok_line]).astype(np.uint64)
        with np.errstate(over="ignore"):
            h = B.mix(tok_hash + B.mix(rank + np.uint64(1)))
            has = n_tok > 0
            key[has] = np.add.reduceat(h, first[has])
    return key


def title_keys(titles: list[bytes]) -> np.ndarray:
    """line_keys of whole titles and hashes of their last words, one per text; 0 for an empty one."""
    buf, starts = B.joined(titles)
    flags = B.FLAGS[buf]
    ts, te = B.runs((flags & (B.LETTER | B.HIGH)) != 0)
    doc = np.searchsorted(starts, ts, side="right") - 1
    n_tok = np.bincount(doc, minlength=len(titles)) if len(ts) else np.zeros(len(titles), np.int64)
    hashes, tail = B.span_hashes(B.lowered(buf), ts, te), np.zeros(len(titles), np.uint64)
    tail[doc] = hashes
    return np.stack([sequence_keys(hashes, doc, len(titles), n_tok), tail])


def _bucket(x: np.ndarray, edges: tuple[int, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


def features(p: Page, titles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line index and feature address (below 2**SPACE_BITS) of every feature of every line."""
    n = len(p)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, key = [], []
    every = np.arange(n)

    def add(lines: np.ndarray, hashes: np.ndarray, salt: int) -> None:
        at.append(lines.astype(np.int32))
        with np.errstate(over="ignore"):
            key.append((B.mix(hashes.astype(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SPACE_BITS)).astype(np.int32))

    s = p.shape
    first = np.searchsorted(p.doc, p.doc, side="left")
    last = np.searchsorted(p.doc, p.doc, side="right") - 1
    top, bottom, count = every - first, last - every, last - first + 1
    pv, nx = np.maximum(every - 1, 0), np.minimum(every + 1, n - 1)
    has_p, has_n = every > first, every < last
    # words and word pairs of the line; long lines share their weight through pairs only within the line
    add(p.tok_line, p.tok_hash, 1)
    if len(p.tok_hash) > 1:
        pair = p.tok_line[1:] == p.tok_line[:-1]
        with np.errstate(over="ignore"):
            add(p.tok_line[1:][pair], (p.tok_hash[:-1] * np.uint64(3) + p.tok_hash[1:])[pair], 2)
    lk = p.line_keys()
    tail = np.zeros(n, np.uint64)
    tail[p.tok_line] = p.tok_hash
    add(every, lk, 3)
    add(every[has_p], lk[pv][has_p], 4)
    words = _bucket(p.n_words, (1, 2, 3, 4, 6, 9, 15, 25))
    open_ended = (p.n_words >= 8) & (s["stop"] == 0) & p.sentence
    ratio = _bucket((10 * p.common / np.maximum(p.n_tok, 1)).astype(np.int64), (1, 2, 3, 4))
    small = [
        words, s["stop"] * 2 + s["dots"], s["bullet"] * 2 + s["counted"], s["dated"] * 4 + s["counted"] * 2 + s["numbered"],
        _bucket(s["separators"], (1, 2, 3)) * 9 + words, ratio * 9 + words, _bucket((10 * s["upper"] / np.maximum(s["letters"], 1)).astype(np.int64), (1, 3, 8)),
        np.minimum(top, 6), np.minimum(bottom, 6), _bucket(count, (2, 3, 4, 7, 16)), s["answer"], s["colon"] * 9 + words,
        p.sentence * 1, _bucket((10 * s["digits"] / np.maximum(p.chars, 1)).astype(np.int64), (1, 3, 6)),
        has_p * (1 + 2 * p.sentence[pv] + open_ended[pv] * 4 + (p.gap > 0) * 8), has_n * (1 + 2 * p.sentence[nx] + 4 * (p.gap[nx] > 0)),
        has_p * (1 + s["bullet"][pv] * 2 + s["counted"][pv] + s["dated"][pv] * 16) + 64 * s["bullet"],
        has_n * (1 + s["bullet"][nx] * 2 + s["counted"][nx] + s["dated"][nx] * 16) + 64 * s["bullet"],
        has_p * (1 + words[pv]) + 16 * words, has_n * (1 + words[nx]) + 16 * words,
        (titles[0][p.doc] == lk) & (lk != 0), (titles[1][p.doc] == tail) & (tail != 0) & (s["separators"] > 0),
        _bucket((10 * p.per_doc(p.sentence * p.chars) / np.maximum(p.per_doc(p.chars), 1)).astype(np.int64), (1, 3, 6, 9))[p.doc] * 9 + words,
    ]
    for i, v in enumerate(small):
        add(every, np.asarray(v, np.int64), 16 + i)
    return np.concatenate(at), np.concatenate(key)


def logits(weights: np.ndarray, p: Page, titles: np.ndarray) -> np.ndarray:
    at, key = features(p, titles)
    return np.bincount(at, weights=weights[key], minlength=len(p)) if len(p) else np.zeros(0)


def fit_logistic(at: np.ndarray, key: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, rate: float = 0.3, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression over hashed features by full-batch Adagrad; rows of weight 0 do not count."""
    w = np.zeros(1 << SPACE_BITS)
    if not (weight > 0).all():
        use = weight[at] > 0
        at, key = at[use], key[use]
    total = weight.sum()
    second = np.full(len(w), 1e-8)
    n = len(y)
    for _ in range(rounds):
        z = np.bincount(at, weights=w[key], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / total
        grad = np.bincount(key, weights=g[at], minlength=len(w)) + decay * w
        second += grad * grad
        w -= rate * grad / np.sqrt(second)
    return w.astype(np.float32)

"""Fetching under a retry policy, and text of PDF files; both take the caller's transport or libraries."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    """Fixed values of the reference: tries, and the base of the growing waits."""

    tries: int = 3
    base: float = 2.0


@dataclass(frozen=True)
class Fetched:
    """kind: `html`, `pdf` (to be read as such), `missing` or `failed`; waits: seconds waited between tries."""

    kind: str
    body: bytes | None
    waits: tuple[float, ...]


def fetch(url: str, get: Callable[[str], tuple[int, str, bytes]], policy: Policy = Policy(), sleep: Callable[[float], None] = time.sleep) -> Fetched:
    """One page through `get(url) -> (status, content type, body)`, which raises TimeoutError or ConnectionError.

    404 and other refusals end at once; a rate limit (429) waits base ** (try + 2) seconds, a server error, a time-out or a lost connection base ** try.
    """
    waits: list[float] = []
    for k in range(policy.tries):
        try:
            status, kind, body = get(url)
        except (TimeoutError, ConnectionError):
            status = 599
        if status == 200:
            return Fetched("pdf" if "pdf" in kind.lower() else "html", body, tuple(waits))
        if status != 429 and status < 500:
            return Fetched("missing", None, tuple(waits))
        waits.append(policy.base ** (k + 2 if status == 429 else k))
        sleep(waits[-1])
    return Fetched("failed", None, tuple(waits))


_STREAM = re.compile(rb"<<(?P<head>.*?)>>\s*stream\r?\n(?P<data>.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\[(?P<list>(?:\((?:\\.|[^\\)])*\)|[^\]()])*)\]\s*TJ|(?P<one>\((?:\\.|[^\\)])*\))\s*(?:Tj|'|\")|(?P<move>T\*|\bT[dD]\b|\bET\b)", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\)])*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\n", b"t": b"\t", b"b": b"", b"f": b""}


def _plain(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        x = m.group(1)
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S).decode("latin-1")


def simple_pdf_text(data: bytes) -> tuple[str, int]:
    """(text, pages) of PDF files that show their text as plain strings in deflated or plain streams; text in other encodings is not read."""
    pages = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data))
    blocks = []
    for m in _STREAM.finditer(data):
        body = m["data"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        lines = [""]
        for t in _SHOWN.finditer(body):
            if t["move"] is not None:
                lines.append("")
            else:
                lines[-1] += "".join(_plain(x) for x in _STRING.findall(t["list"] if t["list"] is not None else t["one"]))
        text = "\n".join(x for x in map(str.strip, lines) if x)
        if text:
            blocks.append(text)
    return "\n\n".join(blocks), pages


def pdf_text(data: bytes, extractors: tuple[Callable[[bytes], tuple[str, int]], ...] = (simple_pdf_text,)) -> tuple[str, int]:
    """(text, pages) of the first extractor that gives text; one that fails is passed over. Pages are joined by an empty line."""
    pages = 0
    for extract in extractors:
        try:
            text, n = extract(data)
        except Exception:  # noqa: BLE001 - a library's own errors
            continue
        pages = pages or n
        if text and text.strip():
            return text.strip(), n or pages
    return "", pages

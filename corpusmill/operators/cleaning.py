"""The cleaner of scraped content: sections, lines, paragraphs.

Sections and paragraphs need an ordered pass with memory of what was seen; it runs as Arrow batches, in linear time. The rest is column functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from corpusmill.functions import rules as R, text as T

C, lit = F.col, F.lit
HEADING = r"^(#{1,6})\s+(.+)$"
BULLET = r"^\s*(?:[-*+•]|o)\s+"
NUMBER = r"^\s*\d+\s*[|.)-]\s*"


_HEADING, _BULLET, _NUMBER = (re.compile(x, re.A) for x in (HEADING, BULLET, NUMBER))
_TOKEN = re.compile(R.TOKEN_PATTERN)
_FURNITURE = re.compile(T.alternation(R.LINE_DROP_PATTERNS), re.A)
_DROPPED = re.compile("(?:(?:" + "|".join(R.SECTION_DROP_HEADINGS) + ")$|" + "|".join(R.SECTION_DROP_PREFIXES) + ")")
_GENERIC = re.compile("(?:(?:" + "|".join(R.GENERIC_HEADINGS) + ")$|" + "|".join(R.GENERIC_HEADING_PREFIXES) + ")")
_PHRASES = re.compile("|".join(R.PARAGRAPH_DROP_PHRASES))
_TABLE = re.compile("table |see table |title of the talk|about the speaker")
_EMAIL, _LINK = re.compile(T.EMAIL), re.compile(r"http\S+|www\.\S+", re.A)
_SPECIAL, _SPACES, _BULLETS, _GAPS = re.compile("[\u00a0\u200b]"), re.compile(r"[ \t\f]{2,}|[\t\f]"), re.compile("[•●▪◆■◦]+"), re.compile(r"\n{3,}")


def _heading(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s-]+", " ", text.lower(), flags=re.A), flags=re.A).strip(" -")


def scan(text: str) -> list[str]:
    """Lines that remain after section skipping; an ordered pass over the lines of one document.

    State: the level of the heading whose section is skipped (0: none), whether a plain section is skipped, and the lines kept.
    A dropped heading inside a skipped section sets the level anew.
    """
    level, plain, kept = 0, False, []
    for line in text.split("\n"):
        line = line.strip(" \t\r")
        if not line:
            plain = False
            if kept and kept[-1]:
                kept.append("")
            continue
        m = _HEADING.search(line) if line[0] == "#" else None
        mark, body = (len(m[1]), m[2].strip(" ")) if m else (0, line)
        norm = _heading(body) if mark or len(line) <= 400 else ""  # a heading without signs has at most ten tokens
        short = mark > 0 or (norm != "" and len(_TOKEN.findall(norm)) <= 10)
        headed = bool(_DROPPED.match(norm))
        drop, generic = headed and short, short and bool(_GENERIC.match(norm))
        if mark and 0 < mark <= level:
            level = 0
        if mark and drop:
            level = mark
        if mark and not drop and not generic:
            plain = False
        elif not mark and drop:
            plain = True
        if drop or generic or level or plain or headed or line in ("-", "*", "o") or _FURNITURE.search(line):
            continue
        kept.append(body if mark else _NUMBER.sub("", _BULLET.sub("", line)))
    return kept


def _squeezed(text: str) -> str:
    """`text.normalize_whitespace` without the ASCII rule, on one string."""
    t = _SPECIAL.sub(" ", text).replace("\r\n", "\n").replace("\r", "\n")
    t = _SPACES.sub(" ", _EMAIL.sub(" ", _LINK.sub(" ", t)))
    return _GAPS.sub("\n\n", _BULLETS.sub("\n", t)).strip(" \n\t")


def distinct_paragraphs(text: str, least: int = 10) -> list[str]:
    """Paragraphs that pass the rule, without later repeats of long ones."""
    seen, kept = set(), []
    for p in re.split(r"\n[ \t]*\n", text):
        p = _squeezed(p)
        low = _heading(p)
        toks = _TOKEN.findall(low)
        if not low or not toks or _PHRASES.search(low) or _TABLE.match(low) or (len(toks) <= 40 and sum(t in R.PROMOTIONAL_HINTS for t in toks) >= 3):
            continue
        key = re.sub("[^a-z0-9]+", " ", p.lower()).strip(" ")
        if len(_TOKEN.findall(key)) >= least:
            if key in seen:
                continue
            seen.add(key)
        kept.append(p)
    return kept


@F.pandas_udf(StringType())
def _paragraphs_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: "\n\n".join(distinct_paragraphs("\n".join(scan(t or "")))))


def clean_scraped(text: Column, passes: int = 1, ascii_only: bool = True) -> Column:
    """Cleaned text; paragraphs parted by an empty line. An empty string for null.

    One pass by default. A numbered heading loses its number only after the heading test, so a second pass may drop more.
    """
    t = F.coalesce(text, lit(""))
    for _ in range(passes):
        t = T.normalize_whitespace(T.remove_blocks(T.normalize_whitespace(t, ascii_only)), ascii_only)
        t = _paragraphs_of(t)
    return t


def clean_corpus(text: Column, ascii_only: bool = True) -> Column:
    """Corpus text: the scraper's cleaning, then entities, links, phrases, hyphens, addresses, markup, line rule, paragraph merge."""
    t = T.unescape(clean_scraped(text, ascii_only=ascii_only))
    t = F.regexp_replace(t, r"\[([^\]]+)\]\(([^)]*)\)", " $1 ")
    t = T.domain_phrases(t)
    t = F.regexp_replace(t, r"(?<=\w)-\n(?=\w)", "")
    t = F.regexp_replace(t, r"http\S+|www\.\S+|" + T.EMAIL, " ")
    t = F.regexp_replace(t, r"(?i)\b[a-f0-9]{8,}(?:-[a-f0-9]{4,})+\b", " ")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\[[^\]]*\]", " "), "[*`~><]+", " "), r"\|+", "\n")
    lines = F.transform(F.split(t, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "), lit(" -:\t")))
    # dropped lines part paragraphs, as empty ones do
    text = F.array_join(T.kept_corpus_lines(lines), "\n")
    merged = F.transform(F.filter(F.split(text, r"\n{2,}"), lambda p: F.btrim(p, lit("\n ")) != ""), lambda p: F.regexp_replace(F.btrim(p, lit("\n ")), r"\s*\n\s*", " "))
    spaced = F.transform(merged, lambda p: F.btrim(F.regexp_replace(F.regexp_replace(p, r"\s*([.!?;:])\s*", "$1 "), r"[ \t]+", " ")))
    return F.array_join(F.filter(spaced, lambda p: p != ""), "\n\n")


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line."""
    return df.where(C(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(key, (C("p") + 1).cast("long").alias("line_no"), F.regexp_replace("line", r"\r$", "").alias("line"))

"""HTML pages: title, description, links, main text, and the choice between two extractions."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T_

from corpusmill.functions import text as T
from corpusmill.operators import cleaning

C, lit = F.col, F.lit
SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe", "svg", "button"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
FURNITURE = re.compile(r"\b(?:nav|menu|sidebar|footer|header|breadcrumb|cookie|share|social|advert|banner|pagination)\b", re.I)
MAIN = re.compile(r"^(?:content|main-content|main)$", re.I)


class _Reader(HTMLParser):
    """One pass: title, description, links, block texts inside and outside a main container."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.description, self.links = "", "", []
        self.blocks: list[tuple[bool, str]] = []
        self.stack: list[tuple[str, bool, bool]] = []
        self.block: str | None = None
        self.parts: list[str] = []

    def _flags(self) -> tuple[bool, bool]:
        return (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, False)

    def _close_block(self) -> None:
        if self.block:
            text = re.sub(r"\s+", " ", " ".join(self.parts)).strip()
            if text:
                lead = "#" * int(self.block[1]) + " " if self.block[0] == "h" else "- " if self.block == "li" else ""
                self.blocks.append((self._flags()[1], lead + text))
        self.block, self.parts = None, []

    def handle_starttag(self, tag, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag == "meta" and a.get("name", "").lower() == "description":
            self.description = a.get("content", "").strip()
        if tag in VOID:
            return
        skip, main = self._flags()
        names = f"{a.get('class', '')} {a.get('id', '')}"
        skip = skip or tag in SKIPPED or (tag not in ("html", "body") and bool(FURNITURE.search(names)))
        main = main or tag in ("main", "article") or any(MAIN.match(x) for x in names.split())
        if tag in BLOCKS and not skip:
            self._close_block()
            self.block = tag
        self.stack.append((tag, skip, main))

    def handle_endtag(self, tag) -> None:
        if tag == self.block:
            self._close_block()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data) -> None:
        if self.stack and self.stack[-1][0] == "title":
            self.title += data
        elif self.block and not self._flags()[0]:
            self.parts.append(data)

    def text(self, main_only: bool) -> str:
        self._close_block()
        chosen = [t for m, t in self.blocks if m] if main_only and any(m for m, _ in self.blocks) else [t for _, t in self.blocks]
        return "\n\n".join(chosen)


def read_page(html: str | None, url: str | None) -> tuple[str, str, str, str, list[str]]:
    """title, description, main text, text of all blocks, resolved links without fragments."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    links = []
    for href in r.links:
        if href.startswith(("mailto:", "javascript:", "tel:", "#")):
            continue
        try:
            links.append(urldefrag(urljoin(url or "", href.strip().replace(" ", "%20")))[0])
        except ValueError:
            continue
    return r.title.strip(), r.description, r.text(True), r.text(False), list(dict.fromkeys(links))


PAGE = T_.StructType([*[T_.StructField(n, T_.StringType()) for n in ("title", "description", "main", "full")], T_.StructField("links", T_.ArrayType(T_.StringType()))])


@F.pandas_udf(PAGE)
def _read(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h, u) for h, u in zip(html, url)], columns=["title", "description", "main", "full", "links"])


def candidate_score(text: Column) -> Column:
    """tokens + 100 * distinct share - 35 * furniture words - 1.5 * lines of at most two words; null without tokens."""
    words = F.regexp_extract_all(F.lower(text), lit("[a-z]+"), lit(0))
    noise = F.size(F.regexp_extract_all(F.lower(text), lit(r"\b(?:home|sitemap|menu|login|read more|click here)\b"), lit(0)))
    short = F.size(F.filter(F.split(text, "\n"), lambda x: F.size(F.regexp_extract_all(F.lower(x), lit("[a-z]+"), lit(0))).between(1, 2)))
    return F.when(F.size(words) > 0, F.size(words) + T.distinct_ratio(words) * 100 - noise * 35 - short * 1.5)


def extract(df: DataFrame, key: str, html: str, url: str, least: int = 50) -> DataFrame:
    """key, title, description, content, links: the better of main-container and whole-page text after cleaning.

    A candidate needs more than `least` characters; without one the content is empty. Null pages give empty results.
    """
    page = df.select(key, _read(C(html), C(url)).alias("p")).select(key, "p.*")
    cand = lambda c: F.when(F.length(F.btrim(c)) > least, cleaning.clean_scraped(T.remove_boilerplate(c)))
    both = page.withColumn("a", cand(C("main"))).withColumn("b", cand(C("full")))
    better = F.coalesce(candidate_score(C("b")), lit(float("-inf"))) > F.coalesce(candidate_score(C("a")), lit(float("-inf")))
    return both.select(key, "title", "description", F.coalesce(F.when(better, C("b")).otherwise(C("a")), lit("")).alias("content"), "links")


def links(df: DataFrame, html: str, url: str) -> DataFrame:
    """src, dst of every distinct link of each page."""
    page = df.select(C(url).alias("src"), _read(C(html), C(url)).alias("p"))
    return page.select("src", F.explode("p.links").alias("dst")).distinct()

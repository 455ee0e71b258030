"""Crawling over a snapshot of pages: breadth-first levels, dispatch, page processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill.functions import rules as R, url as U
from corpusmill.operators import dedup, filters, html as H
from corpusmill.session import materialize

C, lit = F.col, F.lit


def breadth_first(seeds: DataFrame, links: DataFrame, limit: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """url, depth of the pages reached from `seeds` (url) over `links` (src, dst), however deep they are.

    One round per level: the frontier joins the links, known pages are taken off, and the level is written to the
    checkpoint folder, so a lost executor costs one level. `seen` (url) continues an earlier crawl: its pages count as known,
    and given seeds among them are expanded again. `limit` bounds the pages put out, nearest first, the smaller URL before the greater; the crawl stops
    with the level that reaches it.
    """
    frontier = materialize(seeds.select("url").where("url is not null").distinct().withColumn("depth", lit(0)))
    done = frontier
    known = frontier.select("url") if seen is None else frontier.select("url").union(seen.select("url")).distinct()
    depth, met = 0, frontier.count()
    while met and (limit is None or met < limit):
        depth += 1
        nxt = links.join(frontier.select(C("url").alias("src")), "src").select(C("dst").alias("url")).where("url is not null").distinct()
        frontier = materialize(nxt.join(known, "url", "left_anti").withColumn("depth", lit(depth)))
        found = frontier.count()
        if not found:
            break
        met += found
        done, known = materialize(done.unionByName(frontier)), materialize(known.union(frontier.select("url")))
    return done.orderBy("depth", "url").limit(limit) if limit is not None else done


def process_pages(pages: DataFrame, url: str, html: str) -> tuple[DataFrame, DataFrame]:
    """(documents, links) of fetched pages, in the crawler's order: extract, classify, filter, then links of every page whatever became of it,
    then one record per content, then types without a rule are passed over.

    documents: url, title, description, doc_type, department, content, content_key. links: src, dst.
    """
    read = materialize(H.extract(pages, url, html, url))  # read and cleaned once
    typed = read.withColumn("doc_type", U.doc_type(C(url)))
    judged = materialize(typed.where(filters.scraped_reason(C("doc_type"), C("title"), C(url), C("content")) == "kept"))
    once = dedup.exact_duplicates(judged, "content", [url]).where("kept and doc_type <> '" + R.DOC_TYPE_DEFAULT + "'")
    documents = once.select(C(url).alias("url"), "title", "description", "doc_type", U.department(C(url)).alias("department"), "content", "content_key")
    return documents, H.links(pages, html, url)


def rate(df: DataFrame, at: str) -> DataFrame:
    """pages, minutes, per_minute of pages with a time; per_minute is null for a single moment."""
    r = df.where(C(at).isNotNull()).agg(F.count(lit(1)).alias("pages"), ((F.max(F.unix_micros(at)) - F.min(F.unix_micros(at))) / lit(60e6)).alias("minutes"))
    return r.select("pages", "minutes", F.try_divide("pages", "minutes").alias("per_minute"))


def dispatch(df: DataFrame, url: str) -> DataFrame:
    """`df` with kind: `pdf` by suffix, else `html`."""
    return df.withColumn("kind", F.when(U.is_pdf(C(url)), "pdf").otherwise("html"))


def seed_union(*parts: DataFrame) -> DataFrame:
    """url: distinct normalized URLs of all parts."""
    out = parts[0].select("url")
    for p in parts[1:]:
        out = out.union(p.select("url"))
    return out.select(U.normalize(C("url")).alias("url")).where("url <> ''").distinct()

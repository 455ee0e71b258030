"""Exact duplicates: records, segments, paragraphs, URLs, merged sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T_

from corpusmill.functions import url as U
from corpusmill.session import materialize, small_side

C, lit = F.col, F.lit
WHITE = " \t\r\n"


def content_key(text: Column, least: int = 20) -> Column:
    """MD5 of the trimmed text; null for null and for texts shorter than `least`."""
    t = F.btrim(text, lit(WHITE))
    return F.when(F.length(t) >= least, F.md5(t))


def exact_duplicates(df: DataFrame, text: str, order: list[str], least: int = 20, max_broadcast_rows: int = 200_000) -> DataFrame:
    """`df` with content_key, keeper and kept.

    The first row of a text in `order` is kept; short and null texts have no key and are never kept. The keeper of a
    text comes from a partial aggregate over (key, order), so a text that a third of all rows share meets no
    single task. Only texts that repeat are on the joined side, which is broadcast if it is small; the wide rows then stay where they are.
    """
    keyed = df.withColumn("content_key", content_key(C(text), least))
    narrow = keyed.where("content_key is not null").select("content_key", *order)
    first = narrow.groupBy("content_key").agg(F.min(F.struct(*order)).alias("keeper"), F.count(lit(1)).alias("n")).where("n > 1").drop("n")
    first = small_side(materialize(first), max_broadcast_rows)
    out = keyed.join(first, "content_key", "left")  # keys of one row and null keys have no partner
    own = F.when(C("content_key").isNotNull(), F.struct(*order))
    out = out.withColumn("keeper", F.coalesce("keeper", own))
    return out.withColumn("kept", F.coalesce(C("keeper") == own, lit(False)))


def duplicate_stats(df: DataFrame, text: str, url: str) -> DataFrame:
    """rows, unique_content, unique_urls, too_short, duplicates_skipped: real counts of all of them."""
    key = content_key(C(text))
    hashed = F.xxhash64(key)
    per = df.select(key.alias("k"), U.normalize_for_dedup(C(url)).alias("u"))
    content = per.groupBy("k").agg(F.count(lit(1)).alias("n"))
    urls = per.where("u is not null").select("u").distinct().agg(F.count(lit(1)).alias("unique_urls"))
    total = content.agg(
        F.coalesce(F.sum("n"), lit(0)).alias("rows"), F.count(F.when(C("k").isNotNull(), 1)).alias("unique_content"), F.coalesce(F.sum(F.when(C("k").isNull(), C("n"))), lit(0)).alias("too_short"),
        F.coalesce(F.sum(F.when(C("k").isNotNull(), C("n") - 1)), lit(0)).alias("duplicates_skipped"),
    )
    return total.join(F.broadcast(urls)).select("rows", "unique_content", "unique_urls", "too_short", "duplicates_skipped")


def segments_by_hash(df: DataFrame, tokens: str, order: list[str]) -> DataFrame:
    """First segment of each SHA-1 over the joined tokens, with the number of rows that share it."""
    keyed = df.withColumn("segment_key", F.sha1(F.concat_ws(" ", C(tokens))))
    rest = [c for c in df.columns]
    first = keyed.groupBy("segment_key").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), F.count(lit(1)).alias("copies"))
    return first.select("segment_key", *[C("r")[c].alias(c) for c in rest], "copies")


@F.pandas_udf(T_.ArrayType(T_.StructType([T_.StructField("pos", T_.LongType()), T_.StructField("paragraph", T_.StringType())])))
def _first_paragraphs(parts: pd.Series, keys: pd.Series, least: pd.Series) -> pd.Series:
    out = []
    for ps, ks, n in zip(parts, keys, least):
        seen, kept = set(), []
        for i, (p, k) in enumerate(zip(ps, ks)) if ps is not None else ():
            if not k or (k in seen and len(k.split()) >= n):
                continue
            seen.add(k)
            kept.append({"pos": i, "paragraph": p})
        out.append(kept)
    return pd.Series(out)


def paragraph_dedup(df: DataFrame, key: str, text: str, least_tokens: int = 10, split: str = "\n") -> DataFrame:
    """key, pos, paragraph: a document's paragraphs without later repeats of those with at least `least_tokens` tokens.

    Works within the row, in linear time and without a shuffle: a paragraph goes if an earlier one has the same letters and digits.
    """
    parts = F.split(text, split)
    keys = F.transform(parts, lambda p: F.btrim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " ")))
    rows = df.where(C(text).isNotNull()).select(key, F.explode(_first_paragraphs(parts, keys, lit(least_tokens))).alias("x"))
    return rows.select(key, "x.pos", "x.paragraph")


def distinct_urls(df: DataFrame, url: str) -> DataFrame:
    """url_norm and the number of raw spellings of each URL."""
    pairs = df.where(C(url).isNotNull()).select(U.normalize_for_dedup(C(url)).alias("url_norm"), C(url).alias("u")).distinct()
    return pairs.groupBy("url_norm").agg(F.count(lit(1)).alias("spellings"))


def merge_sources(parts: list[DataFrame], keys: list[str], text: str) -> DataFrame:
    """Union of tables with the same columns: per key the row with the longest text, the earlier table winning ties.

    The key of a row is the first non-empty of `keys`; rows without any are dropped.
    """
    tagged = [p.withColumn("_part", lit(i)) for i, p in enumerate(parts)]
    every = tagged[0]
    for p in tagged[1:]:
        every = every.unionByName(p)
    key = F.coalesce(*[F.when(C(k) != "", C(k)) for k in keys])
    rest = parts[0].columns
    best = every.withColumn("_key", key).where("_key is not null").groupBy("_key")
    rank = F.struct(-F.coalesce(F.length(text), lit(0)), "_part", F.xxhash64(*rest))
    return best.agg(F.min_by(F.struct(*rest), rank).alias("r")).select(C("_key").alias("merge_key"), *[C("r")[c].alias(c) for c in rest])


def without_repeats(df: DataFrame, id_col: str = "id", order_col: str | None = "ingested_at", max_broadcast_rows: int = 200_000) -> DataFrame:
    """Keep the earliest row of each id without shuffling the wide rows where that is possible.

    Ids met more than once are found from two narrow columns. Rows of these ids alone are
    ordered and reduced; all others pass. The list of such ids is broadcast only after a count
    shows at most `max_broadcast_rows` of them; beyond that Spark shuffles both sides. Of rows
    that tie on id and order the one with the smallest content hash stays, so ties and exact repeats
    leave one row; without an order that hash alone decides. Null ids are dropped.
    """
    df = df.where(C(id_col).isNotNull())
    again = materialize(df.groupBy(id_col).agg(F.count(lit(1)).alias("n")).where("n > 1").select(id_col))
    once = df.join(small_side(again, max_broadcast_rows), id_col, "left_anti")
    twice = df.join(small_side(again, max_broadcast_rows), id_col, "left_semi")
    rest = [c for c in df.columns if c != id_col]
    first = twice.groupBy(id_col).agg(F.min_by(F.struct(*rest), F.struct(*([C(order_col).isNull(), order_col] if order_col else []), F.xxhash64(*rest))).alias("r"))
    return once.select(*df.columns).unionByName(first.select(id_col, *[C("r")[c].alias(c) for c in rest]).select(*df.columns))

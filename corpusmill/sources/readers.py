"""Sources: documents, manifests, corpora, names, sitemaps, seeds, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill.functions.url import allowed_domain
from corpusmill.operators import filters, names
from corpusmill.sources import fetch

C, lit = F.col, F.lit
METADATA = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("id", "source_url", "title", "description", "doc_type", "department", "timestamp", "content_hash")],
    *[T.StructField(n, T.LongType()) for n in ("content_length", "pages", "file_size_bytes")], T.StructField("filename", T.StringType()),
])
DOCUMENT = T.StructType([T.StructField("metadata", METADATA), T.StructField("content", T.StringType())])
DEDUP = T.StructType([T.StructField(n, T.LongType()) for n in ("unique_content", "unique_urls", "duplicates_skipped")])
CRAWL = T.StructType([*[T.StructField(n, T.LongType()) for n in ("pages_crawled", "pdfs_extracted", "pages_failed")], T.StructField("dedup_stats", DEDUP)])
MANIFEST = T.StructType([T.StructField("total_documents", T.LongType()), T.StructField("crawl_stats", CRAWL), T.StructField("documents", T.ArrayType(T.StructType([*METADATA.fields, T.StructField("storage_kind", T.StringType())])))])
SEGMENT = T.StructType([*[T.StructField(n, T.StringType()) for n in ("segment_id", "source_id", "source_url", "title", "doc_type", "department")], *[T.StructField(n, T.LongType()) for n in ("token_count", "phrase_merges")], T.StructField("text", T.StringType())])


def documents_json(spark: SparkSession, *paths: str) -> DataFrame:
    """One JSON document per file; with file_name. The order of files carries no meaning here, so nothing is sorted."""
    return spark.read.schema(DOCUMENT).json(list(paths), multiLine=True).select("*", C("_metadata.file_name").alias("file_name"))


def manifest_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of the manifest, with the manifest's totals."""
    return manifest_entries(spark.read.schema(MANIFEST).json(path, multiLine=True))


def manifest_entries(manifests: DataFrame) -> DataFrame:
    rest = [c for c in manifests.columns if c != "documents"]
    return manifests.select(*rest, F.explode("documents").alias("entry"))


def documents_by_manifest(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """id, metadata, content of the entries that have a document: the manifest's fields win where they are set.

    `entries` has entry (struct), `documents` metadata and content, one row per id. An id met in several entries is
    taken once, from the entry with the greatest title.
    """
    fields = [f.name for f in METADATA.fields]
    named = entries.select(C("entry.id").alias("id"), C("entry").alias("m")).where("id is not null")
    one = named.groupBy("id").agg(F.max_by("m", F.struct(C("m.title"), F.xxhash64("m"))).alias("m"))
    docs = documents.select(C("metadata.id").alias("id"), C("metadata").alias("d"), "content").where("id is not null")
    merged = F.struct(*[F.coalesce(C(f"m.{n}"), C(f"d.{n}")).alias(n) for n in fields])
    return one.join(docs, "id").select("id", merged.alias("metadata"), "content")


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a text file parted by an empty line, with ids `fallback-000000` on; a kept document type."""
    from corpusmill.operators.ranking import global_rank

    blocks = spark.read.text(path, lineSep="\n\n").select(F.btrim("value", lit(" \t\r\n")).alias("content"), F.monotonically_increasing_id().alias("at")).where("content <> ''")
    return global_rank(blocks, [C("at")], "n").select(F.format_string("fallback-%06d", "n").alias("id"), lit("Fallback").alias("doc_type"), "content")


def tokenized_corpus(spark: SparkSession, path: str) -> DataFrame:
    """line tokens of a corpus file with one space-joined sequence per line; empty lines are dropped."""
    t = F.btrim("value", lit(" \t\r"))
    return spark.read.text(path).where(t != "").select(F.monotonically_increasing_id().alias("sequence_id"), F.split(t, r"\s+").alias("tokens"))


def name_list(spark: SparkSession, path: str, allow_repeats: bool = False) -> DataFrame:
    return names.load(spark.read.text(path), "value", allow_repeats)


def seed_urls(spark: SparkSession, path: str) -> DataFrame:
    """url of each line that is neither empty nor a comment."""
    t = F.btrim("value")
    return spark.read.text(path).select(t.alias("url")).where((C("url") != "") & ~C("url").startswith("#"))


def sitemap_urls(documents: DataFrame, xml: str, domain: str) -> tuple[DataFrame, DataFrame]:
    """(pages, child sitemaps) of sitemap documents: locations on the domain."""
    loc = F.regexp_extract_all(C(xml), lit(r"<loc>\s*([^<\s]+)\s*</loc>"), lit(1))
    rows = documents.select(C(xml).contains("<sitemapindex").alias("index"), F.explode(loc).alias("url")).where(allowed_domain(C("url"), domain))
    return rows.where("not index").select("url").distinct(), rows.where("index").select("url").distinct()


def binary_files(spark: SparkSession, path: str, max_bytes: int = 20_000_000) -> DataFrame:
    """path, size, data of files up to the cap; larger ones are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(C("length") <= max_bytes).select("path", C("length").alias("size"), C("content").alias("data"))


class PageSnapshot(DataSource):
    """`spark.read.format("page_snapshot").option("path", ...)`: url and html of a JSON-lines snapshot, one partition per file.

    Stands in for fetching: a status of 404 gives no page, other failures a null page.
    """

    @classmethod
    def name(cls) -> str:
        return "page_snapshot"

    def schema(self) -> str:
        return "url string, status int, html string"

    def reader(self, schema) -> DataSourceReader:
        return _SnapshotReader(self.options["path"])


class _SnapshotReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        p = Path(self.path)
        return [InputPartition(str(f)) for f in (sorted(p.glob("*.jsonl")) if p.is_dir() else [p])]

    def read(self, partition: InputPartition):
        import json

        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    r = json.loads(line)
                    status = int(r.get("status", 200))
                    if status != 404:
                        yield r.get("url"), status, r.get("html") if status == 200 else None


def pdf_documents(files: DataFrame, extract=fetch.pdf_text, least: int = 20, english: bool = False) -> DataFrame:
    """path, pages, content of PDF files with at least `least` characters; `extract(bytes) -> (text, pages)` may be the caller's
    library. With `english` others are left out."""

    def run(batches):
        for pdf in batches:
            got = [extract(bytes(d)) for d in pdf["data"]]
            pdf = pdf.assign(content=[g[0] for g in got], pages=[g[1] for g in got])
            yield pdf[["path", "pages", "content"]]

    out = files.mapInPandas(run, "path string, pages bigint, content string")
    kept = out.where(F.length(F.btrim("content")) >= least)
    return kept.where(filters.is_english(C("content"))) if english else kept


def lemma_table(spark: SparkSession, path: str) -> dict[str, str]:
    """form, lemma of a file of tab-separated pairs: a caller's table for `functions.text.lemma`. An empty one leaves the rules for plurals."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") == 2).collect()  # a word list
    return {r.p[0]: r.p[1] for r in rows}


def sitemap_closure(documents: DataFrame, url: str, xml: str, seeds: DataFrame, domain: str) -> DataFrame:
    """url of the pages listed by the sitemaps in `seeds` (url) and by those they name, however deep; `documents` is the snapshot."""
    from corpusmill.operators.crawl import breadth_first

    at = documents.select(C(url).alias("_at"), C(xml).alias("_xml"))
    loc = F.regexp_extract_all("_xml", lit(r"<loc>\s*([^<\s]+)\s*</loc>"), lit(1))
    rows = at.select("_at", C("_xml").contains("<sitemapindex").alias("index"), F.explode(loc).alias("url")).where(allowed_domain(C("url"), domain))
    reached = breadth_first(seeds, rows.where("index").select(C("_at").alias("src"), C("url").alias("dst"))).select(C("url").alias("_at"))
    return rows.where("not index").join(reached, "_at", "left_semi").select("url").distinct()

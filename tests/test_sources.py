import json
import time

from pyspark.sql import functions as F

from corpusmill.operators import embedding  # noqa: F401
from corpusmill.sources import readers, sinks
from corpusmill.streaming import pages


def write_docs(folder, n=3):
    folder.mkdir(exist_ok=True)
    for i in range(n):
        m = {"id": f"i{i}", "source_url": f"http://a.b/research/{i}", "title": f"T{i}", "doc_type": "Research", "timestamp": f"2024-01-0{i + 1}T00:00:00+00:00"}
        words = " ".join(f"word{chr(97 + k % 26)}{chr(97 + (k + (i > 0)) % 7)}" for k in range(150))
        (folder / f"{i}.json").write_text(json.dumps({"metadata": m, "content": words}, indent=1))


def test_documents_and_manifest(spark, tmp_path):
    write_docs(tmp_path / "docs")
    docs = readers.documents_json(spark, str(tmp_path / "docs"))
    assert docs.count() == 3 and {r.file_name for r in docs.select("file_name").collect()} == {"0.json", "1.json", "2.json"}
    (tmp_path / "m.json").write_text(json.dumps({"total_documents": 2, "documents": [{"id": "i1", "title": "Other", "storage_kind": "html"}, {"id": "missing", "title": "x"}]}))
    got = readers.documents_by_manifest(readers.manifest_json(spark, str(tmp_path / "m.json")), docs).collect()
    assert [(r.id, r.metadata.title, r.metadata.doc_type) for r in got] == [("i1", "Other", "Research")]


def test_text_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\ntwo\n\n\n\nthree\n\n")
    assert [(r.id, r.content) for r in readers.text_blocks(spark, str(tmp_path / "t.txt")).orderBy("id").collect()] == [("fallback-000000", "one\ntwo"), ("fallback-000001", "three")]
    (tmp_path / "c.txt").write_text("a b\n\n c \n")
    assert sorted(r.tokens for r in readers.tokenized_corpus(spark, str(tmp_path / "c.txt")).collect()) == [["a", "b"], ["c"]]
    (tmp_path / "s.txt").write_text("# note\nhttp://a\n\n")
    assert [r.url for r in readers.seed_urls(spark, str(tmp_path / "s.txt")).collect()] == ["http://a"]
    xml = spark.createDataFrame([("<sitemapindex><loc>http://a.b/s.xml</loc></sitemapindex>",), ("<urlset><loc> http://a.b/p </loc><loc>http://z/p</loc></urlset>",)], "x string")
    urls, maps = readers.sitemap_urls(xml, "x", "a.b")
    assert [r.url for r in urls.collect()] == ["http://a.b/p"] and [r.url for r in maps.collect()] == ["http://a.b/s.xml"]


def test_page_snapshot(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(x) for x in ({"url": "u1", "html": "<p>x"}, {"url": "u2", "status": 404}, {"url": "u3", "status": 500, "html": "e"})))
    spark.dataSource.register(readers.PageSnapshot)
    got = spark.read.format("page_snapshot").option("path", str(tmp_path / "p.jsonl")).load().orderBy("url").collect()
    assert [(r.url, r.html) for r in got] == [("u1", "<p>x"), ("u3", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "id string, t array<string>")
    sinks.corpus_text(df, "t", str(tmp_path / "c"))
    assert sorted(r.tokens for r in readers.tokenized_corpus(spark, str(tmp_path / "c")).collect()) == [["x", "y"], ["z"]]
    sinks.save_model(df, {"dim": 2}, str(tmp_path / "m"))
    back, config = sinks.load_model(spark, str(tmp_path / "m"))
    assert back.count() == 2 and config == {"dim": 2}
    sinks.manifest(df, str(tmp_path / "man"))
    assert spark.read.json(str(tmp_path / "man")).select(F.max("total_documents")).first()[0] == 2


def test_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 10)
    (tmp_path / "b.pdf").write_bytes(b"y" * 999)
    files = readers.binary_files(spark, str(tmp_path), max_bytes=100)
    got = readers.pdf_documents(files, lambda b: ("a text of some length, long enough", 1)).collect()
    assert len(got) == 1 and got[0].pages == 1
    assert readers.pdf_documents(files).count() == 0  # no PDF at all


def test_fetch_policy():
    from corpusmill.sources import fetch

    def server(*answers):
        left = list(answers)

        def get(url):
            a = left.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        return get

    waits = []
    ok = (200, "text/html", b"x")
    go = lambda *a: fetch.fetch("u", server(*a), sleep=waits.append)
    assert go(ok) == fetch.Fetched("html", b"x", ()) and go((200, "application/pdf", b"x")).kind == "pdf"
    assert go((404, "", b"")).kind == "missing" and go((403, "", b"")).kind == "missing" and not waits
    assert go((429, "", b""), (503, "", b""), ok).waits == (4.0, 2.0)
    assert go(TimeoutError(), ConnectionError(), (500, "", b"")) == fetch.Fetched("failed", None, (1.0, 2.0, 4.0))


def test_pdf_text_and_fallback():
    import zlib

    from corpusmill.sources import fetch

    page = zlib.compress(b"BT /F1 12 Tf (Field \\(station\\)) Tj T* [(wat) -20 (er)] TJ ET")
    data = b"%PDF-1.4 1 0 obj << /Type /Page >> endobj 2 0 obj << /Filter /FlateDecode >> stream\n" + page + b"\nendstream endobj"
    assert fetch.pdf_text(data) == ("Field (station)\nwater", 1)

    def broken(_):
        raise ValueError

    assert fetch.pdf_text(b"x", (broken, lambda _: ("", 3), lambda _: (" text ", 2))) == ("text", 2)
    assert fetch.pdf_text(b"x", (broken,)) == ("", 0)


def test_sitemaps_of_sitemaps(spark):
    docs = spark.createDataFrame([("http://a.b/m", "<sitemapindex><loc>http://a.b/n</loc></sitemapindex>"), ("http://a.b/n", "<urlset><loc>http://a.b/p</loc></urlset>"), ("http://a.b/o", "<urlset><loc>http://a.b/q</loc></urlset>")], "u string, x string")
    got = readers.sitemap_closure(docs, "u", "x", spark.createDataFrame([("http://a.b/m",)], "url string"), "a.b").collect()
    assert [r.url for r in got] == ["http://a.b/p"]


def test_stream(spark, tmp_path):
    write_docs(tmp_path / "in")
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    pages.write(pages.process(pages.read_documents(spark, str(tmp_path / "in"))), out, chk).awaitTermination(120)
    assert {r.id for r in spark.read.parquet(out).collect()} & {"i1", "i2"} and spark.read.parquet(out).count() == 2
    time.sleep(0.1)
    pages.write(pages.process(pages.read_documents(spark, str(tmp_path / "in"))), out, chk).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2

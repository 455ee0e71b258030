"""Every query with SQL against DuckDB, and the contract of the entry module."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusmill.plans import catalog


def rows(frame, cols):
    def show(v):
        if v is None or v != v:
            return "NULL"
        if isinstance(v, float):
            return "0" if v == 0 else f"{v:.{max(0, 6 - math.floor(math.log10(abs(v))) - 1)}f}".rstrip("0").rstrip(".")
        return str(v)

    return sorted("|".join(show(r[c]) for c in cols) for r in frame)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(data):
        c.sql(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_duckdb(spark, data, con, name):
    got = catalog.queries()[name](spark, data)
    want = con.sql(catalog.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows([r.asDict() for r in got.collect()], cols) == rows([dict(zip(want.columns, r)) for r in want.fetchall()], cols)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_give_rows(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pipeline(spark):
    from corpusmill.plans import pipeline

    body = "\n\n".join(" ".join(f"{chr(97 + (i * k) % 26)}{chr(98 + (i + k) % 24)}word{chr(97 + i % 13)}" for i in range(30)) + "." for k in range(1, 6))
    docs = spark.createDataFrame([(1, body, "Research", "A title", "en"), (2, body, "Research", None, "en"), (3, None, None, None, None), (4, body, "General", "x", "en")], "id bigint, text string, kind string, title string, lang string")
    r = pipeline.build(docs, "id", "text", "kind", "title", lang="lang", term_ratio=0.9)
    segs = r.segments.collect()
    assert segs and all(s.id == 1 for s in segs) and all(s.copies == 2 for s in segs)
    why = {x.reason: x.documents for x in r.reasons.collect()}
    assert why["kept"] == 2 and why["excluded_doc_type:General"] == 1 and sum(why.values()) == 4


def test_other_languages_are_a_reason(spark, data, con):
    got = {r.reason: r.documents for r in catalog.queries()["corpus_filter_reasons"](spark, data).collect()}
    labelled = con.sql("select count(*) from (select min(declared_lang) as l from crawldoc where metadata.id is not null group by metadata.id) where not starts_with(lower(l), 'en')").fetchall()[0][0]
    assert 0 < labelled <= got["non_english"]
    assert sum(got.values()) == con.sql("select count(distinct metadata.id) from crawldoc").fetchall()[0][0]


def test_generated_names_are_measured(spark, data):
    q = catalog.queries()
    made, known = [r.name for r in q["name_generate"](spark, data).collect()], {r.name for r in q["name_list"](spark, data).collect()}
    m, f = q["generated_metrics"](spark, data).first(), q["generated_failures"](spark, data).first()
    assert (m.generated, m.unique, m.novel) == (len(made), len(set(made)), sum(x not in known for x in made))
    assert (f.copied, f.short, f.long) == (sum(x in known for x in made), sum(len(x) <= 3 for x in made), sum(len(x) >= 13 for x in made))
    assert m.novel > 0 and f.short + f.long > 0


def test_negatives_of_the_whole_vocabulary(spark, data):
    q = catalog.queries()
    assert {r.token for r in q["negative_samples"](spark, data).select("token").distinct().collect()} == {r.token for r in q["vocabulary_ids"](spark, data).collect()}


def test_analogies_of_every_twentieth_vector(spark, data, con):
    q = catalog.queries()
    got = [tuple(r) for r in q["vector_analogies"](spark, data).collect()]
    ids = {r[0] for r in con.sql("select a.vec_id from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 join embeddings c on c.vec_id = a.vec_id + 2 where a.vec_id % 20 = 0 and a.embedding is not null and b.embedding is not null and c.embedding is not null").fetchall()}
    assert {r[0] for r in got} == ids and len(got) == 5 * len(ids) and len(ids) > 5

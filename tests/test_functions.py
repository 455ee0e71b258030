from pyspark.sql import functions as F

from corpusmill.functions import text as T, url as U, vectors as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_whitespace(spark):
    assert one(spark, T.normalize_whitespace, "a\u00a0b\r\nc  d http://x.y e@f.gh") == "a b\nc d"
    assert one(spark, T.normalize_whitespace, "é\n\n\n\nx") == "x"
    assert one(spark, lambda c: T.normalize_whitespace(c, False), "é\n\n\n\nx") == "é\n\nx"
    assert one(spark, T.normalize_whitespace, None) is None


def test_headings(spark):
    assert one(spark, T.normalize_heading, "  Quick-Links: (2024) - ") == "quick-links 2024"
    assert one(spark, T.is_drop_heading, "quick links") and not one(spark, T.is_drop_heading, "quick links today")
    assert one(spark, T.is_drop_heading, "how to apply now")


def test_tokens(spark):
    assert one(spark, T.tokens, "Don't e-mail cs101 x9- 42") == ["don't", "e-mail", "cs101", "x9"]
    assert one(spark, T.tokens, None) == []
    assert one(spark, T.normalized_tokens, "The Labs of machine_learning, http studies state-owned") == ["the", "laboratory", "of", "machine_learning", "study", "state", "owned"]


def test_noise(spark):
    words = {"the": False, "a": True, "12": True, "cs101": True, "viii": True, "abc12345": True, "a-b-c": True, "deadbeef": True, "notes_jan_24": True, "http": True, "topology": False}
    got = spark.createDataFrame([(w,) for w in words], "t string").select("t", T.is_noise(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == words


def test_predicates_on_arrays(spark):
    roster = ["phd", "msc", "dr", "prof", "btech", "x"]
    assert one(spark, T.is_roster, roster, "array<string>")
    assert not one(spark, T.is_roster, [], "array<string>")
    assert one(spark, T.is_low_signal, ["a"] * 14, "array<string>")
    assert one(spark, T.is_low_signal, ["same"] * 25, "array<string>")
    assert not one(spark, T.is_low_signal, [f"w{i}" for i in range(25)], "array<string>")
    assert one(spark, T.skip_sequence, ["a", "a", "b"], "array<string>")


def test_urls(spark):
    assert one(spark, U.normalize, "http://a.b/c/#d") == "http://a.b/c"
    assert one(spark, U.normalize_for_dedup, "HTTP://A.b/c/?utm_source=x&id=3") == "http://a.b/c?id=3"
    assert one(spark, U.normalize_for_dedup, "http://a.b/?utm_source=x") == "http://a.b"
    assert one(spark, U.host, "https://User.Example:80/x") == "user.example" and one(spark, U.host, "nothing") is None
    dom = lambda c: U.allowed_domain(c, "example.org")
    assert one(spark, dom, "http://a.example.org/") and not one(spark, dom, "http://notexample.org/") and one(spark, dom, None) is False
    assert one(spark, U.filename, "http://a.b/c/d%20e.pdf?x=1") == "d e.pdf" and one(spark, U.filename, "http://a.b/") is None
    assert one(spark, U.is_pdf, "http://a.b/c.PDF?x") and not one(spark, U.is_pdf, None)
    assert one(spark, U.doc_type, "http://a.b/people/x") == "Faculty Profile" and one(spark, U.doc_type, None) == "General"


def test_vectors(spark):
    assert one(spark, V.unit, [3.0, 4.0], "array<double>") == [0.6, 0.8]
    assert one(spark, V.unit, [0.0, 0.0], "array<double>") == [0.0, 0.0]
    assert one(spark, lambda c: V.view("average", c, F.array(F.lit(1.0), F.lit(0.0))), [3.0, 4.0], "array<double>") == [2.0, 2.0]

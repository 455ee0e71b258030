import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import cleaning, crawl, dedup, embedding, filters, html, names, ranking, similarity, statistics, vocabulary


def test_section_skip(spark):
    text = "\n".join([
        "# Intro to water", "Levels are read daily.", "## Quick links", "hidden one", "### Deeper", "hidden two", "# Results", "- rain gauge", "12. numbered", "Related pages", "hidden three", "", "shown again", "# Overview", "kept under generic",
    ])
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(cleaning.clean_scraped(F.col("t")).alias("c")).collect()
    assert got[0].c.split("\n") == ["Intro to water", "Levels are read daily.", "Results", "rain gauge", "numbered", "", "shown again", "kept under generic"]
    assert got[1].c == "" and got[2].c == ""


def test_nested_drop_heading_sets_a_deeper_level(spark):
    text = "# Contact\nx1\n## References\nx2\n## Methods\ny1\n# Next\ny2"
    got = spark.createDataFrame([(text,)], "t string").select(cleaning.clean_scraped(F.col("t")).alias("c")).first().c
    assert got.split("\n") == ["Methods", "y1", "Next", "y2"]


def test_long_paragraphs_repeat_once(spark):
    long = "one two three four five six seven eight nine ten eleven"
    got = spark.createDataFrame([(f"{long}\n\nshort\n\n{long}!\n\nshort",)], "t string").select(cleaning.clean_scraped(F.col("t")).alias("c")).first().c
    assert got == f"{long}\n\nshort\n\nshort"


def test_corpus_clean(spark):
    text = "See [the guide](http://x.y) for machine learning.It is state-\nof the art &amp; more [note] here.\n\n42\n\nAnother paragraph with enough words."
    got = spark.createDataFrame([(text,)], "t string").select(cleaning.clean_corpus(F.col("t")).alias("c")).first().c
    assert "machine_learning. It is stateof the art & more" in got and "note" not in got and got.endswith("Another paragraph with enough words.") and "42" not in got


def test_reasons(spark):
    df = spark.createDataFrame([("Research", "t", "http://a/b", "word " * 200), ("General", "t", "u", "x"), (None, None, None, None), ("Research", "t", "u", "short text")], "k string, t string, u string, c string")
    got = [r.r for r in df.select(filters.scraped_reason(F.col("k"), F.col("t"), F.col("u"), F.col("c")).alias("r")).collect()]
    assert got == ["low_unique_ratio", "excluded_doc_type:General", "too_short_after_cleaning", "too_short_after_cleaning"]


def test_dedup(spark):
    df = spark.createDataFrame([(1, " same long enough text here "), (2, "same long enough text here"), (3, "short"), (4, None)], "id bigint, t string")
    got = {r.id: r.kept for r in dedup.exact_duplicates(df, "t", ["id"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    s = dedup.duplicate_stats(df.withColumn("u", F.lit("http://a/")), "t", "u").first()
    assert tuple(s) == (4, 1, 1, 2, 1)
    a = spark.createDataFrame([("x", "u1", "aa"), ("", "u2", "b"), (None, None, "c")], "id string, url string, t string")
    b = spark.createDataFrame([("x", "u1", "aaa"), ("u2", "", "z")], "id string, url string, t string")
    got = {r.merge_key: r.t for r in dedup.merge_sources([a, b], ["id", "url"], "t").collect()}
    assert got == {"x": "aaa", "u2": "b"}


@pytest.mark.parametrize("parts", [1, 5])
def test_global_rank(spark, parts):
    rows = [(f"w{i}", i % 4) for i in range(50)]
    got = ranking.global_rank(spark.createDataFrame(rows, "w string, n bigint").repartition(parts), [F.desc("n"), F.asc("w")], "r").collect()
    want = {w: i for i, (w, n) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert {r.w: r.r for r in got} == want
    empty = ranking.global_rank(spark.createDataFrame([], "w string, n bigint"), [F.asc("w")], "r")
    assert empty.count() == 0


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c"]), (3, ["a", "c", "b"])], "id bigint, t array<string>")
    v = vocabulary.build(df, "t", 2)
    assert {r.token: r.token_id for r in v.collect()} == {"b": 0, "a": 1, "c": 2}
    assert {r.id: r.ids for r in vocabulary.encode(df, "id", "t", v).collect()} == {1: [0, 1, 0], 3: [1, 2, 0]}
    p = {r.token: r.probability for r in vocabulary.noise_distribution(v).collect()}
    assert abs(sum(p.values()) - 1) < 1e-9 and p["b"] > p["a"]
    neg = vocabulary.negatives(v.select("token", F.col("token_id").alias("pos")), vocabulary.noise_distribution(v), "token", "pos", 6, 1).collect()
    ids = {r.token: r.token_id for r in v.collect()}
    assert len(neg) == 18 and all(r.token_id != ids[r.token] for r in neg)
    assert vocabulary.split_validation(df, "id", 3).where("validation").count() == 1


def test_neighbours_match_brute_force(spark):
    g = np.random.default_rng(0)
    m = g.normal(size=(60, 8))
    m[7] = 0
    df = spark.createDataFrame([(i, m[i].tolist(), 1) for i in range(60)] + [(60, None, 1)], "id bigint, v array<double>, query bigint").drop("query")
    got = similarity.neighbours(df, df.where("id % 20 = 0"), "id", "v", 4, block=2).collect()
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for q in (0, 20, 40):
        s = np.round(u @ u[q], 6)
        want = [i for i in sorted(range(60), key=lambda i: (-s[i], i)) if i != q][:4]
        assert [r.id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r.rank)] == want
    assert similarity.neighbours(df, df.where("id < 0"), "id", "v", 4).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("Ann ",), ("a\tnn",), (" ",), (None,), ("Bo",)], "name string")
    assert {r.name: r.copies for r in names.load(df, "name", True).collect()} == {"ann": 2, "bo": 1}
    with pytest.raises(Exception, match="duplicate name"):
        names.load(df, "name").collect()
    known = spark.createDataFrame([("ann",), ("bo",)], "name string")
    chars = names.characters(known)
    assert {r.token: r.idx for r in chars.collect()} == {"<pad>": 0, "<bos>": 1, "<eos>": 2, "a": 3, "b": 4, "n": 5, "o": 6}
    assert {r.name: r.decoded for r in names.decode(names.encode(known, chars), chars).collect()} == {"ann": "ann", "bo": "bo"}
    samples = spark.createDataFrame([("ann",), ("zzz",), ("zzz",), ("abcdefghijklm",)], "name string")
    m = names.sample_metrics(samples, known).first()
    assert (m.generated, m.unique, m.novel) == (4, 3, 3) and abs(m.average_length - 5.5) < 1e-9
    f = names.failure_modes(samples, known).first()
    assert tuple(f) == (1, 1, 3, 1, 2)
    none = names.sample_metrics(samples.limit(0), known).first()
    assert tuple(none) == (0, 0, 0, 0.0, 0.0, 0.0)
    a = [r.name for r in names.generate(known, 20).orderBy("sample_no").collect()]
    assert a == [r.name for r in names.generate(known, 20).orderBy("sample_no").collect()] and all(0 < len(x) <= 24 for x in a)


def test_breadth_first(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("z", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {r.url: r.depth for r in crawl.breadth_first(seeds, links).collect()} == {"a": 0, "b": 1, "c": 2}
    assert [r.url for r in crawl.breadth_first(seeds, links, limit=2).collect()] == ["a", "b"]
    assert {r.url for r in crawl.breadth_first(seeds, links, seen=spark.createDataFrame([("b",)], "url string")).collect()} == {"a"}


def test_html():
    title, desc, main, full, links = html.read_page('<title>T</title><meta name="description" content="D"><nav><p>no</p><a href="/x">x</a></nav><main><h2>H</h2><p>a <b>b</b></p><li>c</li></main><div class="sidebar"><p>side</p></div><p>rest</p><a href="y z#f">', "http://s/d/")
    assert (title, desc, main) == ("T", "D", "## H\n\na b\n\n- c") and full.endswith("rest") and "side" not in full and "no" not in full
    assert links == ["http://s/x", "http://s/d/y%20z"]
    assert html.read_page(None, None) == ("", "", "", "", [])


def test_gradients_of_rows_met_often_add_up_without_copies():
    """A row met once, some met a few times, and one met in most places; a batch takes the memory of a few rows."""
    import tracemalloc

    g = np.random.default_rng(5)
    at = np.concatenate([[90], g.integers(0, 40, 150), np.full(3000, 7)])
    coef, of, x = g.normal(size=len(at)), g.integers(0, 64, len(at)), g.normal(size=(64, 200))
    want = np.zeros((100, 200))
    np.add.at(want, at, coef[:, None] * x[of])
    tracemalloc.start()
    rows, got = embedding.sum_by_row(at, coef, of, x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows.tolist() == sorted(set(at.tolist())) and np.allclose(got, want[rows]) and most < 0.25 * len(at) * x[0].nbytes
    w, a = np.zeros((100, 200)), embedding.RowAdam(np.zeros((100, 200)))
    a.step(w, at, coef, of, x, 0.01)
    assert np.allclose(w[rows], -0.01 * want[rows] / (abs(want[rows]) + 1e-8 / 0.001**0.5)) and not np.delete(w, rows, 0).any()


def test_embedding_learns():
    g = np.random.default_rng(1)
    seqs = [np.array(g.permutation(5) + 5 * int(g.integers(0, 2))) for _ in range(300)]
    counts = np.bincount(np.concatenate(seqs), minlength=10)
    for model in ("cbow", "skipgram"):
        t = embedding.train(seqs, counts, embedding.Config(model, 8, 2, 3, epochs=6, rate=0.2, batch=32))
        assert t["loss"][-1] < t["loss"][0]
        u = t["input"] / np.linalg.norm(t["input"], axis=1, keepdims=True)
        s = u @ u.T
        inside = (s[:5, :5].sum() - 5) / 20
        assert inside > s[:5, 5:].mean()
    with pytest.raises(ValueError):
        embedding.train(seqs, counts, embedding.Config("other"))
    assert len(embedding.grid()) == 24


def test_statistics(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), ([],)], "t array<string>")
    assert tuple(statistics.length_stats(df, "t").first()) == (3, 3, 2, 1.0, 1.0)
    assert [tuple(r) for r in statistics.top_tokens(df, "t", 1).collect()] == [("a", 2)]
    assert '"vocabulary":2' in statistics.dataset_json(df, "t").first().stats
    assert statistics.report([{"model": "x", "loss": 0.5}]).splitlines()[2] == "| x | 0.5000 |"


def test_embedding_grid_trains_on_all_sequences(spark):
    """Tokens that stand in one sequence each are learned, whichever shard they are in."""
    seqs = [(f"s{i:03}", [2 * i, 2 * i + 1] * 4) for i in range(200)]
    encoded = spark.createDataFrame(seqs, "segment_id string, ids array<bigint>")
    vocab = spark.createDataFrame([(f"t{i}", 4, i) for i in range(400)], "token string, count bigint, token_id bigint")
    configs = [embedding.Config(m, 8, 2, 3, epochs=2, batch=8, min_delta=-1e9) for m in ("cbow", "skipgram")]
    for r in embedding.run_grid(encoded, "segment_id", vocab, configs, shard_rows=40, wave_bytes=1).collect():
        start = embedding.initial(400, 8, 42)[0]
        moved = (abs(np.array(r.input) - start) > 1e-7).any(axis=1)
        assert moved.sum() == 380 and r.validation_loss > 0  # all but the held-out 5 %


def test_embedding_runs_end_by_the_rules_of_the_grid(spark):
    """Runs of the grid may go on for 120 epochs; one that improves no more falls to the least rate, and ends after 20 epochs at the earliest."""
    assert all((c.epochs, c.least_epochs, c.batch, c.patience) == (120, 20, 128, 8) for c in embedding.grid())

    def rates(c, losses):
        run, seen = embedding.Progress(c), []
        while not run.ended:
            seen.append(run.rate)
            run.after(losses(run.epochs))
        return seen, run

    seen, run = rates(embedding.Config(), lambda e: 3.0)
    assert len(seen) == 33 and run.stopped_early and run.best == 3 and seen[-1] == 1e-4
    assert [i for i in range(1, 33) if seen[i] < seen[i - 1]] == [5, 9, 13, 17, 21, 25]
    seen, run = rates(embedding.Config(), lambda e: 3 - 0.01 * e)
    assert len(seen) == 120 and not run.stopped_early and set(seen) == {0.005} and run.best == 3 - 0.01 * 119
    seen, run = rates(embedding.Config(rate=1e-4), lambda e: 3.0)
    assert len(seen) == 20 and run.stopped_early
    seen, run = rates(embedding.Config(min_delta=1), lambda e: 3 - 0.001 * e)  # too little for the best, enough to keep the rate
    assert len(seen) == 20 and set(seen) == {0.005}

    flat = embedding.Config("skipgram", 4, 1, 2, rate=1e-4, min_delta=1e9)
    seqs = [np.array([i, i + 1]) for i in range(9)]
    assert len(embedding.train(seqs, np.ones(10), flat, seqs[:2])["loss"]) == 20
    encoded = spark.createDataFrame([(f"s{i}", [i, i + 1]) for i in range(9)], "segment_id string, ids array<bigint>")
    vocab = spark.createDataFrame([(f"t{i}", 2, i) for i in range(10)], "token string, count bigint, token_id bigint")
    r = embedding.run_grid(encoded, "segment_id", vocab, [flat]).first()
    assert (r.epochs, r.stopped_early) == (20, True)


def test_embedding_runs_and_shards_in_lots_give_the_same(spark):
    """Runs that begin when others end, and shards trained one after the other; long and short sequences, one without context."""
    seqs = [(f"s{i:02}", [i % 7, i % 5, (i * i) % 11, i % 3][: 2 + i % 3]) for i in range(60)]
    encoded = spark.createDataFrame(seqs, "segment_id string, ids array<bigint>")
    vocab = spark.createDataFrame([(f"t{i}", 12 - i, i) for i in range(12)], "token string, count bigint, token_id bigint")
    configs = [embedding.Config(m, d, 2, 3, epochs=e, batch=8) for m, d, e in (("cbow", 6, 1), ("skipgram", 8, 3), ("cbow", 4, 2))]
    known = {}
    for wave, lot in ((1 << 20, 1 << 20), (1, 1), (1600, 3000)):
        for r in embedding.run_grid(encoded, "segment_id", vocab, configs, shard_rows=20, wave_bytes=wave, shuffle_bytes=lot).collect():
            got = np.concatenate([np.ravel(r.input), np.ravel(r.output), [r.final_loss, r.validation_loss, r.epochs]])
            assert np.allclose(got, known.setdefault(r.run_no, got), atol=1e-6) and r.epochs == configs[r.run_no].epochs
    assert len(known) == 3
    target, ctx, mask = embedding._cbow_rows([np.array([4, 5, 6]), np.array([7]), np.array([8, 9])], 2, None)
    assert target.tolist() == [4, 5, 6, 8, 9] and [sorted(c[m > 0].tolist()) for c, m in zip(ctx, mask)] == [[5, 6], [4, 6], [4, 5], [9], [8]]


def test_negatives_by_the_noise_distribution():
    g, counts = np.random.default_rng(3), np.array([50.0, 0.5, 20, 1, 8])
    neg = embedding.draw_negatives(g, np.cumsum(counts), np.full(40_000, 2), 5)
    want = np.where(np.arange(5) == 2, 0, counts) / (counts.sum() - 20)
    assert neg.shape == (40_000, 5) and np.allclose(np.bincount(neg.ravel(), minlength=5) / neg.size, want, atol=0.005)
    neg = embedding.draw_negatives(g, np.cumsum(np.ones(3000)), np.zeros(2, np.int64), 2)
    assert ((neg > 0) & (neg < 3000)).all()

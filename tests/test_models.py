import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import session
from corpusmill.operators import crawl, ranking, recurrent as Q, similarity, vocabulary

NAMES = ["anna", "annabel", "bella", "clara", "lara", "mara", "sara", "tara", "nora", "dora"]
CHARS = ["<pad>", "<bos>", "<eos>", *sorted(set("".join(NAMES)))]


def test_parameter_counts():
    assert [Q.parameters(m, 28) for m in Q.MODELS] == [8988, 54684, 19165]
    with pytest.raises(ValueError):
        Q.initial("gru", 28)


@pytest.mark.parametrize("model", Q.MODELS)
def test_gradients_and_learning(model):
    g, c = np.random.default_rng(0), Q.Config()
    enc = [np.array([1, *(CHARS.index(x) for x in n), 2]) for n in NAMES]
    w = Q.initial(model, len(CHARS))
    x, size, t = Q.prefixes_of(enc[:4])
    live = {k: Q.Value(a) for k, a in w.items()}
    value = lambda: float(Q.loss_of(Q.logits(model, {k: Q.Value(a) for k, a in w.items()}, x, size, c), t).data)
    Q.backward(Q.loss_of(Q.logits(model, live, x, size, c), t))
    for k, a in w.items():
        i = (3, 1) if k == "embedding" else tuple(int(g.integers(n)) for n in a.shape)
        old, f = a[i], []
        for d in (1e-5, -1e-5):
            a[i] = old + d
            f.append(value())
        a[i] = old
        assert abs((f[0] - f[1]) / 2e-5 - live[k].grad[i]) < 1e-6
    state = {"w": w, "m": {k: np.zeros_like(a) for k, a in w.items()}, "v": {k: np.zeros_like(a) for k, a in w.items()}, "step": 0}
    losses = []
    for e in range(5):
        state, total, n = Q.epoch(model, state, enc * 6, c, [1, e])
        losses.append(total / n)
    assert losses[-1] < 0.6 * losses[0] and not state["w"]["embedding"][Q.PAD].any()
    # padding changes nothing
    one = Q.logits(model, {k: Q.Value(a) for k, a in state["w"].items()}, x[:1, : size[0]], size[:1], c).data
    assert np.allclose(one, Q.logits(model, {k: Q.Value(a) for k, a in state["w"].items()}, x[:1], size[:1], c).data)
    made = Q.sample(model, state["w"], CHARS, 40, c, [1])
    assert len(made) == 40 and all(made) and max(map(len, made)) <= c.longest and made == Q.sample(model, state["w"], CHARS, 40, c, [1])


@pytest.mark.parametrize("model", Q.MODELS)
def test_steps_of_a_layer_are_one_operation(model):
    g, w, sizes = np.random.default_rng(2), Q.initial(model, len(CHARS)), []
    for steps in (2, 40):
        todo, seen = [Q.logits(model, {k: Q.Value(a) for k, a in w.items()}, g.integers(1, len(CHARS), (5, steps)), np.full(5, steps), Q.Config())], {}
        while todo:
            v = todo.pop()
            if id(v) not in seen:
                seen[id(v)] = v
                todo += [p for p, _ in v.back]
        sizes.append(len(seen))
    assert sizes[0] == sizes[1]


@pytest.mark.parametrize("lstm", [False, True])
def test_layer_equals_its_steps(lstm):
    g, h, lengths = np.random.default_rng(3), 4, np.array([2, 5, 1, 5, 3])
    x, rec, s = g.normal(size=(5, 5, 4 * h if lstm else h)), g.normal(size=(h, 4 * h if lstm else h)), lambda z: 1 / (1 + np.exp(-z))
    every = Q.layer_states(Q.Value(x), Q.Value(rec), lengths, lstm, True).data
    for r, n in enumerate(lengths):
        state, cell = np.zeros(h), np.zeros(h)
        for t in range(5):
            if t < n:
                z = x[r, t] + state @ rec
                if lstm:
                    i, f, c, o = np.split(z, 4)
                    cell = s(f) * cell + s(i) * np.tanh(c)
                    state = s(o) * np.tanh(cell)
                else:
                    state = np.tanh(z)
            assert np.allclose(every[r, t], state)
    assert np.allclose(Q.layer_states(Q.Value(x), Q.Value(rec), lengths, lstm, False).data, every[:, -1])


@pytest.mark.parametrize("shard", [1000, 4])
def test_training_over_shards(spark, shard):
    names = spark.createDataFrame([(n, 1) for n in NAMES], "name string, copies bigint")
    w, history, chars = Q.train(names, ("vanilla_rnn",), Q.Config(epochs=6), shard_names=shard)
    assert history["vanilla_rnn"][-1] < history["vanilla_rnn"][0] and chars == CHARS
    assert Q.generate(spark, w, chars, Q.Config(samples=30), block=7).count() == 30


def test_semantic_analysis(spark):
    e = np.eye(4)
    rows = [("king", e[0] + e[1]), ("man", e[0]), ("woman", e[2]), ("queen", e[1] + e[2]), ("tree", e[3]), ("trees", e[3] + 0.1 * e[0])]
    v = spark.createDataFrame([(t, x.tolist()) for t, x in rows], "token string, vector array<double>")
    r = similarity.semantic_analysis(v, ["tree", "none"], [("man", "king", "woman", ["queen"]), ("man", "none", "tree", [])], spark.createDataFrame([("trees",)], "token string"), 2).collect()
    by = {(x.question, x.rank): (x.answer, x.expected) for x in r}
    assert by["man:king::woman:?", 1] == ("queen", True) and by["none", None] == (None, False) and by["man:none::tree:?", None] == (None, False)
    assert "trees" not in {x.answer for x in r}


def test_tsne_keeps_clusters():
    g = np.random.default_rng(0)
    x = np.concatenate([g.normal(c, 0.1, (15, 8)) for c in (0, 3, -3)])
    z = similarity.tsne(x, rounds=400)
    near = np.argsort(((z[:, None] - z[None]) ** 2).sum(-1), 1)[:, 1]
    assert (near // 15 == np.arange(45) // 15).mean() > 0.95
    with pytest.raises(ValueError):
        similarity.tsne(x[:1])


def test_neighbours_in_blocks(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(60, 5))
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)] + [(99, None)], "k bigint, v array<double>")
    q = v.where("k % 4 = 0")
    a, b = (sorted(map(tuple, similarity.neighbours(v, q, "k", "v", 3, *s).collect())) for s in ((50_000, 20_000), (7, 4)))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(0, 60, 4) for j in [k for k in np.argsort(-(u @ u[i])) if k != i][:3]}
    assert a == b and {(r[0], r[1]) for r in a} == want


def test_running_sums_and_encoding_by_join(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).repartition(5)
    got = {r.k: r.s for r in ranking.running_sum(df, [F.col("k")], "v", "s").collect()}
    assert got == {k: sum(i % 7 for i in range(k)) for k in range(100)}
    seqs = spark.createDataFrame([(1, ["b", "x", "a", "b"]), (2, ["a"]), (3, None)], "s bigint, t array<string>")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "token string, token_id bigint")
    assert [[(r.s, list(r.ids)) for r in vocabulary.encode(seqs, "s", "t", vocab, 2, most).collect()] for most in (10, 1)] == [[(1, [1, 0, 1])]] * 2


def test_validation_share_is_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    got = {r.k for r in vocabulary.split_validation(df, "k", 7, 0.037).where("validation").collect()}
    import hashlib

    want = sorted(range(1000), key=lambda k: (int(hashlib.md5(f"7|{k}".encode()).hexdigest()[:8], 16), k))[:37]
    assert got == set(want)


def test_pages_are_processed_in_order(spark):
    para = " ".join(f"{a}{b}word" for a in "abcdefghijkl" for b in "mnopqrstuvwx")
    page = lambda body, link: f'<html><head><title>T</title></head><body><main><p>{body}</p><a href="{link}">x</a></main></body></html>'
    rows = [("http://a.b/research/1", page(para, "/p")), ("http://a.b/research/2", page(para, "/q")), ("http://a.b/research/3", page("short", "/r")), ("http://a.b/other", page(para + " z", "/s"))]
    docs, links = crawl.process_pages(spark.createDataFrame(rows, "url string, html string"), "url", "html")
    assert [(r.url, r.doc_type) for r in docs.collect()] == [("http://a.b/research/1", "Research")]
    assert {r.dst for r in links.collect()} == {"http://a.b/p", "http://a.b/q", "http://a.b/r", "http://a.b/s"}


def test_deep_crawls_and_limits(spark):
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(60)], "src string, dst string")
    seeds = spark.createDataFrame([("0",)], "url string")
    assert crawl.breadth_first(seeds, links, limit=5).count() == 5
    assert crawl.breadth_first(seeds, links).agg(F.max("depth")).first()[0] == 60


def test_small_sides_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 50, "t string")
    plan = lambda d: d._jdf.queryExecution().toString()
    assert "ResolvedHint" in plan(session.small_side(df, 100)) and "ResolvedHint" not in plan(session.small_side(df, 100, 10_000)) and "ResolvedHint" not in plan(session.small_side(df, 10))

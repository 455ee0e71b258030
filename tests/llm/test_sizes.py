import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing, packing, splitting, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="no vocabulary")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("tokens", F.lit("clash")).withColumn("step", F.lit(1)).withColumn("block", F.lit(2))


def test_counts_equal_the_whole_text():
    c = tokens.counter()
    g = random.Random(0)
    alphabet = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "é", "हिन्दी", "।", "1234", "x_y", "don't", "'s", "--", "​", " ", "\x1c", "日本", "😀", "."]
    for _ in range(400):
        t = "".join(g.choice(alphabet) for _ in range(g.randint(0, 40)))
        assert c.count(t) == len(c._bpe.encode_ordinary(t)) == int(c.chunks(t)[1].sum()), repr(t)
    assert c.count(None) == 0


def test_plan_uses_each_item_once():
    g = np.random.default_rng(0)
    for _ in range(20):
        cap = int(g.integers(1, 130))
        h = np.zeros(cap + 1, np.int64)
        h[g.integers(1, cap + 1, 40)] = g.integers(1, 500, 40)
        used = np.zeros_like(h)
        for mult, n in packing.plan(h, 100):
            assert sum(s * m for s, m in mult.items()) <= cap and n > 0
            for s, m in mult.items():
                used[s] += m * n
        assert (used == h).all()
    assert packing.plan(np.zeros(5, np.int64)) == []


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packing(spark, capacity):
    g = random.Random(capacity)
    rows = [(i, " ".join(g.choice(["alpha", "b", "gamma"]) for _ in range(g.choice([0, 1, 5, 20, 200, 900]))), "s") for i in range(150)]
    rows += [(500, None, None), (501, "", "s"), (502, "b b", "s"), (502, "b b", "s")] + [(1000 + i, "alpha b", "s") for i in range(80)]
    got = packing.pack(docs(spark, rows), capacity).collect()
    c = tokens.counter()
    want = {}
    for i, t, _ in rows:
        want[i] = want.get(i, 0) + c.count(t)
    have, room = {}, {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.tokens
        room[r.container] = room.get(r.container, 0) + r.tokens
    assert have == want and max(room.values()) <= capacity and min(room) >= 1
    assert all(r.piece_no == 1 or want[r.doc_id] > capacity for r in got)
    assert len(room) <= 1.12 * sum(want.values()) / capacity + 2
    s = packing.fill(packing.pack(docs(spark, rows), capacity), capacity).first()
    assert s.tokens == sum(want.values()) and s.largest <= capacity


def test_packing_empty(spark):
    assert packing.pack(docs(spark, []), 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, []), 0)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats bigint")


def test_mixing(spark):
    g = random.Random(2)
    sizes = {"a": 900, "b": 250, "c": 60, "d": 40}
    rows = [(i * 10 + k, " ".join(["word"] * g.randint(20, 60)), s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(-1, None, "a"), (-2, "x", None), (-3, "", "c"), (-4, "x", "other")]
    goal = [("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("absent", 0.1, 4), (None, 0.5, 1)]
    df = docs(spark, rows)
    got = mixing.mix(df, targets(spark, goal)).collect()
    assert {r.source for r in got} == {"a", "b", "c"} and len(got) == 900 + 250 + 60 + 2
    most = {"a": 1, "b": 2, "c": 3}
    assert all(0 <= r.uses <= most[r.source] for r in got)
    total = sum(r.uses * r.tokens for r in got)
    for s, share in (("a", 0.4), ("b", 0.3), ("c", 0.2)):
        assert abs(sum(r.uses * r.tokens for r in got if r.source == s) / total - share / 0.9) < 0.02
    assert any(r.uses == 3 for r in got if r.source == "c")
    out = {r.source: r for r in mixing.shares(mixing.mix(df, targets(spark, goal)), targets(spark, goal)).collect()}
    assert out["absent"].actual_share == 0 and abs(sum(r.actual_share for r in out.values()) - 1) < 1e-9
    order = mixing.mixed_order(df, targets(spark, goal)).orderBy("slot", "place").collect()
    times = {}
    for r in order:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {r.doc_id: r.uses for r in got if r.uses}
    first = {r.doc_id: r.slot for r in reversed(order)}
    assert first == {r.doc_id: r.first_slot for r in got if r.uses}
    slots = mixing.slot_table(df, targets(spark, goal), mixing.Settings(slots=1000)).orderBy("slot").collect()
    head = [r.source for r in slots[:90]]
    assert abs(head.count("a") - 40) <= 3 and abs(head.count("c") - 20) <= 3
    a, b = (sorted(map(tuple, mixing.mix(df.repartition(n), targets(spark, goal)).collect())) for n in (1, 6))
    assert a == b


def test_mixing_empty(spark):
    assert mixing.mix(docs(spark, []), targets(spark, [("a", 1.0, 1)])).count() == 0
    assert mixing.mix(docs(spark, [(1, "x", "a")]), targets(spark, [])).count() == 0


def test_splitting_round_trip(spark):
    g = random.Random(3)
    para = lambda: " ".join(g.choice(["alpha", "beta.", "gamma,", "δ", "हिन्दी।"]) for _ in range(g.randint(5, 60)))
    texts = {
        1: "\n\n".join(para() for _ in range(40)), 2: " ".join(["word"] * 3000), 3: "x" * 9000, 4: "\n".join(f"# Part {i}\n{para()}" for i in range(30)), 5: "short", 6: "日本語" * 1500, 7: "", 8: "a" * 3000 + " " + "b c. " * 700,
    }
    s = splitting.Settings(limit=128, overlap=16, above=600)
    df = docs(spark, [(k, v, None) for k, v in texts.items()] + [(9, None, None)])
    c = tokens.counter()
    by = {}
    for r in splitting.split_oversized(df, s).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {k for k, v in texts.items() if c.count(v) > 600}
    for k, rows in by.items():
        rows.sort(key=lambda r: r.piece_no)
        t = texts[k]
        assert all(r.text == t[r.first_char : r.end_char] for r in rows) and rows[0].first_char == 0 and rows[-1].end_char == len(t)
        assert rows[0].text + "".join(b.text[a.end_char - b.first_char :] for a, b in zip(rows, rows[1:])) == t
        assert all(c.count(r.text) <= 128 for r in rows)
        if k in (1, 2, 4):
            assert all(16 <= r.shared <= 32 for r in rows[1:])  # a word more at most
            assert len(rows) <= 1.1 * (c.count(t) - 16) / 112 + 3
        if k == 1:
            assert sum(r.boundary in ("paragraph", "sentence") for r in rows[:-1]) >= 0.7 * (len(rows) - 1)
    with pytest.raises(Exception):
        splitting.split_text("x y " * 500, c, splitting.Settings(limit=10, overlap=9, above=1))

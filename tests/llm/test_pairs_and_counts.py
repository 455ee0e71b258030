import itertools
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import host_lines, near_duplicates as N, records, term_counts

WORDS = [f"w{i}" for i in range(400)]
SMALL = N.Settings(width=3, min_words=20, weighted=0.5, exact=0.7)


def shingles(text, k=3):
    w = [x for x in re.split("[ \t\r\n]+", text.lower()) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)


def brute(rows, least, words):
    sets = {i: shingles(t) for i, t in rows if i is not None and t is not None}
    ok = {i: s for i, (s, n) in sets.items() if n >= words}
    return {(a, b) for a, b in itertools.combinations(sorted(ok), 2) if len(ok[a] & ok[b]) / max(1, len(ok[a] | ok[b])) >= least}


def corpus(seed=0):
    g = random.Random(seed)
    rows = []
    for i in range(60):
        base = [g.choice(WORDS) for _ in range(80)]
        rows.append((f"d{i:03}", " ".join(base)))
        if i % 3 == 0:
            for j in range(g.randint(1, 3)):
                v = list(base)
                for _ in range(g.randint(0, 6)):
                    v[g.randrange(len(v))] = g.choice(WORDS)
                rows.append((f"e{i:03}{j}", "\n".join([" ".join(v[:40]), " ".join(v[40:])])))
    rows += [("x1", rows[0][1].upper()), ("x2", rows[0][1] + " \r\n"), ("short", "a b c"), ("none", None), ("empty", ""), (None, "a b c"), rows[5]]
    return rows


def frame(spark, rows, **extra):
    df = spark.createDataFrame(rows, "id string, content string")
    for k, v in ({"host": "h", "title": None, "declared_lang": None, "doc_type": None, "ingested_at": None, "rep": "clash", "key": 1, "tokens": 3, "n": 4} | extra).items():
        df = df.withColumn(k, F.lit(v))
    return df


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    got = {(r.id_a, r.id_b) for r in N.alike_pairs(frame(spark, rows), SMALL).collect()}
    assert got == brute(rows, 0.7, 20)


@pytest.mark.parametrize("block", [4, 16])
def test_hot_buckets_are_cut_and_lose_no_pair(spark, block):
    """A third of all rows alike but not equal: buckets far over the block size give the same pairs."""
    g = random.Random(1)
    base = [g.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(40):
        v = list(base)
        v[g.randrange(len(v))] = f"u{i}"
        rows.append((f"h{i:02}", " ".join(v)))
    rows += [(f"o{i:02}", " ".join(g.choice(WORDS) for _ in range(120))) for i in range(80)]
    s = N.Settings(width=3, min_words=20, weighted=0.5, exact=0.7, block=block)
    assert {(r.id_a, r.id_b) for r in N.alike_pairs(frame(spark, rows), s).collect()} == brute(rows, 0.7, 20)


def test_exact_similarity_alone_decides_under_skew(spark):
    """A third of all records are edited copies: what they share is frequent, what differs is rare, so the weighted similarity
    of pairs at 0.70 to 0.85 is far below 0.6."""
    from corpusmill.llm.queries import ALIKE

    g = random.Random(5)
    base = [g.choice(WORDS) for _ in range(200)]
    rows = []
    for i in range(40):
        v = list(base)
        for k in g.sample(range(len(base)), 4 + i % 3):
            v[k] = f"u{i}x{k}"
        rows.append((f"h{i:02}", " ".join(v)))
    rows += [(f"o{i:02}", " ".join(g.choice(WORDS) for _ in range(200))) for i in range(80)]
    want = brute(rows, 0.7, 100)
    assert 100 < len(want) < 780 and len(want - brute(rows, 0.85, 100)) > 100
    assert {(r.id_a, r.id_b) for r in N.alike_pairs(frame(spark, rows), ALIKE).collect()} == want


def test_large_classes_become_stars(spark):
    text = " ".join(WORDS[:50])
    rows = [(f"c{i}", text) for i in range(6)] + [("z", text.replace("w49", "q"))]
    got = {(r.id_a, r.id_b) for r in N.alike_pairs(frame(spark, rows), SMALL, expand=3).collect()}
    assert got == {(f"c0", f"c{i}") for i in range(1, 6)} | {("c0", "z")}


def test_weighted_similarity_has_the_stated_bound():
    """Weights differ by at most `spread`, so an exact similarity bounds the weighted one from below, whatever the frequencies."""
    import numpy as np

    s = N.Settings(width=3, weighted=0, exact=0.7)
    assert abs(s.bound - 0.7 / (1.1 * 0.7 + 1.5 * 0.3)) < 1e-12
    g = np.random.default_rng(0)
    table = N.Frequencies(g.choice([0.0, 0.5, 7.0, 20.0], 1 << 14).astype(np.float32))
    for _ in range(50):
        keys = g.integers(0, 1 << 63, 100, dtype=np.uint64)
        u, v = (N.weight_of(table.levels(keys, g.integers(1, 40, 100), s), s) for _ in range(2))
        common, union = np.minimum(u[:70], v[:70]).sum(), np.maximum(u[:70], v[:70]).sum() + u[70:85].sum() + v[85:].sum()
        assert common / union >= s.bound - 0.03  # weights are rounded to steps


def test_families_take_linear_rows(spark):
    """50 000 variants of one text, and a second family that shares bands with it: rows grow with the variants, not with their pairs."""
    s = N.Settings(width=3, min_words=20, weighted=0, exact=0.7, bands=8)
    base = [f"v{i}" for i in range(60)]
    words = F.array(*[F.lit(w) for w in base])
    n = 50_000
    docs = spark.range(n, numPartitions=8).withColumnRenamed("id", "k").select(F.format_string("m%06d", "k").alias("id"), F.array_join(F.transform(words, lambda w, i: F.when(i == F.col("k") % 60, F.concat(F.lit("u"), F.col("k").cast("string"))).otherwise(w)), " ").alias("content"))
    far = spark.createDataFrame([("far", " ".join(base[:40] + [f"q{i}" for i in range(20)])), ("lone", " ".join(f"z{i}" for i in range(60)))], "id string, content string")
    signed = N._signed(docs.unionByName(far), s)
    assert N._stars(signed.classes, s).count() <= s.bands * (n + 2)
    got = N.alike_groups(docs.unionByName(far), s)
    assert got.count() == n + 2
    sizes = sorted(r["count"] for r in got.groupBy("group_id").count().collect())
    assert sizes == [1, 1, n]


@pytest.mark.parametrize("block", [3, 512])
def test_groups_meet_within_mixed_buckets(spark, block):
    """Chains whose ends are not alike: hubs join parts of them, the rest meets in blocks."""
    g = random.Random(9)
    rows = []
    for f in range(3):
        v = [g.choice(WORDS) for _ in range(90)]
        for i in range(25):
            rows.append((f"k{f}{i:02}", " ".join(v)))
            for _ in range(3):
                v[g.randrange(len(v))] = f"n{f}x{i}"
    pairs, parent = brute(rows, 0.7, 20), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    s = N.Settings(width=3, min_words=20, weighted=0, exact=0.7, block=block)
    got = {r.id: r.group_id for r in N.alike_groups(frame(spark, rows), s).collect()}
    assert got == {i: find(i) for i, _ in rows}


def test_groups(spark):
    rows = corpus(3)
    pairs = brute(rows, 0.7, 20)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.group_id for r in N.alike_groups(frame(spark, rows), SMALL).collect()}
    assert set(got) == {i for i, t in rows if i and t and shingles(t)[1] >= 20}
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a, b in itertools.combinations(sorted(got), 2))


def test_weighted_similarity_is_estimated_without_bias():
    import numpy as np

    g = np.random.default_rng(2)
    s = N.Settings(bands=200, rows=3, spread=12.0)
    keys = np.sort(g.integers(0, 1 << 63, 300, dtype=np.uint64))
    a, b = keys[:200], keys[80:280]
    la, lb = g.integers(0, s.levels, 200), g.integers(0, s.levels, 200)
    full = {int(k): [0.0, 0.0] for k in keys}
    for i, (part, level) in enumerate(((a, la), (b, lb))):
        for k, w in zip(part, N.weight_of(level, s)):
            full[int(k)][i] = w
    true = sum(min(v) for v in full.values()) / sum(max(v) for v in full.values())
    d = N._draws(s)
    x, y = (N._sample(k, level, np.array([0]), d, s)[:, 0] for k, level in ((a, la), (b, lb)))
    assert abs((x == y).mean() - true) < 0.08


@pytest.mark.parametrize("call", [lambda r: N.alike_pairs(r, SMALL), lambda r: N.alike_groups(r, SMALL), host_lines.repeated_places, host_lines.line_templates, host_lines.remove_repeated, term_counts.term_counts, term_counts.marked_terms])
def test_empty_tables(spark, call):
    assert call(frame(spark, []).withColumn("ingested_at", F.lit(None).cast("timestamp"))).count() == 0
    nulls = frame(spark, [(None, None), ("a", None), (None, "x y"), ("b", "")]).withColumn("host", F.lit(None).cast("string"))
    assert call(nulls).count() in (0, 1)


def test_host_lines_equal_brute_force(spark):
    g = random.Random(4)
    lines = [f"Line {i}: more, text" for i in range(12)] + ["", "123 456", "Tail - 7"]
    rows = [(f"r{i}", "\n".join(g.choice(lines) + (f" {g.randint(0, 99)}" if g.random() < 0.5 else "") for _ in range(8)) + "\r\nlast", g.choice(["a", "a", "b", None])) for i in range(60)]
    rows += [rows[0], rows[1]]
    df = spark.createDataFrame(rows, "id string, content string, host string").withColumn("path", F.lit("clash")).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    gone = str.maketrans("", "", string.digits + string.punctuation)
    norm = lambda x: re.sub("[ \t\r\n]+", " ", x.lower().translate(gone)).strip(" ")
    docs = {i: (c, h) for i, c, h in rows if h}
    hosts, seen = Counter(h for _, h in docs.values()), Counter()
    for c, h in docs.values():
        seen.update({(h, norm(x)) for x in c.split("\n")} - {(h, "")})
    want = {(i, k) for i, (c, h) in docs.items() for k, x in enumerate(c.split("\n"), 1) if norm(x) and seen[h, norm(x)] >= max(5, 0.3 * hosts[h])}
    got = {(r.id, r.line_no) for r in host_lines.repeated_places(df, min_share=0.3).collect()}
    assert got == want and want
    left = {r.id: r.content for r in host_lines.remove_repeated(df, min_share=0.3).collect()}
    assert len(left) == 60
    for i, c in left.items():
        whole = next(x for x in rows if x[0] == i)[1].split("\n")
        assert c == "\n".join(x for k, x in enumerate(whole, 1) if (i, k) not in want)


def test_templates_have_wildcards(spark):
    rows = [(f"r{i}", f"report of the {'red' if i % 2 else 'blue'} team", "h") for i in range(12)]
    df = spark.createDataFrame(rows, "id string, content string, host string")
    assert [(r.template, r.lines, r.records) for r in host_lines.line_templates(df).collect()] == [("report of the <*> team", 2, 12)]


def test_terms_equal_brute_force(spark):
    rows = [(i, c) for i, c in corpus(7)] + [("p", "(Hello) hello, -- HELLO! é É a\tb\rc d"), ("p", "(Hello) hello, -- HELLO! é É a\tb\rc d")]
    docs = {i: c for i, c in rows if i is not None and c is not None}
    occ, rec = Counter(), Counter()
    for c in docs.values():
        t = [w for w in (x.strip(string.punctuation) for x in re.split("[ \t\r\n]+", c.lower())) if w]
        occ.update(t)
        rec.update(set(t))
    for limit in (1_000_000, 5):
        got = {r.term: (r.occurrences, r.records) for r in term_counts.term_counts(frame(spark, rows), limit).collect()}
        assert got == {t: (occ[t], rec[t]) for t in occ}
    got = {r.term: (r.occurrences, r.records) for r in term_counts.term_counts(frame(spark, rows), 5, piece=7).collect()}  # counters put out within records
    assert got == {t: (occ[t], rec[t]) for t in occ}
    marks = {r.term: r.mark for r in term_counts.marked_terms(frame(spark, rows)).collect()}
    assert all(marks[t] == ("rare" if rec[t] < 3 else "common" if rec[t] > 0.2 * len(docs) else None) for t in rec)


def test_repeats_are_dropped_without_ties(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("a", "y", 1), ("b", "z", None), (None, "q", 1)], "id string, content string, ingested_at int")
    assert {(r.id, r.content) for r in records.without_repeats(df).collect()} == {("a", "y"), ("b", "z")}
    assert {(r.id, r.content) for r in records.without_repeats(df, max_broadcast_rows=0).collect()} == {("a", "y"), ("b", "z")}


def test_hosts(spark):
    urls = {"http://A.b:80/x": "a.b", "https://c.d?x": "c.d", "e.f/x": None, None: None, "ftp://g#h": "g"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", records.host_of(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in got} == urls

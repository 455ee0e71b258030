"""Neighbours, analogies, centroids, projection and model selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from corpusmill.functions import vectors as V

C, lit = F.col, F.lit


def _top(key: str, n: int):
    """The n nearest vectors of each query of a cell, ties included; a cell is one block of queries and one of vectors."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": left["query"][:0], key: right[key][:0], "similarity": np.zeros(0)})
        if not len(left) or not len(right):
            return none
        q, m = (np.array(x["v"].tolist(), float) for x in (left, right))
        q, m = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (q, m))
        names, keys, out = left["query"].to_numpy(), right[key].to_numpy(), [none]
        take = min(n + 1, len(m))
        for lo in range(0, len(q), 1024):
            s = q[lo : lo + 1024] @ m.T
            floor = -np.partition(-s, take - 1, axis=1)[:, take - 1]
            i, j = np.nonzero(s >= floor[:, None] - 1e-9)
            out.append(pd.DataFrame({"query": names[lo + i], key: keys[j], "similarity": s[i, j]}))
        return pd.concat(out[1:], ignore_index=True)

    return run


def neighbours(vectors: DataFrame, queries: DataFrame, key: str, vec: str, n: int, block: int = 50_000, query_block: int = 20_000) -> DataFrame:
    """query, key, similarity, rank of the n nearest vectors of each stated query by cosine; exact.

    Vectors and queries are dealt to blocks whose sizes bound what a task holds. Every block of queries meets every block of vectors in
    one task as a matrix product, which keeps n of each query, so few rows go on. Nothing comes to the driver but two counts. Null vectors take no part.
    """
    kind = vectors.schema[key].dataType.simpleString()
    table = vectors.where(C(vec).isNotNull()).select(key, C(vec).cast("array<double>").alias("v"))
    asked = queries.where(C(vec).isNotNull()).select(C(key).alias("query"), C(vec).cast("array<double>").alias("v"))
    rows, wanted = table.count(), asked.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts, sets = max(-(-rows // block), min(cores, -(-rows // 4096)), 1), max(-(-wanted // query_block), 1)

    def dealt(df: DataFrame, name: str, blocks: int, others: int, own: str, other: str) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(name, lit(5)), lit(blocks))).withColumn(other, F.explode(F.sequence(lit(0).cast("long"), lit(others - 1).cast("long"))))

    left, right = dealt(asked, "query", sets, parts, "a", "b"), dealt(table, key, parts, sets, "b", "a")
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(_top(key, n), f"query {kind}, `{key}` {kind}, similarity double")
    rounded = found.where(C("query") != C(key)).withColumn("similarity", F.round("similarity", 6))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return rounded.withColumn("rank", F.row_number().over(w)).where(C("rank") <= n)


def analogies_in_blocks(vectors: DataFrame, triples: DataFrame, key: str, vec: str, n: int) -> DataFrame:
    """As `analogies` for any number of triples with distinct a: their goals meet the vectors in blocks, as in `neighbours`."""
    u = vectors.select(key, V.unit(V.doubles(C(vec))).alias("v"))
    side = lambda name: u.select(C(key).alias(name), C("v").alias(f"v{name}"))
    q = triples.join(side("a"), "a").join(side("b"), "b").join(side("c"), "c")
    goal = F.zip_with(F.zip_with("vb", "va", lambda x, y: x - y), "vc", lambda x, y: x + y)
    found = neighbours(vectors, q.select(C("a").alias(key), goal.alias(vec)), key, vec, n + 2).drop("rank")  # b and c may be among them
    rows = found.withColumnRenamed("query", "a").join(triples, "a").where(~C(key).isin(C("b"), C("c")))
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(C("rank") <= n).select("a", "b", "c", key, "similarity", "rank")


def analogies(vectors: DataFrame, triples: DataFrame, key: str, vec: str, n: int) -> DataFrame:
    """a, b, c, key, similarity, rank for b - a + c over unit vectors; a, b and c themselves are left out."""
    u = vectors.select(key, V.unit(V.doubles(C(vec))).alias("v"))
    side = lambda name: u.select(C(key).alias(name), C("v").alias(f"v{name}"))
    q = triples.join(side("a"), "a").join(side("b"), "b").join(side("c"), "c")
    goal = F.zip_with(F.zip_with("vb", "va", lambda x, y: x - y), "vc", lambda x, y: x + y)
    q = q.select("a", "b", "c", V.unit(goal).alias("goal"))
    scored = u.join(F.broadcast(q), ~C(key).isin(C("a"), C("b"), C("c"))).select("a", "b", "c", key, F.round(V.dot(C("v"), C("goal")), 6).alias("similarity"))  # stated queries, a handful
    w = Window.partitionBy("a", "b", "c").orderBy(F.desc("similarity"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(C("rank") <= n)


def centroids(vectors: DataFrame, label: str, vec: str) -> DataFrame:
    """label, dim, value, members: mean of each component by label."""
    rows = vectors.where(C(vec).isNotNull()).select(label, F.posexplode(V.doubles(C(vec))).alias("dim", "x"))
    return rows.groupBy(label, "dim").agg(F.round(F.avg("x"), 6).alias("value"), F.count(lit(1)).alias("members")).select(label, C("dim").cast("long").alias("dim"), "value", "members")


def pca(vectors: DataFrame, key: str, vec: str, k: int = 2) -> DataFrame:
    """key and k principal coordinates of the centred vectors."""
    df = vectors.where(C(vec).isNotNull()).select(key, array_to_vector(V.doubles(C(vec))).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(df).transform(df)
    out = PCA(k=k, inputCol="centred", outputCol="pc").fit(centred).transform(centred)
    arr = vector_to_array("pc")
    return out.select(key, *[arr[i].alias(f"pc{i + 1}") for i in range(k)])


def best_runs(runs: DataFrame, group: str, keys: list) -> DataFrame:
    """The best run of each group by the given order of columns."""
    w = Window.partitionBy(group).orderBy(*keys)
    return runs.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def plot_words(focus: DataFrame, near: DataFrame, frequent: DataFrame, most: int = 120) -> DataFrame:
    """word, is_focus: focus words, then their neighbours, then frequent words; distinct, at most `most`."""
    every = focus.select("word", lit(0).alias("part"), "at").unionByName(near.select("word", lit(1).alias("part"), "at")).unionByName(frequent.select("word", lit(2).alias("part"), "at"))
    first = every.groupBy("word").agg(F.min(F.struct("part", "at")).alias("o"))
    return first.orderBy("o", "word").limit(most).select("word", (C("o.part") == 0).alias("is_focus"))


def semantic_analysis(vectors: DataFrame, words: list[str], questions: list[tuple[str, str, str, list[str]]], excluded: DataFrame | None = None, n: int = 5) -> DataFrame:
    """kind, question, rank, answer, similarity, expected: the n nearest words of each of `words`, and of b - a + c for each question (a, b, c,
    expected answers), over `vectors` (token, vector). Words of `excluded` (token) are no answers; the words of a question are none either.
    `expected` tells the first answer that was expected. A question with an unknown word has one row without an answer.

    Words and questions are the caller's, a handful.
    """
    spark = vectors.sparkSession
    u = vectors.select("token", V.unit(V.doubles(C("vector"))).alias("v"))
    asked = sorted({*words, *(w for q in questions for w in q[:3])})
    known = {r.token: np.array(r.v) for r in u.where(C("token").isin(*asked)).collect()}
    rows, own = [], []
    for w in words:
        rows.append((f"neighbours|{w}", known[w].tolist() if w in known else None))
        own.append((f"neighbours|{w}", [w], []))
    for a, b, c, answers in questions:
        g = known[b] - known[a] + known[c] if {a, b, c} <= known.keys() else None
        rows.append((f"analogy|{a}:{b}::{c}:?", g.tolist() if g is not None else None))
        own.append((rows[-1][0], [a, b, c], answers))
    table = u if excluded is None else u.join(excluded.select("token").distinct(), "token", "left_anti")
    asked_rows = spark.createDataFrame(rows, "token string, v array<double>")
    near = neighbours(table.select("token", "v"), asked_rows, "token", "v", n + 3).select(C("query").alias("name"), C("token").alias("answer"), "similarity")
    facts = spark.createDataFrame(own, "name string, own array<string>, answers array<string>")
    fit = near.join(F.broadcast(facts), "name").where(~F.array_contains("own", C("answer")))
    ranked = fit.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("similarity"), "answer"))).where(C("rank") <= n)
    hit = F.array_contains("answers", C("answer"))
    first = F.min(F.when(hit, C("rank"))).over(Window.partitionBy("name"))
    found = ranked.select("name", "rank", "answer", "similarity", F.coalesce(C("rank") == first, lit(False)).alias("expected"))
    every = facts.select("name").join(found, "name", "left")
    part = lambda i: F.get(F.split("name", "[|]", 2), lit(i))
    return every.select(part(0).alias("kind"), part(1).alias("question"), C("rank").cast("long").alias("rank"), "answer", "similarity", F.coalesce("expected", lit(False)).alias("expected"))


def tsne(x: np.ndarray, seed: int = 42, rounds: int = 1000) -> np.ndarray:
    """Two coordinates of each row by t-SNE after a projection to at most 50 principal axes; the perplexity is min(30, max(5, n // 4)).

    For the few points of a plot; fewer than two are an error. Starts from the two principal axes, so equal input gives equal output.
    """
    n = len(x)
    if n < 2:
        raise ValueError("a projection needs at least two vectors")
    y = x - x.mean(0)
    _, _, axes = np.linalg.svd(y, full_matrices=False)
    y = y @ axes[: min(50, x.shape[1], n)].T
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    goal, p = np.log(min(min(30, max(5, n // 4)), n - 1)), np.zeros((n, n))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        rest = np.delete(d[i], i)
        rest = rest - rest.min()
        for _ in range(60):
            w = np.exp(-rest * beta)
            h = np.log(w.sum()) + beta * (rest * w).sum() / w.sum()
            if abs(h - goal) < 1e-5:
                break
            lo, hi = (beta, hi) if h > goal else (lo, beta)
            beta = beta * 2 if np.isinf(hi) else (lo + hi) / 2
        p[i, np.arange(n) != i] = w / w.sum()
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    z = y[:, :2] / max(y[:, 0].std(), 1e-12) * 1e-4
    if z.shape[1] < 2:
        z = np.concatenate([z, np.random.default_rng(seed).normal(0, 1e-4, (n, 1))], 1)
    rate, speed, gain = max(n / 48, 50.0), np.zeros_like(z), np.ones_like(z)
    for k in range(rounds):
        near = 1 / (1 + ((z[:, None] - z[None]) ** 2).sum(-1))
        np.fill_diagonal(near, 0)
        q = np.maximum(near / near.sum(), 1e-12)
        f = ((12 if k < 250 else 1) * p - q) * near
        grad = 4 * (f.sum(1)[:, None] * z - f @ z)
        gain = np.maximum(np.where(np.sign(grad) == np.sign(speed), gain * 0.8, gain + 0.2), 0.01)
        speed = (0.5 if k < 250 else 0.8) * speed - rate * gain * grad
        z = z + speed
    return z - z.mean(0)


def plot_points(vectors: DataFrame, words: DataFrame, method: str = "tsne") -> DataFrame:
    """word, x, y, is_focus: the table behind a scatter plot of `words` (from `plot_words`, which bounds them) by `tsne` or `pca`."""
    rows = words.join(vectors.select(C("token").alias("word"), "vector"), "word").orderBy("word").collect()
    x = np.array([r.vector for r in rows], float).reshape(len(rows), -1)
    if method == "tsne":
        z = tsne(x)
    else:
        y = x - x.mean(0)
        z = y @ np.linalg.svd(y, full_matrices=False)[2][:2].T
    return vectors.sparkSession.createDataFrame([(r.word, float(a), float(b), r.is_focus) for r, (a, b) in zip(rows, z)], "word string, x double, y double, is_focus boolean")

"""Next-character models of names in numpy: a plain recurrent network, a bidirectional LSTM, and one with attention.

Gradients come from a small tape: every operation keeps its inputs and how a gradient passes back to them; all steps of a recurrent layer are
one operation. Training is in single precision, as the reference's is. Names are dealt to
shards of about `shard_names`; in each epoch every shard trains from the same weights and optimizer state, which are averaged over the shards
by their numbers of examples. One shard is plain training. What comes to the driver in an epoch are weights, whose size does not depend on
the data.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmill.operators import names as N
from corpusmill.session import materialize

PAD, BOS, EOS = 0, 1, 2
MODELS = ("vanilla_rnn", "blstm", "attention_rnn")


@dataclass(frozen=True)
class Config:
    """Fixed values of the reference's experiments."""

    embedding: int = 32
    hidden: int = 64
    rate: float = 0.003
    batch: int = 64
    epochs: int = 20
    dropout: float = 0.15
    temperature: float = 0.85
    samples: int = 300
    longest: int = 24
    tries: int = 12
    clip: float = 1.0
    seed: int = 42


class Value:
    """An array on the tape."""

    def __init__(self, data: np.ndarray, back=()) -> None:
        self.data, self.back, self.grad = data, back, None

    def __add__(self, other: "Value") -> "Value":
        return Value(self.data + other.data, ((self, lambda g: _fit(g, self.data)), (other, lambda g: _fit(g, other.data))))

    def __mul__(self, other: "Value") -> "Value":
        return Value(self.data * other.data, ((self, lambda g: _fit(g * other.data, self.data)), (other, lambda g: _fit(g * self.data, other.data))))

    def __matmul__(self, other: "Value") -> "Value":
        flat = lambda x: x.reshape(-1, x.shape[-1])
        return Value(self.data @ other.data, ((self, lambda g: g @ other.data.T), (other, lambda g: flat(self.data).T @ flat(g))))

    def map(self, out: np.ndarray, slope: np.ndarray) -> "Value":
        return Value(out, ((self, lambda g: g * slope),))

    def tanh(self) -> "Value":
        y = np.tanh(self.data)
        return self.map(y, 1 - y * y)

    def rows(self, at: np.ndarray) -> "Value":
        def back(g):
            z = np.zeros_like(self.data)
            flat = at.ravel()
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0))
            z[flat[order][first]] = np.add.reduceat(g.reshape(flat.size, -1)[order], first, axis=0)
            return z

        return Value(self.data[at], ((self, back),))


def _fit(g: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Gradient summed over the axes along which `like` was repeated."""
    while g.ndim > like.ndim:
        g = g.sum(0)
    for i, n in enumerate(like.shape):
        if n == 1 and g.shape[i] > 1:
            g = g.sum(i, keepdims=True)
    return g


def side_by_side(parts: list[Value]) -> Value:
    ends = np.cumsum([p.data.shape[-1] for p in parts])
    return Value(np.concatenate([p.data for p in parts], -1), tuple((p, lambda g, a=e - p.data.shape[-1], b=e: g[..., a:b]) for p, e in zip(parts, ends)))


def attended(scores: Value, mask: np.ndarray, states: Value) -> Value:
    """Mean of the states of each row, weighted by the softmax of its scores; padding has no weight."""
    z = np.where(mask, scores.data[..., 0], -np.inf)
    w = np.exp(z - z.max(1, keepdims=True))
    w /= w.sum(1, keepdims=True)

    def to_scores(g):
        d = np.einsum("bh,bth->bt", g, states.data)
        return (w * (d - (w * d).sum(1, keepdims=True)))[..., None]

    return Value(np.einsum("bt,bth->bh", w, states.data), ((scores, to_scores), (states, lambda g: w[..., None] * g[:, None, :])))


def loss_of(logits: Value, target: np.ndarray) -> Value:
    z = logits.data.astype(float)
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    i = np.arange(len(target))

    def back(g):
        d = p.copy()
        d[i, target] -= 1
        return (g * d / len(target)).astype(logits.data.dtype)

    return Value(np.array(-np.log(np.maximum(p[i, target], 1e-300)).mean()), ((logits, back),))


def backward(out: Value) -> None:
    """Gradients of every value that `out` came from."""
    order, seen, todo = [], set(), [(out, False)]
    while todo:
        v, done = todo.pop()
        if done:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            todo.append((v, True))
            todo += [(p, False) for p, _ in v.back]
    out.grad = np.ones_like(out.data)
    for v in reversed(order):
        for p, f in v.back:
            g = f(v.grad)
            p.grad = g if p.grad is None else p.grad + g


def initial(model: str, size: int, c: Config = Config()) -> dict[str, np.ndarray]:
    """Weights by name: normal embeddings with a zero row for padding, uniform layers. An unknown model is an error."""
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    g, h, e = np.random.default_rng(c.seed), c.hidden, c.embedding
    w = {"embedding": g.normal(size=(size, e))}
    w["embedding"][PAD] = 0

    def layer(name: str, rows: int, cols: int, reach: float, biases: int = 1) -> None:
        w[name] = g.uniform(-reach, reach, (rows, cols))
        for k in range(biases):
            w[f"{name}_b{k}"] = g.uniform(-reach, reach, cols)

    gates, ways = (4, ("f", "b")) if model == "blstm" else (1, ("f",))
    for x in ways:
        layer(f"in_{x}", e, gates * h, h**-0.5, 2)
        layer(f"rec_{x}", h, gates * h, h**-0.5, 0)
    if model == "attention_rnn":
        layer("query", h, h, h**-0.5)
        layer("key", h, h, h**-0.5)
        layer("score", h, 1, h**-0.5)
    wide = h if model == "vanilla_rnn" else 2 * h
    layer("out", wide, size, wide**-0.5)
    return w


def parameters(model: str, size: int, c: Config = Config()) -> int:
    return sum(x.size for x in initial(model, size, c).values())


def describe(model: str, c: Config = Config()) -> str:
    """One line on the layers of a model."""
    e, h = c.embedding, c.hidden
    how = {
        "vanilla_rnn": f"one recurrent tanh layer of {h} units; its last state", "blstm": f"an LSTM layer of {h} units in each direction; both last states",
        "attention_rnn": f"one recurrent tanh layer of {h} units; its last state and the mean of all states by additive attention",
    }
    return f"characters as {e} numbers, {how[model]}, a linear layer over the alphabet"


def layer_states(given: Value, rec: Value, lengths: np.ndarray, lstm: bool, every: bool) -> Value:
    """State after the last step of each row, or with `every` after each step; rows keep their state once their prefix has ended.

    One operation of the tape for all steps. Rows are put in order of length, so that a step computes only those that still run.
    """
    b, steps, wide = given.data.shape
    h = rec.data.shape[0]
    order = np.argsort(-lengths, kind="stable")
    live = np.searchsorted(-lengths[order], -np.arange(steps), side="left")  # rows longer than t
    z = np.ascontiguousarray(given.data[order].transpose(1, 0, 2))
    kind = given.data.dtype
    states, cells = np.zeros((steps + 1, b, h), kind), np.zeros((steps + 1, b, h), kind) if lstm else None
    half = np.repeat(np.array([0.5, 0.5, 1.0, 0.5], kind), h) if lstm else None  # a sigmoid is a tanh of half its argument
    for t in range(steps):
        n = live[t]
        x = z[t, :n]
        x += states[t, :n] @ rec.data
        states[t + 1] = states[t]
        if lstm:
            x *= half
            np.tanh(x, out=x)
            x *= half
            x += 1 - half
            cells[t + 1] = cells[t]
            cells[t + 1, :n] = x[:, h : 2 * h] * cells[t, :n] + x[:, :h] * x[:, 2 * h : 3 * h]
            states[t + 1, :n] = x[:, 3 * h :] * np.tanh(cells[t + 1, :n])
        else:
            states[t + 1, :n] = np.tanh(x, out=x)
    back_order = np.empty_like(order)
    back_order[order] = np.arange(b)
    memo: list[tuple[np.ndarray, np.ndarray]] = []

    def passed_back(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if memo:
            return memo[0]
        g = g[order]
        dz, dh, dc = np.zeros((steps, b, wide), kind), np.zeros((b, h), kind) if every else g.copy(), np.zeros((b, h), kind)
        back = np.ascontiguousarray(rec.data.T)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            if every:
                dh += g[:, t]
            x, d = z[t, :n], dz[t, :n]
            if lstm:
                i, f, c, o = (x[:, k * h : (k + 1) * h] for k in range(4))
                y = np.tanh(cells[t + 1, :n])
                down = dc[:n] + dh[:n] * o * (1 - y * y)
                d[:, :h] = down * c * i * (1 - i)
                d[:, h : 2 * h] = down * cells[t, :n] * f * (1 - f)
                d[:, 2 * h : 3 * h] = down * i * (1 - c * c)
                d[:, 3 * h :] = dh[:n] * y * o * (1 - o)
                dc[:n] = down * f
            else:
                d[:] = dh[:n] * (1 - x * x)
            dh[:n] = d @ back
        memo.append((dz.transpose(1, 0, 2)[back_order], states[:-1].reshape(-1, h).T @ dz.reshape(-1, wide)))
        return memo[0]

    out = states[1:].transpose(1, 0, 2)[back_order] if every else states[-1][back_order]
    return Value(out, ((given, lambda g: passed_back(g)[0]), (rec, lambda g: passed_back(g)[1])))


def _states(w: dict[str, Value], way: str, x: Value, lengths: np.ndarray, lstm: bool, every: bool = False) -> Value:
    given = x @ w[f"in_{way}"] + (w[f"in_{way}_b0"] + w[f"in_{way}_b1"])
    return layer_states(given, w[f"rec_{way}"], lengths, lstm, every)


def _last(states: Value) -> Value:
    def back(g: np.ndarray) -> np.ndarray:
        z = np.zeros_like(states.data)
        z[:, -1] = g
        return z

    return Value(states.data[:, -1], ((states, back),))


def logits(model: str, w: dict[str, Value], prefixes: np.ndarray, lengths: np.ndarray, c: Config, g: np.random.Generator | None = None) -> Value:
    """Scores of the next character; with a generator embeddings are dropped out."""
    mask = np.arange(prefixes.shape[1])[None, :] < lengths[:, None]

    def read(ids: np.ndarray) -> Value:
        x = w["embedding"].rows(ids)
        return x * Value(((g.random(x.data.shape) >= c.dropout) / (1 - c.dropout)).astype(x.data.dtype)) if g is not None else x

    if model == "attention_rnn":
        every = _states(w, "f", read(prefixes), lengths, False, every=True)
        last = _last(every)
    else:
        last = _states(w, "f", read(prefixes), lengths, model == "blstm")
    if model == "blstm":
        back = np.where(mask, np.take_along_axis(prefixes, np.maximum(lengths[:, None] - 1 - np.arange(prefixes.shape[1]), 0), 1), PAD)
        last = side_by_side([last, _states(w, "b", read(back), lengths, True)])
    elif model == "attention_rnn":
        query = last @ w["query"] + w["query_b0"]
        wide = Value(query.data[:, None, :], ((query, lambda d: d.sum(1)),))
        score = (every @ w["key"] + w["key_b0"] + wide).tanh() @ w["score"] + w["score_b0"]
        last = side_by_side([last, attended(score, mask, every)])
    return last @ w["out"] + w["out_b0"]


def prefixes_of(encoded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded prefixes, their lengths, and the characters that follow."""
    pairs = [(s[:k], s[k]) for s in encoded for k in range(1, len(s))]
    size = np.array([len(p) for p, _ in pairs], np.int64)
    padded = np.full((len(pairs), int(size.max(initial=1))), PAD, np.int64)
    for row, (p, _) in zip(padded, pairs):
        row[: len(p)] = p
    return padded, size, np.array([t for _, t in pairs], np.int64)


def epoch(model: str, state: dict, encoded: list[np.ndarray], c: Config, seed: list[int]) -> tuple[dict, float, int]:
    """Weights and optimizer state after one pass (Adam, gradients clipped by their norm), the sum of losses and the number of examples."""
    x, size, target = prefixes_of(encoded)
    g = np.random.default_rng(seed)
    (w, m, v), step = ({k: a.copy() for k, a in state[p].items()} for p in "wmv"), state["step"]
    total, order = 0.0, g.permutation(len(target))
    for lo in range(0, len(order), c.batch):
        b = order[lo : lo + c.batch]
        live = {k: Value(a) for k, a in w.items()}
        loss = loss_of(logits(model, live, x[b][:, : size[b].max()], size[b], c, g), target[b])
        backward(loss)
        grads = {k: p.grad if p.grad is not None else np.zeros_like(p.data) for k, p in live.items()}
        grads["embedding"][PAD] = 0
        norm = float(np.sqrt(sum((d * d).sum() for d in grads.values())))
        step += 1
        for k, d in grads.items():
            d = d * min(1.0, c.clip / (norm + 1e-6))
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            w[k] -= c.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        total += float(loss.data) * len(b)
    return {"w": w, "m": m, "v": v, "step": step}, total, len(target)


def sample(model: str, w: dict[str, np.ndarray], chars: list[str], count: int, c: Config, seed: list[int]) -> list[str]:
    """Up to `count` names, drawn together a character at a time; empty ones are drawn again, `tries` times in all at most."""
    g, live, out = np.random.default_rng(seed), {k: Value(a) for k, a in w.items()}, []
    for _ in range(c.tries):
        n = count - len(out)
        if n <= 0:
            break
        ids, ended = np.full((n, 1), BOS), np.zeros(n, bool)
        for _ in range(c.longest):
            z = logits(model, live, ids, np.full(n, ids.shape[1]), c).data.astype(float) / c.temperature
            z[:, [PAD, BOS]] = -np.inf
            p = np.exp(z - z.max(1, keepdims=True))
            nxt = (np.cumsum(p / p.sum(1, keepdims=True), 1) > g.random((n, 1))).argmax(1)
            ended |= nxt == EOS
            ids = np.concatenate([ids, np.where(ended, PAD, nxt)[:, None]], 1)
            if ended.all():
                break
        out += [x for r in ids[:, 1:] if (x := "".join(chars[k] for k in r if k > EOS))]
    return out


def train(names: DataFrame, models: tuple[str, ...] = MODELS, c: Config = Config(), shard_names: int = 20_000) -> tuple[dict[str, dict[str, np.ndarray]], dict[str, list[float]], list[str]]:
    """(best weights of each model, mean loss of each epoch, characters): the weights of the epoch of the least training loss."""
    table = N.characters(names)
    chars = [r.token for r in table.orderBy("idx").collect()]  # the alphabet
    data = materialize(N.encode(names, table))
    n = data.count()
    if not n:
        raise ValueError("training needs names")
    shards = -(-n // shard_names)
    groups = len(models) * shards
    dealt = materialize(data.withColumn("shard", F.pmod(F.xxhash64("name", F.lit(9)), F.lit(shards))).crossJoin(F.broadcast(names.sparkSession.createDataFrame([(m,) for m in models], "model string"))))  # a row per name and model
    spark = names.sparkSession
    states = {}
    for m in models:
        w = {k: a.astype(np.float32) for k, a in initial(m, len(chars), c).items()}
        states[m] = {"w": w, "m": {k: np.zeros_like(a) for k, a in w.items()}, "v": {k: np.zeros_like(a) for k, a in w.items()}, "step": 0}
    best, history = {m: (np.inf, states[m]["w"]) for m in models}, {m: [] for m in models}
    for e in range(c.epochs):
        shared = spark.sparkContext.broadcast(states)

        def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            m, shard = key
            seqs = [np.array(x, np.int64) for x in pdf.sort_values("name")["ids"]]
            after, total, seen = epoch(m, shared.value[m], seqs, c, [c.seed, e, int(shard)])
            return pd.DataFrame([(m, total, seen, pickle.dumps(after))], columns=["model", "loss", "examples", "state"])

        got = dealt.repartition(min(max(32, 4 * groups), 2000), "model", "shard").groupBy("model", "shard").applyInPandas(learn, "model string, loss double, examples bigint, state binary").collect()
        shared.destroy()
        for m in models:
            mine = [r for r in got if r.model == m]
            seen = sum(r.examples for r in mine)
            parts = [(r.examples / seen, pickle.loads(r.state)) for r in sorted(mine, key=lambda r: r.state)]
            states[m] = {p: {k: sum(share * s[p][k] for share, s in parts) for k in parts[0][1][p]} for p in "wmv"} | {"step": max(s["step"] for _, s in parts)}
            history[m].append(sum(r.loss for r in mine) / seen)
            if history[m][-1] < best[m][0]:
                best[m] = (history[m][-1], states[m]["w"])
    return {m: best[m][1] for m in models}, history, chars


def generate(spark, weights: dict[str, dict[str, np.ndarray]], chars: list[str], c: Config = Config(), block: int = 100) -> DataFrame:
    """model, sample_no, name: `samples` names of each model, in blocks that are tasks of their own."""
    shared = spark.sparkContext.broadcast(weights)
    blocks = [(m, lo, min(block, c.samples - lo)) for m in weights for lo in range(0, c.samples, block)]

    def run(batches):
        for pdf in batches:
            for m, lo, n in zip(pdf["model"], pdf["first"], pdf["n"]):
                got = sample(m, shared.value[m], chars, int(n), c, [c.seed, MODELS.index(m), int(lo)])
                yield pd.DataFrame({"model": m, "sample_no": range(lo, lo + len(got)), "name": got})

    table = spark.createDataFrame(blocks, "model string, first bigint, n bigint").repartition(len(blocks), "model", "first")
    return table.mapInPandas(run, "model string, sample_no bigint, name string")


def results(names: DataFrame, models: tuple[str, ...] = MODELS, c: Config = Config()) -> DataFrame:
    """model, parameters, first_loss, train_loss and the metrics of the generated names against all names."""
    weights, history, chars = train(names, models, c)
    made = materialize(generate(names.sparkSession, weights, chars, c))
    out = None
    for m in models:
        facts = [F.lit(m).alias("model"), F.lit(sum(x.size for x in weights[m].values())).cast("long").alias("parameters"), F.lit(history[m][0]).alias("first_loss"), F.lit(min(history[m])).alias("train_loss")]
        one = N.sample_metrics(made.where(F.col("model") == m), names).select(*facts, "*")
        out = one if out is None else out.unionByName(one)
    return out

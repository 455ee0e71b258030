"""Name lists: reading, encoding, generation and the metrics of generated samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import text as T
from corpusmill.operators.ranking import global_rank

C, lit = F.col, F.lit
SPECIALS = ("<pad>", "<bos>", "<eos>")


def clean(name: Column) -> Column:
    """Lower case without any white space; null for an empty or null name."""
    n = F.regexp_replace(F.lower(name), r"\s+", "")
    return F.when(n != "", n)


def load(df: DataFrame, name: str, allow_repeats: bool = False) -> DataFrame:
    """name: distinct cleaned names. Repeats raise an error unless they are allowed."""
    counts = df.select(clean(C(name)).alias("name")).where("name is not null").groupBy("name").agg(F.count(lit(1)).alias("copies"))
    if allow_repeats:
        return counts
    checked = counts.withColumn("ok", F.assert_true(C("copies") == 1, F.concat(lit("duplicate name: "), C("name"))))
    return checked.where("ok is null").select("name", "copies")


def characters(names: DataFrame) -> DataFrame:
    """token, idx: the specials, then the characters in order."""
    chars = names.select(F.explode(F.split("name", "")).alias("token")).where("token <> ''").distinct()
    ranked = global_rank(chars, [F.asc("token")], "r").select("token", (C("r") + len(SPECIALS)).alias("idx"))
    base = names.sparkSession.createDataFrame([(t, i) for i, t in enumerate(SPECIALS)], "token string, idx bigint")
    return base.unionByName(ranked)


def encode(names: DataFrame, chars: DataFrame) -> DataFrame:
    """name, ids with begin and end marks; an unknown character is an error."""
    rows = names.select("name", F.posexplode(F.split("name", "")).alias("pos", "token")).where("token <> ''").join(chars, "token", "left")
    rows = rows.withColumn("idx", F.when(C("idx").isNull(), F.raise_error(F.concat(lit("unknown character: "), "token")).cast("bigint")).otherwise(C("idx")))
    ids = rows.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("pos", "idx"))).alias("x"))
    return ids.select("name", F.concat(F.array(lit(1).cast("long")), F.transform("x", lambda s: s["idx"]), F.array(lit(2).cast("long"))).alias("ids"))


def decode(encoded: DataFrame, chars: DataFrame) -> DataFrame:
    """name, decoded: up to the end mark, without pad and begin marks."""
    rows = encoded.select("name", F.posexplode("ids").alias("pos", "idx"))
    end = encoded.select("name", F.array_position("ids", lit(2).cast("long")).alias("end"))
    kept = rows.join(end, "name").where("pos < end - 1 and idx > 1").join(chars, "idx")
    text = kept.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), "").alias("decoded"))
    return encoded.select("name").join(text, "name", "left").select("name", F.coalesce("decoded", lit("")).alias("decoded"))


def sample_metrics(samples: DataFrame, known: DataFrame) -> DataFrame:
    """generated, unique, novel, novelty_rate, diversity, average_length of generated names (column name)."""
    s = samples.where("name is not null")
    counts = s.groupBy("name").agg(F.count(lit(1)).alias("n"))
    marked = counts.join(known.select("name").distinct().withColumn("known", lit(1)), "name", "left")
    r = marked.agg(F.coalesce(F.sum("n"), lit(0)).alias("generated"), F.count(lit(1)).alias("unique"), F.coalesce(F.sum(F.when(C("known").isNull(), C("n"))), lit(0)).alias("novel"), F.coalesce(F.sum(C("n") * F.length("name")), lit(0)).alias("chars"))
    per = lambda a: F.coalesce(F.try_divide(C(a), C("generated")), lit(0.0))
    return r.select("generated", "unique", "novel", per("novel").alias("novelty_rate"), per("unique").alias("diversity"), per("chars").alias("average_length"))


def failure_modes(samples: DataFrame, known: DataFrame, short: int = 3, long: int = 13) -> DataFrame:
    """copied, repeats, short, long, stutters: names of the known list, repeated names, lengths, and runs of three equal characters."""
    counts = samples.where("name is not null").groupBy("name").agg(F.count(lit(1)).alias("n"))
    m = counts.join(known.select("name").distinct().withColumn("known", lit(1)), "name", "left")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, C("n"))), lit(0))
    n = F.length("name")
    return m.agg(total(C("known") == 1).alias("copied"), F.coalesce(F.sum(C("n") - 1), lit(0)).alias("repeats"), total(n <= short).alias("short"), total(n >= long).alias("long"), total(C("name").rlike(r"(.)\1\1")).alias("stutters"))


def failure_lines(modes: DataFrame) -> DataFrame:
    """line: one sentence per failure that occurs, or one that says none does."""
    texts = (("copied", "names copied from the training list"), ("repeats", "repeated names"), ("short", "very short names"), ("long", "very long names"), ("stutters", "names with a character three times in a row"))
    lines = F.array(*[F.when(C(k) > 0, F.concat(C(k).cast("string"), lit(f" {t}"))) for k, t in texts])
    some = F.filter(lines, lambda x: x.isNotNull())
    return modes.select(F.explode(F.when(F.size(some) > 0, some).otherwise(F.array(lit("no failure found")))).alias("line"))


def markov_counts(names: DataFrame, order: int = 2) -> DataFrame:
    """state, next, n: transitions of a character model of the given order over marked names."""
    chars = F.concat(F.array_repeat(lit("^"), order), F.filter(F.split("name", ""), lambda c: c != ""), F.array(lit("$")))
    rows = names.select(chars.alias("c"))
    at = rows.select("c", F.explode(F.sequence(lit(1), F.size("c") - order)).alias("k"))
    pairs = at.select(F.array_join(F.slice("c", C("k"), lit(order)), "").alias("state"), F.element_at("c", C("k") + order).alias("next"))
    return pairs.groupBy("state", "next").agg(F.count(lit(1)).alias("n"))


def generate(names: DataFrame, count: int, temperature: float = 0.85, order: int = 2, longest: int = 24, seed: int = 42, tries: int = 12) -> DataFrame:
    """sample_no, name: names drawn from the character model, which stands in for the recurrent networks.

    The model's table is bounded by the alphabet to the power of order + 1. Each sample draws by a hash of seed and number.
    """
    table: dict[str, tuple[list[str], list[float]]] = {}
    for r in markov_counts(names, order).orderBy("state", "next").collect():
        table.setdefault(r.state, ([], []))
        table[r.state][0].append(r.next)
        table[r.state][1].append(float(r.n) ** (1 / temperature))
    spark = names.sparkSession
    shared = spark.sparkContext.broadcast(table)

    def draw(batches):
        import numpy as np
        import pandas as pd

        table = shared.value
        for pdf in batches:
            out = []
            for k in pdf["id"]:
                g, name = np.random.default_rng([seed, int(k)]), ""
                for _ in range(tries):
                    state, name = "^" * order, ""
                    while len(name) < longest and state in table:
                        chars, w = table[state]
                        c = chars[int(g.choice(len(chars), p=np.array(w) / sum(w)))]
                        if c == "$":
                            break
                        name += c
                        state = (state + c)[-order:]
                    if name:
                        break
                out.append((k, name))
            yield pd.DataFrame(out, columns=["sample_no", "name"])

    return spark.range(count).mapInPandas(draw, "sample_no bigint, name string")


def best_models(results: DataFrame) -> DataFrame:
    """most_novel, most_diverse, lowest_loss: names of the models that lead; the first by name wins ties."""
    lead = lambda c, sign: F.min_by("model", F.struct(sign * C(c), "model"))
    return results.agg(lead("novelty_rate", -1).alias("most_novel"), lead("diversity", -1).alias("most_diverse"), lead("train_loss", 1).alias("lowest_loss"))

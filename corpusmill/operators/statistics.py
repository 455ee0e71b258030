"""Corpus statistics, audits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusmill.functions import rules as R

C, lit = F.col, F.lit


def length_stats(df: DataFrame, tokens: str) -> DataFrame:
    """sequences, total_tokens, vocabulary, mean_length (2 places), median_length (exact)."""
    n = F.size(tokens)
    base = df.select(n.alias("n")).agg(F.count(lit(1)).alias("sequences"), F.coalesce(F.sum("n"), lit(0)).alias("total_tokens"), F.round(F.avg("n"), 2).alias("mean_length"), F.median("n").alias("median_length"))
    words = df.select(F.explode(tokens).alias("t")).distinct().agg(F.count(lit(1)).alias("vocabulary"))
    return base.join(F.broadcast(words)).select("sequences", "total_tokens", "vocabulary", "mean_length", "median_length")


def top_tokens(df: DataFrame, tokens: str, k: int) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(lit(1)).alias("count")).orderBy(F.desc("count"), "token").limit(k)


def grouped_counts(df: DataFrame, *cols: str) -> DataFrame:
    """kind, value, rows: counts by each of the columns."""
    pairs = F.explode(F.array(*[F.struct(lit(c).alias("kind"), F.coalesce(C(c).cast("string"), lit("")).alias("value")) for c in cols])).alias("x")
    return df.select(pairs).groupBy("x.kind", "x.value").agg(F.count(lit(1)).alias("rows"))


def dataset_json(df: DataFrame, tokens: str, k: int = 25) -> DataFrame:
    """stats: one JSON object of totals and the top tokens."""
    top = top_tokens(df, tokens, k).agg(F.sort_array(F.collect_list(F.struct((-C("count")).alias("o"), "token", "count"))).alias("x"))
    named = F.transform("x", lambda r: F.struct(r["token"].alias("token"), r["count"].alias("count"))).alias("top_tokens")
    return length_stats(df, tokens).join(F.broadcast(top)).select(F.to_json(F.struct("sequences", "total_tokens", "vocabulary", "mean_length", "median_length", named)).alias("stats"))


def rule_audit(spark) -> DataFrame:
    """table_name, position, rule: every rule table in force."""
    rows = []
    for name, table in sorted(vars(R).items()):
        if name.isupper() and isinstance(table, (tuple, dict)):
            items = sorted(table.items()) if isinstance(table, dict) else table
            rows += [(name, i, str(x)) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, "table_name string, position bigint, rule string")


def learned_audit(phrases: DataFrame, exclusions: DataFrame, most: int = 100) -> DataFrame:
    """table_name, position, rule: the `most` strongest phrases and most frequent excluded tokens."""
    w = lambda *o: F.row_number().over(Window.orderBy(*o)) - 1  # noqa: E731 - over `most` rows
    top = phrases.orderBy(F.desc("score"), F.desc("count"), "phrase").limit(most).select(lit("phrases").alias("table_name"), w(F.desc("score"), F.desc("count"), "phrase").cast("long").alias("position"), C("phrase").alias("rule"))
    gone = exclusions.orderBy(F.desc("count"), "token").limit(most).select(lit("exclusions").alias("table_name"), w(F.desc("count"), "token").cast("long").alias("position"), C("token").alias("rule"))
    return top.unionByName(gone)


def manifest(df: DataFrame, metadata: list[str]) -> DataFrame:
    """path-ready manifest: one row per document with its metadata; the total stands in each row so that no group is collected."""
    total = df.agg(F.count(lit(1)).alias("total_documents"))
    return df.select(*metadata).join(F.broadcast(total))


def report(metrics: list[dict]) -> str:
    """Markdown table of model metrics."""
    cols = list(metrics[0]) if metrics else []
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)] if cols else ["No results."]
    return "\n".join(lines + ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in m.values()) + " |" for m in metrics]) + "\n"

"""Operators on token sequences: windows, sampling, packing, pairs, merges, prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T_

from corpusmill.functions import rules as R, text as T

C, lit = F.col, F.lit


def adjacent_pairs(df: DataFrame, tokens: str) -> DataFrame:
    """left, right of every two neighbouring tokens of a row."""
    n = F.size(tokens)
    pairs = F.arrays_zip(F.slice(C(tokens), lit(1), F.greatest(n - 1, lit(0))).alias("left"), F.slice(C(tokens), lit(2), F.greatest(n - 1, lit(0))).alias("right"))
    return df.where(n >= 2).select(F.explode(pairs).alias("p")).select("p.left", "p.right")


def overlapping_windows(tokens: Column, size: int = R.MAX_SEGMENT_TOKENS, overlap: int = R.SEGMENT_OVERLAP_TOKENS, least: int = R.MIN_SEGMENT_TOKENS) -> Column:
    """Array of overlapping windows; a sequence of at most `size` tokens is one window. Stops with the window that reaches the
    end, or before one of fewer than `least` tokens."""
    n, stride = F.size(tokens), max(1, size - overlap)
    starts = F.filter(F.sequence(lit(0), F.greatest(n - 1, lit(0)), lit(stride)), lambda s: (s == 0) | ((s - stride + size < n) & (n - s >= least)))
    return F.when(n <= size, F.array(tokens)).otherwise(F.transform(starts, lambda s: F.slice(tokens, s + 1, lit(size))))


def segment_limit(doc_type: Column) -> Column:
    """Most segments of a document, by its type."""
    out = lit(R.MAX_SEGMENTS_PER_DOCUMENT)
    for k, v in R.SEGMENT_LIMITS.items():
        out = F.when(doc_type == k, v).otherwise(out)
    return out


def even_sample(items: Column, most: int | Column = R.MAX_SEGMENTS_PER_DOCUMENT) -> Column:
    """At most `most` elements, evenly spread, then distinct in order."""
    n, m = F.size(items), lit(most) if isinstance(most, int) else most
    picks = F.transform(F.sequence(lit(0), m - 1), lambda i: F.element_at(items, (F.least(F.floor(i * n / m), n - 1) + 1).cast("int")))
    return F.when(n <= m, items).otherwise(F.array_distinct(picks))


def pack(sequences: list[list[str]], valid, target: int = R.TARGET_SEGMENT_TOKENS, most: int = R.MAX_SEGMENT_TOKENS, carry: int = R.SEGMENT_OVERLAP_TOKENS, least: int = R.MIN_SEGMENT_TOKENS) -> list[list[str]]:
    """Short sequences gathered to about `target` tokens with `carry` tokens kept over; long ones cut into windows.

    All tokens are laid out in one row, and segments are stretches of it: an open stretch grows by whole short sequences, closes
    when it has `target` tokens, and the next one begins `carry` tokens before its end. A sequence of `target` or more closes the open
    stretch and is cut on its own, without carrying over. A stretch that would outgrow `most` is closed before; if it carries no signal nothing is carried
    over. `valid` tells whether a stretch of at least `least` tokens carries signal.
    """
    row = [t for s in sequences for t in s]
    stretches: list[tuple[int, int]] = []
    begin = end = 0
    good = lambda i, j: j - i >= least and valid(row[i:j])
    for size in map(len, sequences):
        if size >= target:
            cuts = range(end, end + max(1, size - (most - max(1, most - carry))), max(1, most - carry))
            stretches += [(begin, end), *((i, min(i + most, end + size)) for i in cuts)]
            begin = end = end + size
        elif size:
            if begin < end and end + size - begin > most:
                stretches.append((begin, end))
                begin = max(begin, end - carry) if good(begin, end) else end
            end += size
            if end - begin >= target:
                stretches.append((begin, end))
                begin = max(begin, end - carry)
    stretches.append((begin, end))
    return [row[i:j] for i, j in stretches if good(i, j)]


def carries_signal(x: list[str]) -> bool:
    """Counterpart of the column predicate `is_low_signal`, for the ordered fold."""
    import re

    n, distinct = len(x), len(set(x)) / max(1, len(x))
    count = lambda words: sum(t in words for t in x)
    degree, anchor = count(R.DEGREE_HINTS), count(R.ANCHORS)
    codes = sum(bool(re.match(R.COURSE_CODE, t)) for t in x)
    roster = codes >= 2 or (degree >= 4 and count(R.ROSTER_MARKERS) >= 1) or (degree >= 5 and anchor <= 2) or (degree >= 4 and distinct >= 0.72 and anchor <= 4)
    h = count(R.ANNOUNCEMENT_HINTS)
    return not (n < R.MIN_SEGMENT_TOKENS or roster or (n <= 20 and h >= 3) or (n <= 36 and h >= max(4, n // 4)) or h >= max(6, n // 3) or (n >= 20 and distinct < 0.3))


def pack_rows(df: DataFrame, sequences: str, name: str) -> DataFrame:
    """`df` with its array of sequences replaced by `name`, the packed segments, distinct within the row and in its order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = (pack([list(x) for x in (seqs if seqs is not None else [])], carries_signal) for seqs in pdf[sequences])
            rows = [[list(t) for t in dict.fromkeys(map(tuple, x))] for x in found]
            yield pdf.drop(columns=[sequences]).assign(**{name: pd.Series(rows, index=pdf.index, dtype=object)})

    schema = T_.StructType([*(f for f in df.schema.fields if f.name != sequences), T_.StructField(name, T_.ArrayType(T_.ArrayType(T_.StringType())))])
    return df.mapInPandas(run, schema)


def pack_documents(df: DataFrame, key: str, sequences: str) -> DataFrame:
    """key, segment_index, tokens: the segments of `pack_rows`, one row each; nothing is shuffled."""
    rows = pack_rows(df.select(key, sequences), sequences, "_s").select(key, F.posexplode("_s").alias("i", "tokens"))
    return rows.select(key, C("i").cast("long").alias("segment_index"), "tokens")


def learn_phrases(df: DataFrame, tokens: str, min_count: int = R.PHRASE_MIN_COUNT, min_unigram: int = R.PHRASE_MIN_UNIGRAM, min_other: int = R.PHRASE_MIN_OTHER, min_score: float = R.PHRASE_MIN_SCORE, most: int = R.PHRASE_LIMIT, seeds=R.PHRASE_SEEDS) -> DataFrame:
    """left, right, phrase, count, score of the strongest pairs: (count - min_count + 1) * N / (count(left) * count(right))."""
    words = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(lit(1)).alias("n"))
    total = words.agg(F.coalesce(F.sum("n"), lit(0)).alias("total"))
    pairs = adjacent_pairs(df, tokens).where(T.phrase_pair(C("left"), C("right"), seeds)).groupBy("left", "right").agg(F.count(lit(1)).alias("count")).where(C("count") >= min_count)
    side = lambda c: F.when(C(c).isin(*seeds), min_unigram).otherwise(max(min_other, min_unigram)) if seeds else lit(min_unigram)
    joined = pairs.join(words.select(C("token").alias("left"), C("n").alias("nl")), "left").join(words.select(C("token").alias("right"), C("n").alias("nr")), "right").join(F.broadcast(total))
    score = (C("count") - min_count + 1) * C("total") / (C("nl") * C("nr"))
    kept = joined.where((C("nl") >= side("left")) & (C("nr") >= side("right"))).withColumn("score", score).where(C("score") >= min_score)
    return kept.select("left", "right", F.concat_ws("_", "left", "right").alias("phrase"), "count", "score").orderBy(F.desc("score"), F.desc("count"), "phrase").limit(most)


def merge_rows(df: DataFrame, tokens: str, phrases: DataFrame, name: str = "merged") -> DataFrame:
    """`df` with `name`, a struct of arrays: token, pos (place of a token's first part) and joined (whether it is a phrase), after pairs of
    `phrases` are joined greedily from the left. Works within the row.

    The phrases are a top list (`learn_phrases` puts out at most `most`) and go to every task.
    """
    table = {(r.left, r.right): r.phrase for r in phrases.select("left", "right", "phrase").collect()}
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("struct<token: array<string>, pos: array<bigint>, joined: array<boolean>>")
    def run(rows: pd.Series) -> pd.DataFrame:
        pairs = shared.value
        lefts = {a for a, _ in pairs}
        out = []
        for r in rows:
            toks, pos, joined, skip = [], [], [], False
            n = 0 if r is None else len(r)
            for i in range(n):
                if skip:
                    skip = False
                    continue
                p = pairs.get((r[i], r[i + 1])) if i + 1 < n and r[i] in lefts else None
                skip = p is not None
                toks.append(p if skip else r[i])
                pos.append(i)
                joined.append(skip)
            out.append((toks, pos, joined))
        return pd.DataFrame(out, columns=["token", "pos", "joined"])

    return df.withColumn(name, run(C(tokens)))


def merge_phrases(df: DataFrame, key: str, tokens: str, phrases: DataFrame) -> DataFrame:
    """key, pos, token, merged: one row per token after `merge_rows`."""
    rows = merge_rows(df.select(key, tokens), tokens, phrases, "_m").select(key, F.explode(F.arrays_zip("_m.pos", "_m.token", "_m.joined")).alias("x"))
    return rows.select(key, "x.pos", "x.token", C("x.joined").alias("merged"))


def exclusion_tokens(df: DataFrame, tokens: str, term_ratio: float = R.DROP_TERM_RATIO, sequence_ratio: float = R.DROP_SEQUENCE_RATIO, forced=R.FORCED_DROPS, protected=R.PROTECTED_TOKENS) -> DataFrame:
    """token, count, frequency_ratio, document_ratio of tokens to leave out of training: forced, or frequent both among tokens and
    sequences; protected tokens never."""
    occurrences = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(lit(1)).alias("count"))
    within = df.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(lit(1)).alias("sequences"))
    total = df.agg(F.coalesce(F.sum(F.greatest(F.size(tokens), lit(0))), lit(0)).alias("total"), F.count(lit(1)).alias("rows"))
    r = occurrences.join(within, "token").join(F.broadcast(total))
    tf, sf = C("count") / F.greatest(C("total"), lit(1)), C("sequences") / F.greatest(C("rows"), lit(1))
    r = r.select("token", "count", tf.alias("frequency_ratio"), sf.alias("document_ratio"))
    drop = C("token").isin(*forced) | ((C("frequency_ratio") >= term_ratio) & (C("document_ratio") >= sequence_ratio))
    return r.where(drop & ~C("token").isin(*protected))


def remove_tokens(df: DataFrame, tokens: str, gone: DataFrame) -> DataFrame:
    """`df` without the tokens of `gone` in its rows, repeats of others kept.

    `gone` is bounded: of tokens over a share r of all there are at most 1 / r, and the forced ones are a list.
    """
    words = sorted(r.token for r in gone.select("token").distinct().collect())
    return df.withColumn(tokens, F.filter(tokens, lambda t: ~t.isin(*words))) if words else df


def context_pairs(df: DataFrame, tokens: str, window: int, key: str | None = None, seed: int | None = None) -> DataFrame:
    """center, context of every pair within the window. With a seed the radius of a position is 1..window by hash of (seed,
    key, position); without, it is the window."""
    n = F.size(tokens)
    at = df.where(n > 1).select(*([key] if key else []), C(tokens).alias("t"), F.posexplode(tokens).alias("p", "center"))
    radius = lit(window) if seed is None else (T.hash32(lit(str(seed)), C(key).cast("string"), C("p").cast("string")) % window + 1).cast("int")
    at = at.withColumn("r", radius)
    near = F.filter(F.sequence(F.greatest(C("p") - C("r"), lit(0)), F.least(C("p") + C("r"), F.size("t") - 1)), lambda i: i != C("p"))
    return at.select("center", F.explode(near).alias("i"), "t").select("center", F.element_at("t", C("i") + 1).alias("context"))


def example_count(n: Column, window: int) -> tuple[Column, Column]:
    """(skip-gram pairs, CBOW positions) of a sequence of n tokens, in closed form."""
    w = F.least(lit(window), n - 1)
    pairs = F.when(n > 1, (2 * n * w - w * (w + 1)).cast("long")).otherwise(lit(0).cast("long"))
    return pairs, F.when(n > 1, n.cast("long")).otherwise(lit(0).cast("long"))


def prefixes(df: DataFrame, text: str) -> DataFrame:
    """name, prefix, next: every prefix of the characters with begin and end marks, and the character that follows."""
    chars = F.concat(F.array(lit("<bos>")), F.filter(F.split(text, ""), lambda c: c != ""), F.array(lit("<eos>")))
    rows = df.select(C(text).alias("name"), chars.alias("c"))
    at = rows.select("name", "c", F.explode(F.sequence(lit(1), F.size("c") - 1)).alias("k"))
    return at.select("name", F.array_join(F.slice("c", lit(1), C("k")), " ").alias("prefix"), F.element_at("c", C("k") + 1).alias("next"))


def first_distinct(df: DataFrame, value: str, order: str, most: int = 12) -> DataFrame:
    """The first `most` distinct values in arrival order, with the position of each."""
    return df.where(C(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first_at")).orderBy("first_at", value).limit(most)

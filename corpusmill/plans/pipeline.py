"""Documents to training segments: narrow per-document work between two global aggregates and a global dedup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import rules as R, text as T
from corpusmill.operators import cleaning, dedup, filters, sequences
from corpusmill.session import materialize

C, lit = F.col, F.lit


@dataclass(frozen=True)
class Result:
    """segments: key, segment_index, tokens, phrase_merges; phrases, exclusions: learned tables; reasons: document counts."""

    segments: DataFrame
    phrases: DataFrame
    exclusions: DataFrame
    reasons: DataFrame


def token_sequences(cleaned: Column, doc_type: Column) -> Column:
    """Sequences of the sentences of the paragraphs that pass the rule."""
    kept = F.filter(F.split(cleaned, r"\n{2,}"), lambda p: (F.btrim(p) != "") & ~T.drop_corpus_paragraph(p, doc_type))
    units = F.flatten(F.transform(kept, T.sentences))
    return F.filter(F.transform(units, T.normalized_tokens), lambda s: ~T.skip_sequence(s))


def candidate_segments(docs: DataFrame, key: str, text: str, doc_type: str, title: str) -> DataFrame:
    """key, segment_index, tokens: cleaned, tokenized, packed, distinct and evenly sampled segments of each document."""
    cleaned = docs.select(key, C(doc_type).alias("_type"), C(title).alias("_title"), cleaning.clean_corpus(C(text)).alias("_clean"))
    seqs = cleaned.withColumn("_seqs", token_sequences(C("_clean"), C("_type"))).withColumn("_head", T.title_tokens(C("_title")))
    head = F.when(T.use_title(C("_type"), C("_head"), C("_title")), F.array("_head")).otherwise(F.array().cast("array<array<string>>"))
    packed = sequences.pack_rows(seqs.select(key, "_type", F.concat(head, C("_seqs")).alias("seqs")), "seqs", "s")
    most = sequences.segment_limit(F.coalesce("_type", lit("")))
    return packed.select(key, F.posexplode(sequences.even_sample(C("s"), most)).alias("segment_index", "tokens"))


def build(docs: DataFrame, key: str, text: str, doc_type: str, title: str, url: str | None = None, lang: str | None = None, reexpand: bool = False, min_phrase_count: int = R.PHRASE_MIN_COUNT, term_ratio: float = R.DROP_TERM_RATIO) -> Result:
    """The whole corpus builder. With `reexpand` merged phrases outside the list of compounds are split again."""
    address = C(url) if url else lit(None).cast("string")
    judged = docs.withColumn("_reason", filters.corpus_reason(C(doc_type), C(title), address, C(text), C(lang) if lang else None))
    first = materialize(candidate_segments(judged.where("_reason = 'kept'"), key, text, doc_type, title).withColumn("_id", F.concat_ws("#", C(key).cast("string"), C("segment_index").cast("string"))))
    valid = first.select(key).distinct().withColumn("_has", lit(True))
    why = judged.select(key, "_reason").join(valid, key, "left").select(F.when((C("_reason") == "kept") & C("_has").isNull(), "no_valid_segments").otherwise(C("_reason")).alias("reason"))
    phrases = materialize(sequences.learn_phrases(first, "tokens", min_count=min_phrase_count))
    merged = sequences.merge_rows(first, "tokens", phrases)
    toks = F.flatten(F.transform("merged.token", lambda t: T.expand(t))) if reexpand else C("merged.token")
    count = F.size(F.filter("merged.joined", lambda x: x)).cast("long")
    second = materialize(merged.select("_id", key, "segment_index", toks.alias("tokens"), count.alias("phrase_merges")))
    gone = sequences.exclusion_tokens(second, "tokens", term_ratio=term_ratio)
    final = sequences.remove_tokens(second, "tokens", gone).where(~T.is_low_signal(C("tokens")))
    unique = dedup.segments_by_hash(final, "tokens", [key, "segment_index"]).select(key, "segment_index", "tokens", "phrase_merges", "copies")
    return Result(unique, phrases, gone, why.groupBy("reason").agg(F.count(lit(1)).alias("documents")))

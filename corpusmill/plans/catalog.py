"""All queries of the core and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.functions import rules as R, text as T, url as U
from corpusmill.operators import cleaning, crawl, dedup, embedding, filters, html, names, ranking, recurrent, sequences, similarity, statistics, vocabulary
from corpusmill.plans import oracle_parts as S, pipeline
from corpusmill.session import materialize, read_table, spread
from corpusmill.sources import readers

C, lit = F.col, F.lit
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MIN_COUNT = 5


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """id, url, title, doc_type, department, lang, content: one row per record; repeats carry the same values."""
    m = read_table(spark, d, "crawldoc").where("metadata.id is not null")
    flat = spread(m).select(C("metadata.id").alias("id"), C("metadata.source_url").alias("url"), *[C(f"metadata.{k}").alias(k) for k in ("title", "doc_type", "department")], C("declared_lang").alias("lang"), "content", "ingested_at")
    return dedup.without_repeats(flat).drop("ingested_at")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "textsegment").where("segment_id is not null and text is not null")
    first = s.groupBy("segment_id").agg(F.min("text").alias("text"))
    return first.select("segment_id", F.split("text", " ").alias("t"))


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.build(_segments(spark, d), "t", MIN_COUNT)


# ---- tokens, counts, vocabulary ----


@query(f"""
with d as (select doc_id, list_filter({S.tokens('text')}, lambda y: not {S.noise('y')}) as t from documents),
o as (select doc_id, unnest(t) as token from d),
c as (select token, count(*) as count, count(distinct doc_id) as documents from o group by 1),
n as (select (select sum(count) from c) as total, (select count(*) from d) as docs)
select token, count::bigint as count, documents::bigint as documents, round(count / total, 6) as frequency_ratio, round(documents / docs, 6) as document_ratio,
  (token in {S.words(R.FORCED_DROPS)} or (count / total >= 0.004 and documents / docs >= 0.08)) and token not in {S.words(R.PROTECTED_TOKENS)} as dropped
from c, n order by count desc, token limit 25""")
def corpus_top_tokens(spark, d):
    t = _docs(spark, d).select("doc_id", F.filter(T.tokens(C("text")), lambda x: ~T.is_noise(x)).alias("t"))
    per = t.select("doc_id", F.explode("t").alias("token")).groupBy("token", "doc_id").agg(F.count(lit(1)).alias("n"))
    c = per.groupBy("token").agg(F.sum("n").alias("count"), F.count(lit(1)).alias("documents"))
    total = t.agg(F.sum(F.size("t")).alias("total"), F.count(lit(1)).alias("docs"))
    r = c.orderBy(F.desc("count"), "token").limit(25).join(F.broadcast(total))
    tf, df = C("count") / C("total"), C("documents") / C("docs")
    drop = (C("token").isin(*R.FORCED_DROPS) | ((tf >= R.DROP_TERM_RATIO) & (df >= R.DROP_SEQUENCE_RATIO))) & ~C("token").isin(*R.PROTECTED_TOKENS)
    return r.select("token", "count", "documents", F.round(tf, 6).alias("frequency_ratio"), F.round(df, 6).alias("document_ratio"), drop.alias("dropped"))


@query(f"""
with {S.SEGMENTS}, o as (select segment_id, unnest(t) as token from seg), c as (select token, count(*) as count, count(distinct segment_id) as k from o group by 1),
n as (select (select sum(len(t)) from seg) as total, (select count(*) from seg) as rows)
select token, count::bigint as count, round(count / total, 6) as frequency_ratio, round(k / rows, 6) as document_ratio from c, n
where (token in {S.words(R.FORCED_DROPS)} or (count / total >= 0.004 and k / rows >= 0.08)) and token not in {S.words(R.PROTECTED_TOKENS)}""")
def token_exclusions(spark, d):
    r = sequences.exclusion_tokens(_segments(spark, d), "t")
    return r.select("token", "count", F.round("frequency_ratio", 6).alias("frequency_ratio"), F.round("document_ratio", 6).alias("document_ratio"))


_PAIRS = f"""with {S.SEGMENTS}, w as (select unnest(t) as token from seg), u as (select token, count(*) as n from w group by 1), tot as (select sum(n) as total from u),
pr as (select t[i] as "left", t[i + 1] as "right" from (select t, unnest(range(1, len(t))) as i from seg)),
pc as (select "left", "right", count(*) as count from pr where {' and '.join(f'''"{x}" not in {S.words(R.STOP_WORDS + R.NOISE_TOKENS)} and not contains("{x}", '_') and length("{x}") >= 3 and not regexp_matches("{x}", '[0-9]')''' for x in ('left', 'right'))} group by 1, 2 having count(*) >= 8),
ph as (select "left", "right", "left" || '_' || "right" as phrase, count, (count - 7) * total / (a.n * b.n) as score from pc join u a on a.token = "left" join u b on b.token = "right", tot
       where a.n >= 20 and b.n >= 20 and (count - 7) * total / (a.n * b.n) >= 8 order by score desc, count desc, phrase limit 200)"""


def _phrases(spark, d):
    return sequences.learn_phrases(_segments(spark, d), "t", seeds=())


@query(_PAIRS.replace("a.n >= 20 and b.n >= 20", "a.n >= 10 and b.n >= 10") + ' select "left", "right", phrase, count::bigint as count, round(score, 6) as score from ph')
def bigram_phrases(spark, d):
    return _phrases(spark, d).withColumn("score", F.round("score", 6))


@query(f"""{_PAIRS.replace("length(", "length(").replace("a.n >= 20 and b.n >= 20", f"a.n >= (case when \"left\" in {S.words(R.PHRASE_SEEDS)} then 10 else 20 end) and b.n >= (case when \"right\" in {S.words(R.PHRASE_SEEDS)} then 10 else 20 end) and (\"left\" in {S.words(R.PHRASE_SEEDS)} or \"right\" in {S.words(R.PHRASE_SEEDS)})")}
 select phrase, count::bigint as count, round(score, 6) as score from ph""")
def seeded_phrases(spark, d):
    return sequences.learn_phrases(_segments(spark, d), "t").select("phrase", "count", F.round("score", 6).alias("score"))


@query(f"""{_PAIRS.replace("a.n >= 20 and b.n >= 20", "a.n >= 10 and b.n >= 10")},
x as (select segment_id, unnest(t) as token, generate_subscripts(t, 1) - 1 as pos from seg),
y as (select *, lead(token) over (partition by segment_id order by pos) as nxt from x),
z as (select y.*, ph.phrase from y left join ph on ph."left" = y.token and ph."right" = y.nxt),
i as (select *, pos - sum(case when phrase is not null then 1 else 0 end) over (partition by segment_id order by pos) as isl from z),
k as (select *, phrase is not null and row_number() over (partition by segment_id, case when phrase is not null then isl end order by pos) % 2 = 1 as start from i),
e as (select *, coalesce(lag(start) over (partition by segment_id order by pos), false) as eaten from k)
select segment_id, pos::bigint as pos, case when start then phrase else token end as token, start as merged from e where not eaten""")
def bigram_merge(spark, d):
    return sequences.merge_phrases(_segments(spark, d), "segment_id", "t", _phrases(spark, d))


@query(f"{S.VOCAB} select token, count::bigint as count, token_id::bigint as token_id from voc")
def vocabulary_ids(spark, d):
    return _vocab(spark, d)


@query(f"""{S.VOCAB}, x as (select segment_id, unnest(t) as token, generate_subscripts(t, 1) as pos from seg),
e as (select segment_id, list(token_id order by pos) as ids from x join voc using (token) group by 1) select segment_id, array_to_string(ids, ' ') as ids, len(ids)::bigint as n from e where len(ids) >= 2""")
def encode_corpus(spark, d):
    e = vocabulary.encode(_segments(spark, d), "segment_id", "t", _vocab(spark, d))
    return e.select("segment_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), F.size("ids").cast("long").alias("n"))


@query(f"{S.VOCAB}, s as (select sum(count) as total from voc) select token, count::bigint as count, round(least(1, sqrt(0.001 / (count / total)) + 0.001 / (count / total)), 6) as keep from voc, s")
def keep_probability(spark, d):
    return vocabulary.keep_probability(_vocab(spark, d), 1e-3).withColumn("keep", F.round("keep", 6))


@query(f"{S.VOCAB}, s as (select sum(count) as total from voc) select sum(count)::bigint as total, round(sum(count * least(1, sqrt(0.001 / (count / s.total)) + 0.001 / (count / s.total))), 3) as retained from voc, s")
def expected_retained(spark, d):
    return vocabulary.expected_retained(_vocab(spark, d), 1e-3).withColumn("retained", F.round("retained", 3))


@query(f"{S.VOCAB}, s as (select sum(pow(count, 0.75)) as w from voc) select token, token_id::bigint as token_id, round(pow(count, 0.75) / w, 8) as probability from voc, s")
def noise_distribution(spark, d):
    return vocabulary.noise_distribution(_vocab(spark, d)).withColumn("probability", F.round("probability", 8))


_CONTEXT = f"""with {S.SEGMENTS}, x as (select segment_id, t, unnest(t) as center, generate_subscripts(t, 1) as p from seg where len(t) > 1),
y as (select segment_id, t, center, p, %s as r from x), z as (select center, t, p, unnest(range(greatest(1, p - r), least(len(t), p + r) + 1)) as q from y)
select center, t[q] as context, count(*)::bigint as pairs from z where q <> p group by 1, 2 having count(*) >= 20"""


@query(_CONTEXT % "2")
def context_pairs(spark, d):
    p = sequences.context_pairs(_segments(spark, d), "t", 2)
    return p.groupBy("center", "context").agg(F.count(lit(1)).alias("pairs")).where("pairs >= 20")


@query(_CONTEXT % f"({S.hash32(chr(39) + '7' + chr(39), 'segment_id', '(p - 1)::varchar')} % 5 + 1)")
def context_pairs_dynamic(spark, d):
    p = sequences.context_pairs(_segments(spark, d), "t", 5, "segment_id", 7)
    return p.groupBy("center", "context").agg(F.count(lit(1)).alias("pairs")).where("pairs >= 20")


@query(f"""with {S.SEGMENTS}, w as (select unnest([2, 5]) as w), x as (select w, len(t) as n, least(w, len(t) - 1) as m from seg, w)
select w::bigint as w, sum(case when n > 1 then 2 * n * m - m * (m + 1) else 0 end)::bigint as skipgram, sum(case when n > 1 then n else 0 end)::bigint as cbow from x group by 1""")
def training_example_count(spark, d):
    s = _segments(spark, d).select(F.size("t").alias("n"), F.explode(F.array(lit(2).cast("long"), lit(5).cast("long"))).alias("w"))
    parts = [(w, *sequences.example_count(C("n"), w)) for w in (2, 5)]
    pairs = F.when(C("w") == 2, parts[0][1]).otherwise(parts[1][1])
    return s.groupBy("w").agg(F.sum(pairs).alias("skipgram"), F.sum(parts[0][2]).alias("cbow"))


@query(f"""{S.VOCAB}, s as (select sum(count) as total from voc), x as (select segment_id, unnest(t) as token, generate_subscripts(t, 1) - 1 as pos from seg),
k as (select x.*, least(1, sqrt(0.001 / (count / total)) + 0.001 / (count / total)) as keep from x join voc using (token), s)
select segment_id, string_agg(token, ' ' order by pos) as kept, count(*)::bigint as n from k where {S.hash32(chr(39) + '3' + chr(39), 'segment_id', 'pos::varchar')} / 4294967296.0 <= keep group by 1 having count(*) >= 2""")
def subsampled_segments(spark, d):
    r = vocabulary.subsample(_segments(spark, d), "segment_id", "t", _vocab(spark, d), 1e-3, 3)
    return r.select("segment_id", F.array_join("tokens", " ").alias("kept"), F.size("tokens").cast("long").alias("n"))


@query(f"""with {S.SEGMENTS}, h as (select segment_id, row_number() over (order by {S.hash32(chr(39) + '42' + chr(39), 'segment_id')}, segment_id) as k, count(*) over () as n from seg)
select segment_id, k <= greatest(1, round_even(n * 0.05, 0)) as validation from h""")
def train_validation_split(spark, d):
    return vocabulary.split_validation(_segments(spark, d), "segment_id", 42).select("segment_id", "validation")


@query(f"""{S.VOCAB} select token, count::bigint as count from voc where count < 6 or (length(token) <= 2 and token not in ('ai', 'ug', 'pg', 'it')) or length(token) > 24 or regexp_matches(token, '[0-9]') or regexp_matches(token, '[&/+]') or (contains(token, '_') and token not in ('machine_learning', 'deep_learning'))""")
def analysis_exclusions(spark, d):
    return vocabulary.analysis_exclusions(_vocab(spark, d)).select("token", "count")


@query(f"""{S.VOCAB}, s as (select sum(pow(count, 0.75)) as w from voc), n as (select token, token_id, greatest(1, round(pow(count, 0.75) / w * 1099511627776.0))::bigint as w from voc, s),
r as (select *, (sum(w) over (order by token_id) - w)::bigint as lo from n), t as (select sum(w)::bigint as t from r),
d as (select token, draw, lo, w, floor({S.hash32(chr(39) + '42' + chr(39), 'token', 'draw::varchar')} / 4294967296.0 * (t - w))::bigint as u from r, t, (select unnest(range(5)) as draw)),
m as (select token, draw, u + case when u >= lo then w else 0 end as u from d)
select m.token, m.draw::bigint as draw, r.token_id::bigint as token_id from m asof join r on m.u >= r.lo""")
def negative_samples(spark, d):
    v = _vocab(spark, d)
    return vocabulary.negatives(v.select("token", C("token_id").alias("positive")), vocabulary.noise_distribution(v), "token", "positive", 5, 42)


# ---- statistics ----


@query(f"""with {S.SEGMENTS} select count(*)::bigint as sequences, sum(len(t))::bigint as total_tokens, round(avg(len(t)), 2) as mean_length, median(len(t)) as median_length,
(select count(distinct x) from (select unnest(t) as x from seg))::bigint as vocabulary from seg""")
def doc_length_stats(spark, d):
    return statistics.length_stats(_segments(spark, d), "t").select("sequences", "total_tokens", "mean_length", "median_length", "vocabulary")


@query(f"""with {S.RECORDS} select 'doc_type' as kind, coalesce(doc_type, '') as value, count(*)::bigint as rows from rec group by 2 union all select 'department', coalesce(department, ''), count(*)::bigint from rec group by 2""")
def grouped_counts(spark, d):
    return statistics.grouped_counts(_records(spark, d), "doc_type", "department")


@query(f"with {S.RECORDS} select coalesce(department, 'Institute') as department, count(*)::bigint as documents from rec group by 1 order by 2 desc, 1 limit 20")
def top_departments(spark, d):
    r = _records(spark, d).groupBy(F.coalesce("department", lit("Institute")).alias("department")).agg(F.count(lit(1)).alias("documents"))
    return r.orderBy(F.desc("documents"), "department").limit(20)


@query(f"""with {S.SEGMENTS}, o as (select unnest(t) as token from seg), c as (select token, count(*) as count from o group by 1), k as (select * from c order by count desc, token limit 25)
select '{{"sequences":' || (select count(*) from seg) || ',"total_tokens":' || (select sum(count) from c)::bigint || ',"vocabulary":' || (select count(*) from c) || ',"mean_length":' || (select round(avg(len(t)), 2) from seg) || ',"median_length":' || (select median(len(t)) from seg)
|| ',"top_tokens":[' || (select string_agg('{{"token":"' || token || '","count":' || count || '}}', ',' order by count desc, token) from k) || ']}}' as stats""")
def dataset_statistics(spark, d):
    return statistics.dataset_json(_segments(spark, d), "t")


@query()
def rule_audit(spark, d):
    """Every rule, and the top phrases and excluded tokens of the corpus."""
    s = _segments(spark, d)
    found = statistics.learned_audit(sequences.learn_phrases(s, "t", seeds=()), sequences.exclusion_tokens(s, "t"))
    return statistics.rule_audit(spark).unionByName(found)


# ---- duplicates and merging ----


@query("""with k as (select doc_id, case when length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) >= 20 then md5(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) end as content_key from documents)
select doc_id, content_key, content_key is not null and doc_id = min(doc_id) over (partition by content_key) as kept from k""")
def doc_dedup_exact(spark, d):
    return dedup.exact_duplicates(_docs(spark, d), "text", ["doc_id"]).select("doc_id", "content_key", "kept")


@query(f"""with {S.RECORDS}, k as (select case when length(trim(content, chr(32) || chr(9) || chr(10) || chr(13))) >= 20 then md5(trim(content, chr(32) || chr(9) || chr(10) || chr(13))) end as k, {S.dedup_url('url')} as u from rec)
select count(*)::bigint as rows, count(distinct k)::bigint as unique_content, count(distinct case when u is not null then u end)::bigint as unique_urls, count(*) filter (k is null)::bigint as too_short, (count(k) - count(distinct k))::bigint as duplicates_skipped from k""")
def duplicate_stats(spark, d):
    return dedup.duplicate_stats(_records(spark, d), "content", "url")


@query("""with k as (select segment_id, text, sha1(text) as segment_key from textsegment where text is not null)
select segment_key, min(segment_id) as segment_id, count(*)::bigint as copies from k group by 1""")
def segment_dedup_sha1(spark, d):
    s = read_table(spark, d, "textsegment").where("text is not null").select("segment_id", F.split("text", " ").alias("t"))
    return dedup.segments_by_hash(s, "t", ["segment_id"]).select("segment_key", "segment_id", "copies")


@query("""with p as (select doc_id, unnest(string_split(text, chr(10))) as paragraph, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
k as (select *, trim(regexp_replace(lower(paragraph), '[^a-z0-9]+', ' ', 'g')) as k from p),
r as (select *, row_number() over (partition by doc_id, k order by pos) as n, len(list_filter(string_split(k, ' '), lambda x: x <> '')) >= 10 as long from k where k <> '')
select doc_id, pos::bigint as pos, paragraph from r where not long or n = 1""")
def paragraph_dedup(spark, d):
    return dedup.paragraph_dedup(_docs(spark, d), "doc_id", "text")


@query(f"""with {S.RECORDS}, a as (select id, url, content, 0 as part from rec), b as (select segment_id as id, source_url as url, text as content, 1 as part from (select segment_id, min(source_url) as source_url, min(text) as text from textsegment group by 1)),
x as (select coalesce(nullif(url, ''), nullif(id, '')) as merge_key, coalesce(length(content), 0) as n, md5(coalesce(content, '')) as content_key, part from (select * from a union all select * from b)),
r as (select *, rank() over (partition by merge_key order by n desc, part) as k from x where merge_key is not null)
select merge_key, n::bigint as n, part::bigint as part, count(distinct content_key)::bigint as candidates, case when count(distinct content_key) = 1 then min(content_key) end as content_key from r where k = 1 group by 1, 2, 3""")
def merge_documents(spark, d):
    a = _records(spark, d).select("id", "url", "content")
    b = read_table(spark, d, "textsegment").groupBy(C("segment_id").alias("id")).agg(F.min("source_url").alias("url"), F.min("text").alias("content"))
    parts = [x.withColumn("part", lit(i).cast("long")) for i, x in enumerate((a, b))]
    m = dedup.merge_sources(parts, ["url", "id"], "content")
    # rows of one length in one table tie; how many texts do so shows whether the text is settled
    key, size, digest = F.coalesce(*[F.when(C(k) != "", C(k)) for k in ("url", "id")]), F.coalesce(F.length("content"), lit(0)).cast("long"), F.md5(F.coalesce("content", lit("")))
    every = parts[0].unionByName(parts[1]).select(key.alias("merge_key"), size.alias("n"), "part", digest.alias("k"))
    won = m.select("merge_key", size.alias("n"), "part", digest.alias("k"))
    ties = every.join(won.drop("k"), ["merge_key", "n", "part"]).groupBy("merge_key").agg(F.count_distinct("k").alias("candidates"))
    return won.join(ties, "merge_key").select("merge_key", "n", "part", "candidates", F.when(C("candidates") == 1, C("k")).alias("content_key"))


@query(f"""with {S.RECORDS}, e as (select unnest(documents) as m from crawlmanifest), o as (select m.id as id, max(m.title) as title from e where m.id is not null group by 1)
select id, coalesce(o.title, rec.title) as title, length(content)::bigint as n from o join rec using (id)""")
def manifest_documents(spark, d):
    entries = readers.manifest_entries(read_table(spark, d, "crawlmanifest"))
    docs = read_table(spark, d, "crawldoc").where("metadata.id is not null").groupBy(C("metadata.id").alias("k")).agg(F.min_by("metadata", F.struct("ingested_at", F.xxhash64("metadata"))).alias("metadata"), F.min("content").alias("content"))
    return readers.documents_by_manifest(entries, docs).select("id", C("metadata.title").alias("title"), F.length("content").cast("long").alias("n"))


# ---- URLs and records ----


@query(f"with {S.RECORDS}, u as (select distinct {S.dedup_url('url')} as url_norm, url from rec where url is not null) select url_norm, count(*)::bigint as spellings from u group by 1")
def url_normalize(spark, d):
    return dedup.distinct_urls(_records(spark, d), "url")


@query(f"""with {S.RECORDS} select id, {S.host('url')} as host, coalesce({S.host('url')} = 'tarvessa.example' or ends_with({S.host('url')}, '.tarvessa.example'), false) as allowed,
coalesce(regexp_matches(url, '(?i)(?:{'|'.join(R.EXCLUDED_URL)})'), false) as excluded, {S.first_match('url', R.DOC_TYPES, R.DOC_TYPE_DEFAULT)} as doc_type, {S.first_match('url', R.DEPARTMENTS, R.DEPARTMENT_DEFAULT)} as department,
case when coalesce(ends_with(lower(regexp_replace(url, '[?#].*$', '')), '.pdf'), false) then 'pdf' else 'html' end as kind from rec""")
def url_classify(spark, d):
    r = crawl.dispatch(_records(spark, d), "url")
    return r.select("id", U.host(C("url")).alias("host"), U.allowed_domain(C("url"), "tarvessa.example").alias("allowed"), U.excluded(C("url")).alias("excluded"), U.doc_type(C("url")).alias("doc_type"), U.department(C("url")).alias("department"), "kind")


@query(f"""with {S.RECORDS} select id, substr(sha256(url), 1, 16) as record_id, md5(content) as content_hash, sha1(content) as sha1, length(content)::bigint as content_length,
regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') as url_norm, nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '://[^/]+(?:/[^/]*)*/([^/]+)$', 1), '') as filename from rec""")
def page_metadata(spark, d):
    r = _records(spark, d)
    return r.select("id", U.record_id(C("url")).alias("record_id"), F.md5("content").alias("content_hash"), F.sha1("content").alias("sha1"), F.length("content").cast("long").alias("content_length"), U.normalize(C("url")).alias("url_norm"), U.filename(C("url")).alias("filename"))


FAN = 8
_LINKS = f"""{{records}}, u as (select url, row_number() over (order by url) - 1 as k from (select distinct {{url}} as url from rec where url is not null)),
links as (select p.url as src, c.url as dst from u c join u p on p.k = (c.k - 1) // {FAN} where c.k > 0)"""


def _site(spark, d):
    """A site made of the records: page k links to pages FAN * k + 1 on, k counting URLs in order."""
    urls = _records(spark, d).where("url is not null").select(U.normalize(C("url")).alias("url")).distinct()
    u = ranking.global_rank(urls, [C("url")], "k").select("url", "k")
    up = u.select(C("url").alias("src"), C("k").alias("parent"))
    return u, u.where("k > 0").withColumn("parent", F.floor((C("k") - 1) / FAN)).join(up, "parent").select("src", C("url").alias("dst"))


_SITE = _LINKS.format(records=f"with recursive {S.RECORDS}", url="regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')")


@query(f"""{_SITE}, w as (select url, 0 as depth from u where k = 0 union select l.dst, w.depth + 1 from w join links l on l.src = w.url) select url, min(depth)::bigint as depth from w group by 1""")
def crawl_bfs(spark, d):
    u, links = _site(spark, d)
    return crawl.breadth_first(u.where("k = 0").select("url"), links).select("url", C("depth").cast("long").alias("depth"))


def _pages(spark, d):
    """url, html: the records as pages with a head, a menu, paragraphs and the links of the site."""
    _, links = _site(spark, d)
    safe = lambda c: F.replace(F.replace(F.replace(c, lit("&"), lit("&amp;")), lit("<"), lit("&lt;")), lit(">"), lit("&gt;"))
    r = _records(spark, d).where("url is not null").select(U.normalize(C("url")).alias("url"), "title", "content")
    one = r.groupBy("url").agg(F.min(F.struct("title", "content")).alias("r")).select("url", "r.*")
    outs = links.groupBy(C("src").alias("url")).agg(F.sort_array(F.collect_list("dst")).alias("to"))  # FAN at most
    none = F.array().cast("array<string>")
    body = F.array_join(F.transform(F.split(F.coalesce("content", lit("")), "\n"), lambda x: F.concat(lit("<p>"), safe(x), lit("</p>"))), "")
    menu = F.array_join(F.transform(F.coalesce("to", none), lambda x: F.concat(lit('<li><a href="'), safe(x), lit('#top">page</a></li>'))), "")
    html_text = F.concat(lit("<html><head><title>"), safe(F.coalesce("title", lit(""))), lit("</title></head><body><nav><ul>"), menu, lit("</ul></nav><main>"), body, lit("</main><footer><p>All rights reserved</p></footer></body></html>"))
    return one.join(outs, "url", "left").select("url", html_text.alias("html"))


@query()
def page_extract(spark, d):
    return html.extract(_pages(spark, d), "url", "html", "url")


@query(f"{_SITE} select src, dst from links")
def page_links(spark, d):
    return html.links(_pages(spark, d), "html", "url")


@query()
def crawl_documents(spark, d):
    return crawl.process_pages(_pages(spark, d), "url", "html")[0]


# ---- filters and cleaning ----


# The numbers of the filters' policy stand here as such, apart from the rule tables.
_LEAST_TOKENS = "case {k} when 'Academic Program' then 120 when 'Academic Regulation' then 160 when 'Course Syllabus' then 180 when 'Department' then 100 when 'Faculty Profile' then 90 when 'Research' then 100 when 'Student Life' then 80 else 80 end"
_LEAST_CHARS = "case {k} when 'Research' then 180 when 'Academic Regulation' then 300 when 'Academic Program' then 250 when 'Course Syllabus' then 400 when 'Faculty Profile' then 150 when 'Department' then 250 when 'Student Life' then 140 else 250 end"
_KEPT = "('Research', 'Academic Regulation', 'Academic Program', 'Course Syllabus', 'Faculty Profile', 'Department', 'Student Life')"


def _scraped_sql(text: str) -> str:
    toks, kind, plain = S.tokens(text), "coalesce(doc_type, '')", S.heading(f"coalesce({text}, '')")
    n, promo = f"len({toks})", S.hits(toks, R.PROMOTIONAL_HINTS)
    t, u = "lower(coalesce(title, ''))", "lower(coalesce(url, ''))"
    return f"""case when {kind} in {S.words(R.EXCLUDED_DOC_TYPES)} then 'excluded_doc_type:' || {kind} when {S.any_of(t, R.EXCLUDED_TITLE)} then 'excluded_title' when regexp_matches({u}, '(?i)(?:{'|'.join(R.EXCLUDED_URL)})') then 'excluded_url'
when {S.any_of(t, R.EXECUTIVE_TITLE)} or {S.any_of(f"replace({u}, '-', ' ')", R.EXECUTIVE_TITLE)} or {S.any_of(plain, R.EXECUTIVE_CONTENT)} then 'executive_or_offcampus' when {S.any_of(plain, R.STAFF_RECRUITMENT_CONTENT)} then 'faculty_recruitment'
when {S.any_of(plain, R.ADMISSION_INDEX_CONTENT)} then 'admission_index' when {S.any_of(plain, R.OUTREACH_CONTENT)} then 'outreach_or_school_program' when regexp_matches({u}, '/(phd|msc|mtech|btech)(-phd)?-students?([/?]|$)') then 'student_roster_page'
when regexp_matches({u}, '/students?(?:[/?]|$)') and not contains({u}, 'office-of-students') and not contains({t}, 'student life') and not contains({t}, 'campus life') then 'student_listing_page'
when {n} < {_LEAST_TOKENS.format(k=kind)} then 'too_short_after_cleaning' when {kind} = 'Faculty Profile' and {S.hits(toks, R.FACULTY_SIGNALS)} < 4 then 'faculty_directory_or_low_signal'
when {n} < 220 and {S.distinct_ratio(toks)} < 0.22 then 'low_unique_ratio' when {n} < 260 and {promo} >= 12 then 'promotional_content' else 'kept' end"""


@query(f"with {S.RECORDS} select id, {_scraped_sql('content')} as reason from rec")
def doc_quality_filter(spark, d):
    r = _records(spark, d)
    return r.select("id", filters.scraped_reason(C("doc_type"), C("title"), C("url"), C("content")).alias("reason"))


def _english_sql(sample: str) -> str:
    s = f"substr(regexp_replace({sample}, '\\s+', ' ', 'g'), 1, 2000)"
    w = f"regexp_extract_all(lower({s}), '\\S+')"
    return f"(length({s}) < 80 or {S.hits(w, R.STOP_WORDS)} >= 0.12 * len({w}))"


def _corpus_sql() -> str:
    kind, t, u, c = "coalesce(doc_type, '')", "lower(coalesce(title, ''))", "lower(coalesce(url, ''))", "coalesce(content, '')"
    forced = f"({S.any_of(t, R.FORCE_KEEP_HINTS)} or {S.any_of(u, R.FORCE_KEEP_HINTS)})"
    toks, named, taught = S.tokens("content"), f"coalesce(nullif({kind}, ''), 'unknown')", S.any_of(u, R.PEDAGOGY_URL)
    english = f"coalesce(regexp_matches(lower(lang), '^en'), {_english_sql(f"coalesce(title, '') || ' ' || substr({c}, 1, 1500)")})"
    return f"""case when not {english} then 'non_english' when {S.any_of(t, R.RECRUITMENT_TITLE)} or {S.any_of(f'lower({c})', R.RECRUITMENT_CONTENT)} then 'excluded_recruitment_page'
when {S.any_of(u, R.FACILITY_PATHS)} and not {S.any_of(t, R.FACILITY_ALLOW)} and ({S.any_of(t, R.FACILITY_TITLES)} or {S.any_of(u, R.FACILITY_TITLES)}) then 'excluded_facility_page'
when {kind} = 'Facility' then 'excluded_doc_type:Facility' when {kind} not in {_KEPT} and not {forced} then 'excluded_doc_type:' || {named} when ({S.any_of(t, R.EXCLUDED_TITLE)} or regexp_matches({u}, '(?i)(?:{'|'.join(R.EXCLUDED_URL)})')) and not {forced} then 'excluded_by_title_or_url'
when length(trim({c}, ' ' || chr(9) || chr(10) || chr(13))) < {_LEAST_CHARS.format(k=kind)} then 'too_short:' || {named}
when ({taught} or {S.any_of(t, R.PEDAGOGY_TITLE)}) and {S.hits(toks, R.PEDAGOGY_TOKENS)} >= 12 and ({taught} or {S.hits(toks, R.DOMAIN_TOKENS)} <= 6) then 'pedagogy_heavy_page' else 'kept' end"""


@query(f"with {S.RECORDS}, x as (select {_corpus_sql()} as reason from rec) select reason, count(*)::bigint as documents from x group by 1")
def corpus_filter_reasons(spark, d):
    """The reasons with the declared language, or the word test where none is declared."""
    r = _records(spark, d)
    reason = filters.corpus_reason(C("doc_type"), C("title"), C("url"), C("content"), C("lang"))
    return filters.reason_counts(r.select(reason.alias("reason")), "reason")


@query(f"""with s as (select doc_id, trim(substr(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), 1, 2000), '') as t from documents), w as (select doc_id, t, regexp_extract_all(lower(t), '\\S+') as w from s)
select doc_id, length(t) < 80 or {S.hits('w', R.STOP_WORDS)} >= 0.12 * len(w) as english from w""")
def language_predicate(spark, d):
    return _docs(spark, d).select("doc_id", filters.is_english(C("text")).alias("english"))


@query(f"""with {S.RECORDS}, p as (select id, unnest(string_split(content, chr(10))) as raw, generate_subscripts(string_split(content, chr(10)), 1) as line_no from rec where content is not null),
l as (select id, line_no, regexp_replace(raw, '\\r$', '') as line from p) select id, line_no::bigint as line_no, {S.drop_line('line')} as scraper_drop, {S.corpus_line('line')} as corpus_drop from l""")
def line_noise_filter(spark, d):
    lines = cleaning.lines_of(_records(spark, d), "id", "content")
    return lines.select("id", "line_no", T.drop_line(C("line")).alias("scraper_drop"), T.drop_corpus_line(C("line")).alias("corpus_drop"))


def _paragraph_sql() -> tuple[str, str]:
    low = S.heading("p")
    t = S.tokens(low)
    a = f"({low} = '' or {S.any_of(low, R.PARAGRAPH_DROP_PHRASES)} or len({t}) = 0 or (len({t}) <= 40 and {S.hits(t, R.PROMOTIONAL_HINTS)} >= 3) or regexp_matches({low}, '^(?:table |see table |title of the talk|about the speaker)'))"
    lw = "lower(trim(p))"
    u = f"list_filter({S.tokens(lw)}, lambda y: not {S.noise('y')})"
    n, meta, refs, promo = f"len({u})", S.hits(u, R.SYLLABUS_METADATA), S.hits(u, R.REFERENCE_TOKENS), S.hits(u, R.PROMOTIONAL_HINTS)
    acad = f"(({n} <= 20 and {meta} >= 3) or ({n} <= 30 and {refs} >= 3) or {meta} >= greatest(5, floor({n} / 4)) or {refs} >= greatest(5, floor({n} / 4)) or {promo} >= greatest(4, floor({n} / 5)))"
    other = f"({S.hits(u, R.PEDAGOGY_TOKENS)} >= greatest(6, floor({n} / 5)) and {S.hits(u, R.DOMAIN_TOKENS)} <= 3)"
    b = f"({lw} = '' or {S.any_of(lw, R.PARAGRAPH_DROP_PHRASES)} or {n} = 0 or case when coalesce(doc_type, '') in {S.words(R.ACADEMIC_TYPES)} then {acad} else {other} end)"
    return a, b


@query(f"""with x as (select doc_id, doc_type, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) as k from documents)
select doc_id, k::bigint as k, {_paragraph_sql()[0]} as scraper_drop, {_paragraph_sql()[1]} as corpus_drop from x""")
def paragraph_filter(spark, d):
    x = _docs(spark, d).select("doc_id", "doc_type", F.posexplode(F.split("text", "\n")).alias("pos", "p"))
    return x.select("doc_id", (C("pos") + 1).cast("long").alias("k"), T.drop_paragraph(C("p")).alias("scraper_drop"), T.drop_corpus_paragraph(C("p"), C("doc_type")).alias("corpus_drop"))


@query(f"with {S.SEGMENTS} select segment_id, {S.roster('t')} as roster, {S.low_signal('t')} as low_signal, {S.skip_sequence('t')} as skipped from seg")
def segment_flags(spark, d):
    return _segments(spark, d).select("segment_id", T.is_roster(C("t")).alias("roster"), T.is_low_signal(C("t")).alias("low_signal"), T.skip_sequence(C("t")).alias("skipped"))


@query(f"with {S.SEGMENTS}, w as (select distinct unnest(t) as token from seg) select token, {S.noise('token')} as noise from w")
def noise_tokens(spark, d):
    return _segments(spark, d).select(F.explode("t").alias("token")).distinct().select("token", T.is_noise(C("token")).alias("noise"))


@query(f"with {S.RECORDS} select id, {S.heading('title')} as heading, {S.drop_heading(S.heading('title'))} as dropped from rec where title is not null")
def title_headings(spark, d):
    r = _records(spark, d).where("title is not null")
    h = T.normalize_heading(C("title"))
    return r.select("id", h.alias("heading"), T.is_drop_heading(h).alias("dropped"))


def _normalized_sql(text: str) -> str:
    """The tokens of `text.normalized_tokens`: mapped, singular, parted, without noise."""
    table = lambda t, pairs: f"case {t} " + " ".join(f"when '{k}' then '{v}'" for k, v in pairs.items()) + f" else {t} end"
    simple = f"list_transform({S.tokens(text)}, lambda t: {table('t', R.TOKEN_MAP)})"
    rule = "case when ends_with(t, 'ies') then left(t, length(t) - 3) || 'y' when regexp_matches(t, '(?:ss|ch|sh|x|zz)es$') then left(t, length(t) - 2) else left(t, length(t) - 1) end"
    lemma = f"list_transform({simple}, lambda t: case when t in {S.words(R.LEMMAS)} then {table('t', R.LEMMAS)} when length(t) > 4 and ends_with(t, 's') and not regexp_matches(t, '(?:ss|us|is)$') then {rule} else t end)"
    parts = f"flatten(list_transform({lemma}, lambda t: case when t in {S.words(R.COMPOUNDS)} or not regexp_matches(t, '[_-]') then [t] else list_filter(regexp_split_to_array(t, '[_-]'), lambda p: p <> '') end))"
    return f"list_filter({parts}, lambda y: not {S.noise('y')})"


@query(f"""with {S.RECORDS}, x as (select id, doc_type, title, {_normalized_sql("coalesce(title, '')")} as t from rec)
select id, array_to_string(t, ' ') as tokens, len(t) between 3 and 12 and not {S.any_of("lower(coalesce(title, ''))", R.EXCLUDED_TITLE)} and {S.hits('t', R.ANCHORS)} >= case when coalesce(doc_type, '') in ('Academic Regulation', 'Academic Program', 'Course Syllabus', 'Department') then 1 else 2 end as used from x""")
def title_tokens(spark, d):
    r = _records(spark, d).withColumn("tokens", T.title_tokens(C("title")))
    return r.select("id", F.array_join("tokens", " ").alias("tokens"), T.use_title(C("doc_type"), C("tokens"), C("title")).alias("used"))


@query()
def section_skip_clean(spark, d):
    return _records(spark, d).select("id", cleaning.clean_scraped(C("content"), ascii_only=False).alias("cleaned"))


@query()
def corpus_clean(spark, d):
    return _docs(spark, d).select("doc_id", cleaning.clean_corpus(C("text"), ascii_only=False).alias("cleaned"))


# ---- sequences ----


@query(f"""with x as (select doc_id, {S.tokens('text')} as t from documents), s as (select doc_id, t, unnest(case when len(t) <= 96 then [0] else list_filter(range(0, len(t), 86), lambda s: s = 0 or (s - 86 + 96 < len(t) and len(t) - s >= 15)) end) as s from x)
select doc_id, s::bigint as s, array_to_string(t[s + 1 : s + 96], ' ') as tokens from s""")
def segment_windows(spark, d):
    x = _docs(spark, d).select("doc_id", T.tokens(C("text")).alias("t")).select("doc_id", F.posexplode(sequences.overlapping_windows(C("t"))).alias("k", "w"))
    return x.select("doc_id", (C("k") * 86).cast("long").alias("s"), F.array_join("w", " ").alias("tokens"))


@query("""with x as (select doc_id, list_filter(string_split(text, chr(10)), lambda y: trim(y) <> '') as l from documents),
y as (select doc_id, l, len(l) as n, case when len(l) <= 12 then l else list_transform(range(0, 12), lambda i: l[least(floor(i * len(l) / 12), len(l) - 1)::bigint + 1]) end as s from x),
u as (select doc_id, n, unnest(s) as line, generate_subscripts(s, 1) as k from y), f as (select doc_id, line, k, row_number() over (partition by doc_id, line order by k) as r, n from u)
select doc_id, line, k::bigint as k from f where n <= 12 or r = 1""")
def segment_sampling(spark, d):
    x = _docs(spark, d).select("doc_id", F.filter(F.split("text", "\n"), lambda y: F.btrim(y) != "").alias("l"))
    n = F.size("l")
    picks = F.when(n <= 12, C("l")).otherwise(F.transform(F.sequence(lit(0), lit(11)), lambda i: F.element_at("l", (F.least(F.floor(i * n / lit(12)), n - 1) + 1).cast("int"))))
    first = x.select("doc_id", picks.alias("p"), F.explode(sequences.even_sample(C("l"), 12)).alias("line"), n.alias("n"), F.monotonically_increasing_id().alias("_"))
    small = x.where(n <= 12).select("doc_id", F.posexplode("l").alias("pos", "line")).select("doc_id", "line", (C("pos") + 1).cast("long").alias("k"))
    large = first.where("n > 12").select("doc_id", "line", F.array_position("p", C("line")).cast("long").alias("k"))
    return small.unionByName(large)


def _line_sequences(spark, d):
    x = _docs(spark, d).select("doc_id", F.flatten(F.transform(F.filter(F.split("text", "\n"), lambda p: F.btrim(p) != ""), T.sentences)).alias("s"))
    return x.select("doc_id", F.filter(F.transform("s", T.tokens), lambda t: F.size(t) > 0).alias("seqs"))


@query()
def segment_packing(spark, d):
    return sequences.pack_documents(_line_sequences(spark, d), "doc_id", "seqs")


@query()
def corpus_segments(spark, d):
    return pipeline.build(_docs(spark, d).withColumn("title", lit(None).cast("string")), "doc_id", "text", "doc_type", "title", lang="lang").segments


# ---- vectors ----

_UNIT = "u as (select vec_id, label, list_transform(embedding, lambda x: x::double / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))), 1e-12)) as v from embeddings where embedding is not null)"


@query(f"""with {_UNIT}, s as (select q.vec_id as query, x.vec_id, round(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])), 6) as similarity from u q join u x on q.vec_id <> x.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query order by similarity desc, vec_id) as rank from s) select query, vec_id, similarity, rank::bigint as rank from r where rank <= 10""")
def vector_neighbors(spark, d):
    v = read_table(spark, d, "embeddings")
    r = similarity.neighbours(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return r.select("query", "vec_id", "similarity", C("rank").cast("long").alias("rank"))


@query(f"""with {_UNIT}, t as (select a.vec_id as a, b.vec_id as b, c.vec_id as c, list_transform(list_zip(a.v, b.v, c.v), lambda p: p[2] - p[1] + p[3]) as g from u a join u b on b.vec_id = a.vec_id + 1 join u c on c.vec_id = a.vec_id + 2 where a.vec_id % 20 = 0),
g as (select a, b, c, list_transform(g, lambda x: x / greatest(sqrt(list_sum(list_transform(g, lambda y: y * y))), 1e-12)) as g from t),
s as (select a, b, c, vec_id, round(list_sum(list_transform(list_zip(u.v, g.g), lambda p: p[1] * p[2])), 6) as similarity from g, u where vec_id not in (a, b, c)),
r as (select *, row_number() over (partition by a, b, c order by similarity desc, vec_id) as rank from s) select a, b, c, vec_id, similarity, rank::bigint as rank from r where rank <= 5""")
def vector_analogies(spark, d):
    """Triples of successive ids from every id divisible by 20."""
    v = read_table(spark, d, "embeddings").where("embedding is not null")
    triples = v.where("vec_id % 20 = 0").select(C("vec_id").alias("a"), (C("vec_id") + 1).alias("b"), (C("vec_id") + 2).alias("c"))
    return similarity.analogies_in_blocks(v, triples, "vec_id", "embedding", 5).select("a", "b", "c", "vec_id", "similarity", C("rank").cast("long").alias("rank"))


@query("with x as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings where embedding is not null) select label, dim::bigint as dim, round(avg(x), 6) as value, count(*)::bigint as members from x group by 1, 2")
def vector_label_centroids(spark, d):
    return similarity.centroids(read_table(spark, d, "embeddings"), "label", "embedding")


@query()
def pca_2d(spark, d):
    return similarity.pca(read_table(spark, d, "embeddings"), "vec_id", "embedding")


RUNS = [("cbow", 100, 5, 5, 2.31, 2.10), ("cbow", 200, 5, 10, 2.31, 2.05), ("cbow", 50, 2, 5, 2.40, 2.20), ("skipgram", 100, 2, 5, 3.10, 3.00), ("skipgram", 100, 5, 5, 3.10, 2.90), ("skipgram", 200, 2, 10, None, 2.70)]
_RUNS = ", ".join(f"('{m}', {a}, {b}, {c}, {v if v is not None else 'null'}, {f})" for m, a, b, c, v, f in RUNS)


@query(f"""with r as (select * from (values {_RUNS}) t(model, dim, "window", negatives, validation_loss, final_loss)), k as (select *, row_number() over (partition by model order by validation_loss nulls last, final_loss, case when "window" = 2 then 0 else 1 end, case when negatives = 10 then 0 else 1 end, dim) as a,
row_number() over (partition by model order by validation_loss nulls last, final_loss) as b from r) select model, dim::bigint as dim, "window"::bigint as "window", negatives::bigint as negatives, a = 1 as by_all_keys, b = 1 as by_loss from k where a = 1 or b = 1""")
def best_run(spark, d):
    r = spark.createDataFrame(RUNS, "model string, dim bigint, window bigint, negatives bigint, validation_loss double, final_loss double")
    key = ["model", "dim", "window", "negatives"]
    loss = [C("validation_loss").asc_nulls_last(), C("final_loss").asc()]
    a = similarity.best_runs(r, "model", [*loss, (C("window") != 2).asc(), (C("negatives") != 10).asc(), C("dim").asc()]).select(*key, lit(True).alias("by_all_keys"))
    b = similarity.best_runs(r, "model", loss).select(*key, lit(True).alias("by_loss"))
    no = lit(False)
    return a.join(b, key, "full").select(*key, F.coalesce("by_all_keys", no).alias("by_all_keys"), F.coalesce("by_loss", no).alias("by_loss"))


def _trained(spark, d, configs: list[embedding.Config]) -> DataFrame:
    s, v = _segments(spark, d), _vocab(spark, d)
    runs = embedding.run_grid(vocabulary.encode(s, "segment_id", "t", v), "segment_id", v, configs)
    return runs.select("run_no", "model", "dim", "window", "negatives", "final_loss", "validation_loss", "stopped_early", F.size("input").alias("rows"))


@query()
def w2v_train(spark, d):
    return _trained(spark, d, [embedding.Config(m, 32, 2, 5, epochs=2, batch=512) for m in ("cbow", "skipgram")])


@query()
def w2v_grid(spark, d):
    return _trained(spark, d, embedding.grid())


# ---- names ----

_NAMES = "nm as (select regexp_replace(lower(name), '\\s+', '', 'g') as name from nameline where name is not null), nn as (select name, count(*) as copies from nm where name <> '' group by 1)"


def _names(spark, d):
    return names.load(read_table(spark, d, "nameline"), "name", allow_repeats=True)


@query(f"with {_NAMES} select name, copies::bigint as copies from nn")
def name_list(spark, d):
    return _names(spark, d)


@query(f"""with {_NAMES}, c as (select name, list_concat(list_concat(['<bos>'], string_split(name, '')), ['<eos>']) as c from nn), k as (select name, c, unnest(range(1, len(c))) as k from c)
select name, array_to_string(c[1:k], ' ') as prefix, c[k + 1] as next from k""")
def name_prefixes(spark, d):
    return sequences.prefixes(_names(spark, d), "name")


@query(f"""with {_NAMES}, c as (select distinct unnest(string_split(name, '')) as token from nn) select token, (row_number() over (order by token) + 2)::bigint as idx from c union all select * from (values ('<pad>', 0::bigint), ('<bos>', 1::bigint), ('<eos>', 2::bigint)) t(token, idx)""")
def name_characters(spark, d):
    return names.characters(_names(spark, d))


@query(f"with {_NAMES} select name, name as decoded, (length(name) + 2)::bigint as n from nn")
def name_encoding(spark, d):
    n = _names(spark, d)
    chars = names.characters(n)
    e = names.encode(n, chars)
    return names.decode(e, chars).join(e, "name").select("name", "decoded", F.size("ids").cast("long").alias("n"))


_SAMPLES = "with sm as (select lower(string_split(c_name, '#')[1]) || (c_custkey % 50)::varchar as name from customer), kn as (select distinct lower(string_split(c_name, '#')[1]) || (c_custkey % 70)::varchar as name from customer where c_custkey % 3 = 0), ct as (select name, count(*) as n from sm where name is not null group by 1), mk as (select ct.*, kn.name is not null as known from ct left join kn using (name))"


def _samples(spark, d):
    c = read_table(spark, d, "customer")
    base = F.lower(F.substring_index("c_name", "#", 1))
    return c.select(F.concat(base, (C("c_custkey") % 50).cast("string")).alias("name")), c.where("c_custkey % 3 = 0").select(F.concat(base, (C("c_custkey") % 70).cast("string")).alias("name")).distinct()


@query(f"{_SAMPLES} select sum(n)::bigint as generated, count(*)::bigint as unique, coalesce(sum(n) filter (not known), 0)::bigint as novel, round(coalesce(sum(n) filter (not known), 0) / sum(n), 6) as novelty_rate, round(count(*) / sum(n), 6) as diversity, round(sum(n * length(name)) / sum(n), 6) as average_length from mk")
def sample_metrics(spark, d):
    m = names.sample_metrics(*_samples(spark, d))
    return m.select("generated", "unique", "novel", *[F.round(c, 6).alias(c) for c in ("novelty_rate", "diversity", "average_length")])


@query(f"""{_SAMPLES} select coalesce(sum(n) filter (known), 0)::bigint as copied, sum(n - 1)::bigint as repeats, coalesce(sum(n) filter (length(name) <= 3), 0)::bigint as short, coalesce(sum(n) filter (length(name) >= 13), 0)::bigint as long,
coalesce(sum(n) filter (len(list_filter(range(1, length(name) - 1), lambda i: name[i] = name[i + 1] and name[i] = name[i + 2])) > 0), 0)::bigint as stutters from mk""")
def failure_modes(spark, d):
    return names.failure_modes(*_samples(spark, d))


@query("select p_name as name, min(p_partkey)::bigint as first_at from part where p_name is not null group by 1 order by 2, 1 limit 12")
def first_distinct(spark, d):
    return sequences.first_distinct(read_table(spark, d, "part").withColumnRenamed("p_name", "name"), "name", "p_partkey")


@query()
def name_generate(spark, d):
    return names.generate(_names(spark, d), 300)


@query()
def generated_metrics(spark, d):
    """sample_metrics of the generated names against the whole name list."""
    return names.sample_metrics(name_generate(spark, d), _names(spark, d))


@query()
def generated_failures(spark, d):
    return names.failure_modes(name_generate(spark, d), _names(spark, d))


@query()
def name_models(spark, d):
    """Parameters, losses and sample metrics of the recurrent models, trained on the whole list."""
    return recurrent.results(_names(spark, d))


@query(f"""with a as (select count(*) as pages, (max(epoch_us(ingested_at)) - min(epoch_us(ingested_at))) / 60e6 as minutes from crawldoc where ingested_at is not null)
select pages::bigint as pages, round(minutes, 6) as minutes, round(pages / nullif(minutes, 0), 6) as per_minute from a""")
def crawl_rate(spark, d):
    r = crawl.rate(read_table(spark, d, "crawldoc"), "ingested_at")
    return r.select("pages", F.round("minutes", 6).alias("minutes"), F.round("per_minute", 6).alias("per_minute"))


ANALYSIS_WORDS = ("research", "thesis", "laboratory", "committee", "unknownword")
ANALYSIS_QUESTIONS = [("department", "annual", "office", ["report"]), ("thesis", "students", "report", ["committee", "department"])]


def _vectors(spark, d):
    s, v = _segments(spark, d), _vocab(spark, d)
    run = embedding.run_grid(vocabulary.encode(s, "segment_id", "t", v), "segment_id", v, [embedding.Config("skipgram", 32, 2, 5, epochs=2, batch=512)])
    rows = run.select(F.posexplode("input").alias("token_id", "vector")).join(v, "token_id").select("token", "count", "vector")
    return materialize(rows), v


@query()
def semantic_report(spark, d):
    vectors, v = _vectors(spark, d)
    return similarity.semantic_analysis(vectors, list(ANALYSIS_WORDS), ANALYSIS_QUESTIONS, vocabulary.analysis_exclusions(v))


@query()
def embedding_plot(spark, d):
    vectors, _ = _vectors(spark, d)
    at = lambda df, c: df.select(C("token").alias("word"), c.alias("at"))
    focus = spark.createDataFrame([(w, i) for i, w in enumerate(ANALYSIS_WORDS)], "word string, at bigint").join(vectors.select(C("token").alias("word")), "word", "left_semi")
    near = similarity.neighbours(vectors.select("token", "vector"), vectors.where(C("token").isin(*ANALYSIS_WORDS)).select("token", "vector"), "token", "vector", 8)
    words = similarity.plot_words(focus, at(near, C("rank").cast("long")), at(vectors, -C("count")))
    return similarity.plot_points(vectors, words)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

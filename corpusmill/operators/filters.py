"""Document filters that say why a document goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import rules as R, text as T

C, lit = F.col, F.lit


def _by_type(doc_type: Column, table: dict[str, int], default: int) -> Column:
    out = lit(default)
    for k, v in sorted(table.items()):
        out = F.when(doc_type == k, v).otherwise(out)
    return out


def _text(c: Column) -> Column:
    return F.coalesce(c, lit(""))


def first_reason(*pairs: tuple[Column, Column | str]) -> Column:
    """The reason of the first condition that holds, else `kept`; a null condition does not hold."""
    return F.coalesce(*[F.when(F.coalesce(c, lit(False)), r if isinstance(r, Column) else lit(r)) for c, r in pairs], lit("kept"))


def is_recruitment(title: Column, content: Column) -> Column:
    return T.any_of(F.lower(_text(title)), R.RECRUITMENT_TITLE) | T.any_of(F.lower(_text(content)), R.RECRUITMENT_CONTENT)


def is_facility(url: Column, title: Column) -> Column:
    """Facility path, no allowed wording, and an equipment wording in the title or URL."""
    u, t = F.lower(_text(url)), F.lower(_text(title))
    return T.any_of(u, R.FACILITY_PATHS) & ~T.any_of(t, R.FACILITY_ALLOW) & (T.any_of(t, R.FACILITY_TITLES) | T.any_of(u, R.FACILITY_TITLES))


def is_english(text: Column, lang: Column | None = None) -> Column:
    """Label that names English, where there is a label; else short texts pass and longer ones need English function words."""
    sample = F.substring(F.regexp_replace(_text(text), r"\s+", " "), 1, 2000)
    words = F.regexp_extract_all(F.lower(sample), lit(r"\S+"), lit(0))
    by_words = (F.length(sample) < 80) | (T.hits(words, R.STOP_WORDS) >= 0.12 * F.size(words))
    return by_words if lang is None else F.coalesce(F.lower(lang).rlike("^en"), by_words)


def scraped_reason(doc_type: Column, title: Column, url: Column, cleaned: Column) -> Column:
    """Reason code of the scraper's quality filter over cleaned content."""
    t, u, kind = F.lower(_text(title)), F.lower(_text(url)), _text(doc_type)
    listing = u.rlike(R.LISTING_URL) & ~u.contains("office-of-students") & ~t.contains("student life") & ~t.contains("campus life")

    def judge(x: Column) -> Column:
        plain, toks = x["plain"], x["toks"]
        n, ratio, promo = F.size(toks), T.distinct_ratio(toks), T.hits(toks, R.PROMOTIONAL_HINTS)
        executive = T.any_of(t, R.EXECUTIVE_TITLE) | T.any_of(u, [w.replace(" ", "-") for w in R.EXECUTIVE_TITLE]) | T.any_of(plain, R.EXECUTIVE_CONTENT)
        return first_reason(
            (kind.isin(*R.EXCLUDED_DOC_TYPES), F.concat(lit("excluded_doc_type:"), kind)), (T.any_of(t, R.EXCLUDED_TITLE), "excluded_title"), (u.rlike(T.alternation(R.EXCLUDED_URL)), "excluded_url"),
            (executive, "executive_or_offcampus"), (T.any_of(plain, R.STAFF_RECRUITMENT_CONTENT), "faculty_recruitment"), (T.any_of(plain, R.ADMISSION_INDEX_CONTENT), "admission_index"), (T.any_of(plain, R.OUTREACH_CONTENT), "outreach_or_school_program"),
            (u.rlike(R.ROSTER_URL), "student_roster_page"), (listing, "student_listing_page"),
            (n < _by_type(kind, R.MIN_TOKENS, R.MIN_TOKENS_DEFAULT), "too_short_after_cleaning"), ((kind == "Faculty Profile") & (T.hits(toks, R.FACULTY_SIGNALS) < 4), "faculty_directory_or_low_signal"),
            ((n < 220) & (ratio < 0.22), "low_unique_ratio"), ((n < 260) & (promo >= 12), "promotional_content"),
        )

    # the text is normalized and cut into tokens once
    return T.let(F.struct(T.normalize_heading(_text(cleaned)).alias("plain"), T.tokens(cleaned).alias("toks")), judge)


def corpus_reason(doc_type: Column, title: Column, url: Column, text: Column, lang: Column | None = None) -> Column:
    """Reason code of the corpus builder's filter. Types other than the kept ones go, unless a hint forces them; the language is
    that of the title and the first `ENGLISH_SAMPLE_CHARS` characters."""
    t, u, kind, body = F.lower(_text(title)), F.lower(_text(url)), _text(doc_type), _text(text)
    forced = T.any_of(t, R.FORCE_KEEP_HINTS) | T.any_of(u, R.FORCE_KEEP_HINTS)
    named, toks = F.when(kind == "", "unknown").otherwise(kind), T.tokens(text)
    english = is_english(F.concat_ws(" ", _text(title), F.substring(body, 1, R.ENGLISH_SAMPLE_CHARS)), lang)
    taught = T.any_of(u, R.PEDAGOGY_URL)
    heavy = (taught | T.any_of(t, R.PEDAGOGY_TITLE)) & (T.hits(toks, R.PEDAGOGY_TOKENS) >= R.PEDAGOGY_MIN_HITS) & (taught | (T.hits(toks, R.DOMAIN_TOKENS) <= R.PEDAGOGY_MAX_RESEARCH))
    return first_reason(
        (~english, "non_english"), (is_recruitment(title, text), "excluded_recruitment_page"), (is_facility(url, title), "excluded_facility_page"), (kind == "Facility", "excluded_doc_type:Facility"),
        (~kind.isin(*R.KEPT_DOC_TYPES) & ~forced, F.concat(lit("excluded_doc_type:"), named)), ((T.any_of(t, R.EXCLUDED_TITLE) | u.rlike(T.alternation(R.EXCLUDED_URL))) & ~forced, "excluded_by_title_or_url"),
        (F.length(F.btrim(body, lit(" \t\r\n"))) < _by_type(kind, R.MIN_CHARS, R.MIN_CHARS_DEFAULT), F.concat(lit("too_short:"), named)), (heavy, "pedagogy_heavy_page"),
    )


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(reason).agg(F.count(lit(1)).alias("documents"))

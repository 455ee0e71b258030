"""Text functions on columns: normalization, tokens, predicates on token arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from corpusmill.functions import rules as R

C = F.col
lit = F.lit


def alternation(patterns) -> str:
    """One case-insensitive pattern for many."""
    return "(?i)(?:" + "|".join(patterns) + ")"


def any_of(text: Column, needles) -> Column:
    """Whether a text contains any of the given strings; false for null."""
    parts = [text.contains(n) for n in needles]
    return F.coalesce(reduce(lambda a, b: a | b, parts), lit(False))


# an address is read once from its first character: possessive, and not begun in the middle of a run
EMAIL = r"(?<![a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def let(value: Column, f) -> Column:
    """f(value) with the value computed once; plain column functions repeat what they mention twice."""
    return F.get(F.transform(F.array(value), f), lit(0))


def normalize_whitespace(text: Column, ascii_only: bool = True) -> Column:
    """Blank special spaces, URLs and addresses; bullets to newlines; squeeze; at most one empty line in a row; trim."""
    t = F.regexp_replace(text, "[ ​]", " ")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"http\S+|www\.\S+", " ")
    t = F.regexp_replace(t, EMAIL, " ")
    t = F.regexp_replace(t, r"[ \t\f]{2,}|[\t\f]", " ")
    t = F.regexp_replace(t, "[•●▪◆■◦]+", "\n")
    if ascii_only:
        t = F.regexp_replace(t, r"[^\x00-\x7F]+", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.btrim(t, lit(" \n\t"))


def normalize_heading(text: Column) -> Column:
    """Lower case, other than letters, digits and hyphens to spaces, squeezed, trimmed of spaces and hyphens."""
    t = F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]+", " ")
    return F.btrim(F.regexp_replace(t, r"\s+", " "), lit(" -"))


def is_drop_heading(heading: Column) -> Column:
    return heading.rlike("^(?:(?:" + "|".join(R.SECTION_DROP_HEADINGS) + ")$|" + "|".join(R.SECTION_DROP_PREFIXES) + ")")


def is_generic_heading(heading: Column) -> Column:
    return heading.rlike("^(?:(?:" + "|".join(R.GENERIC_HEADINGS) + ")$|" + "|".join(R.GENERIC_HEADING_PREFIXES) + ")")


def replace_all(text: Column, pairs) -> Column:
    """Ordered regular-expression replacements."""
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), pairs, text)


def domain_phrases(text: Column, pairs=R.PHRASE_REPLACEMENTS) -> Column:
    return replace_all(text, pairs)


def remove_blocks(text: Column, patterns=R.BLOCK_PATTERNS) -> Column:
    return replace_all(text, [(p, "\n") for p in patterns])


def remove_boilerplate(text: Column, patterns=R.BOILERPLATE_PATTERNS) -> Column:
    t = replace_all(text, [(p, "") for p in patterns])
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


# The entities replaced by name; numeric ones are left to the HTML reader.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&ndash;", "-"), ("&mdash;", "-"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, lit(p[0]), lit(p[1])), ENTITIES, text)


def tokens(text: Column) -> Column:
    """Tokens of the lower-cased text; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), lit(R.TOKEN_PATTERN), lit(0)), F.array().cast("array<string>"))


def simple_token(token: Column, mapping: dict[str, str] = R.TOKEN_MAP) -> Column:
    """Lower case, trimmed, without outer apostrophes, mapped by a small table."""
    t = F.btrim(F.btrim(F.lower(token)), lit("'"))
    return _mapped(t, mapping)


def _mapped(t: Column, mapping: dict[str, str]) -> Column:
    if not mapping:
        return t
    out = t
    for k, v in sorted(mapping.items(), reverse=True):
        out = F.when(t == k, v).otherwise(out)
    return out


def lemma(token: Column, lemmas: dict[str, str] = R.LEMMAS) -> Column:
    """Lemma by table, else a regular plural's singular, else the simple token."""
    return let(simple_token(token), lambda t: _lemma(t, lemmas))


def _lemma(t: Column, lemmas: dict[str, str] = R.LEMMAS) -> Column:
    """Table, then the rules of English plurals: -ies, -es behind a hiss, -s."""
    plural = (F.length(t) > 4) & t.endswith("s") & ~t.rlike("(?:ss|us|is)$")
    cut = lambda n: F.substring(t, lit(1), F.length(t) - n)
    by_rule = F.when(t.endswith("ies"), F.concat(cut(3), lit("y"))).when(t.rlike("(?:ss|ch|sh|x|zz)es$"), cut(2)).otherwise(cut(1))
    return F.when(t.isin(*lemmas), _mapped(t, lemmas)).when(plural, by_rule).otherwise(t)


TITLES = ("Dr", "Prof", "Mr", "Mrs", "Ms", "Er", "Shri", "Smt")


def without_person_names(text: Column, titles=TITLES) -> Column:
    """Text without the names that follow a title of address: up to three capitalized words. Stands in for a tagger of names."""
    return F.regexp_replace(text, rf"\\b(?:{'|'.join(titles)})\\.?\\s+(?:[A-Z][a-z'-]+\\.?\\s*){{1,3}}", " ")


def tokenizer_description() -> str:
    """What the tokenizer does, for reports."""
    return f"regular expression {R.TOKEN_PATTERN} on lower-cased text, plurals by rule, {len(R.LEMMAS)} listed lemmas, names after titles of address dropped on request"


def expand(token: Column, compounds=R.COMPOUNDS) -> Column:
    """Parts of a joined token, unless it is a known compound."""
    split = F.filter(F.split(token, "[_-]"), lambda x: x != "")
    return F.when(token.isin(*compounds) | ~token.rlike("[_-]"), F.array(token)).otherwise(split)


def normalized_tokens(text: Column) -> Column:
    """Tokenize, normalize, expand and drop noise: the corpus builder's regular-expression path."""
    simple = F.transform(tokens(text), lambda t: simple_token(t))
    parts = F.flatten(F.transform(F.transform(simple, lambda t: _lemma(t)), lambda t: expand(t)))
    return F.filter(parts, lambda t: ~is_noise(t))


_MONTH = "(?:" + "|".join(R.MONTHS) + ")"
NOISE_PATTERN = "|".join((
    r"^\d+$", R.COURSE_CODE, R.ROMAN, rf"_{_MONTH}(?:_\d{{2,4}})?$", rf"(?:^|_){_MONTH}_", rf"_{_MONTH}$", r"(?:^|_)\d{2,}_", r"_\d{2,}$", "-.*-", R.HEX_LIKE,
))


def is_noise(t: Column) -> Column:
    """Tokens that carry no content: listed, short, numeric, codes, numerals, dates, hashes."""
    return t.isin(*R.NOISE_TOKENS) | (F.length(t) <= 1) | t.rlike(NOISE_PATTERN) | ((F.length(t) >= 6) & t.rlike(r"\d"))


def hits(arr: Column, words) -> Column:
    """Number of elements that are in a small table."""
    return F.size(F.filter(arr, lambda t: t.isin(*words)))


def distinct_ratio(arr: Column) -> Column:
    return F.size(F.array_distinct(arr)) / F.greatest(F.size(arr), lit(1))


def is_roster(arr: Column) -> Column:
    """Token lists that read like a list of people or courses."""
    def judge(c: Column) -> Column:
        people = (c["degree"] >= 4) & ((hits(arr, R.ROSTER_MARKERS) >= 1) | ((c["degree"] >= 5) & (hits(arr, R.ANCHORS) <= 2)) | ((distinct_ratio(arr) >= 0.72) & (hits(arr, R.ANCHORS) <= 4)))
        return (c["codes"] >= 2) | people

    codes = F.size(F.filter(arr, lambda t: t.rlike(R.COURSE_CODE)))
    return (F.size(arr) > 0) & let(F.struct(hits(arr, R.DEGREE_HINTS).alias("degree"), codes.alias("codes")), judge)


def is_low_signal(arr: Column, least: int = R.MIN_SEGMENT_TOKENS) -> Column:
    n = F.size(arr)
    announced = let(hits(arr, R.ANNOUNCEMENT_HINTS), lambda h: ((n <= 20) & (h >= 3)) | ((n <= 36) & (h >= F.greatest(lit(4), F.floor(n / 4)))) | (h >= F.greatest(lit(6), F.floor(n / 3))))
    return (n < least) | announced | ((n >= 20) & (distinct_ratio(arr) < 0.3)) | is_roster(arr)


def skip_sequence(arr: Column) -> Column:
    n = F.size(arr)
    announced = let(hits(arr, R.ANNOUNCEMENT_HINTS), lambda h: ((n <= 8) & (h >= 2)) | ((n <= 12) & (h >= 3)))
    return (n == 0) | ((n <= 4) & (F.size(F.array_distinct(arr)) <= 2)) | announced | is_roster(arr)


def sentences(paragraph: Column) -> Column:
    """Parts after `.!?;:` and white space; empty ones dropped."""
    return F.filter(F.transform(F.split(paragraph, r"(?<=[.!?;:])\s+"), lambda s: F.btrim(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n{2,}"), lambda s: F.btrim(s, lit(" \n\t"))), lambda s: s != "")


def title_tokens(title: Column) -> Column:
    return normalized_tokens(F.coalesce(title, lit("")))


def use_title(doc_type: Column, toks: Column, title: Column) -> Column:
    """3 to 12 tokens, no excluded wording, and one anchor (two outside the academic types)."""
    need = F.when(F.coalesce(doc_type, lit("")).isin(*R.ACADEMIC_TYPES, "Department"), 1).otherwise(2)
    return F.size(toks).between(3, 12) & ~any_of(F.lower(F.coalesce(title, lit(""))), R.EXCLUDED_TITLE) & (hits(toks, R.ANCHORS) >= need)


def drop_line(line: Column) -> Column:
    """Scraper's line rule: lone bullets, section headings, furniture patterns."""
    s = F.btrim(line)
    short = F.length(s) <= 80  # the headings of the table are short
    return (s != "") & (s.isin("-", "*", "o") | (short & is_drop_heading(normalize_heading(F.regexp_replace(s, "^#+", "")))) | s.rlike(alternation(R.LINE_DROP_PATTERNS)))


def drop_corpus_line(line: Column) -> Column:
    """Corpus builder's line rule."""
    low = F.lower(F.btrim(line))
    return let(F.struct(low.alias("low"), _line_words(low).alias("w"), tokens(low).alias("t")), lambda s: _drop_corpus_line(s["low"], s["w"], s["t"]))


def kept_corpus_lines(lines: Column) -> Column:
    """The lines with those that the rule drops made empty; words and tokens of a line are found once."""
    low = F.transform(lines, lambda x: F.struct(x.alias("x"), F.lower(F.btrim(x)).alias("low")))
    read = F.transform(low, lambda s: F.struct(s["x"].alias("x"), s["low"].alias("low"), _line_words(s["low"]).alias("w"), tokens(s["low"]).alias("t")))
    return F.transform(read, lambda s: F.when(_drop_corpus_line(s["low"], s["w"], s["t"]), "").otherwise(s["x"]))


def _line_words(low: Column) -> Column:
    return F.regexp_extract_all(low, lit("[a-z]+"), lit(0))


def _drop_corpus_line(low: Column, words: Column, toks: Column) -> Column:
    n = F.size(words)
    codes = F.size(F.filter(toks, lambda t: t.rlike(R.COURSE_CODE)))
    roster = (hits(toks, R.DEGREE_HINTS) >= 4) & let(F.filter(toks, lambda t: ~is_noise(t)), is_roster)
    announced = (n <= 18) & let(hits(words, R.ANNOUNCEMENT_HINTS), lambda h: (h >= 3) | ((n <= 10) & (h >= 2)))
    return (
        (low == "") | (n == 0) | low.rlike(r"^(?:(?:page\s+\d+|\d+\s*\|\s*page|\d+)$|table |see table |download file)|" + "|".join(R.PARAGRAPH_DROP_PHRASES)) | announced
        | ((n <= 2) & (F.size(F.filter(words, lambda w: F.length(w) > 1)) == 0)) | ((n <= 3) & (hits(words, R.NOISE_TOKENS) == n)) | (codes >= 2) | roster
    )


def drop_paragraph(paragraph: Column) -> Column:
    """Scraper's paragraph rule."""
    def judge(low: Column) -> Column:
        promo = let(tokens(low), lambda toks: (F.size(toks) == 0) | ((F.size(toks) <= 40) & (hits(toks, R.PROMOTIONAL_HINTS) >= 3)))
        return (low == "") | low.rlike("|".join(R.PARAGRAPH_DROP_PHRASES)) | low.rlike("^(?:table |see table |title of the talk|about the speaker)") | promo

    return let(normalize_heading(paragraph), judge)


def drop_corpus_paragraph(paragraph: Column, doc_type: Column) -> Column:
    """Corpus builder's paragraph rule, by document type."""
    def judge(toks: Column) -> Column:
        n = F.size(toks)
        meta, refs, promo = hits(toks, R.SYLLABUS_METADATA), hits(toks, R.REFERENCE_TOKENS), hits(toks, R.PROMOTIONAL_HINTS)
        academic = let(F.struct(n.alias("n"), meta.alias("m"), refs.alias("r"), promo.alias("p")), lambda c: ((c["n"] <= 20) & (c["m"] >= 3)) | ((c["n"] <= 30) & (c["r"] >= 3)) | (c["m"] >= F.greatest(lit(5), F.floor(c["n"] / 4))) | (c["r"] >= F.greatest(lit(5), F.floor(c["n"] / 4))) | (c["p"] >= F.greatest(lit(4), F.floor(c["n"] / 5))))
        other = (hits(toks, R.PEDAGOGY_TOKENS) >= F.greatest(lit(6), F.floor(n / 5))) & (hits(toks, R.DOMAIN_TOKENS) <= 3)
        return (n == 0) | F.when(F.coalesce(doc_type, lit("")).isin(*R.ACADEMIC_TYPES), academic).otherwise(other)

    low = F.lower(F.btrim(paragraph))
    return (low == "") | any_of(low, R.PARAGRAPH_DROP_PHRASES) | let(F.filter(tokens(low), lambda t: ~is_noise(t)), judge)


def phrase_pair(left: Column, right: Column, seeds=R.PHRASE_SEEDS) -> Column:
    """Pairs worth counting as a phrase: content words of letters, at least one of them a seed (any pair without seeds)."""
    def plain(t: Column) -> Column:
        return ~t.isin(*R.STOP_WORDS, *R.NOISE_TOKENS) & ~t.contains("_") & (F.length(t) >= 3) & ~t.rlike(r"\d")

    pair = plain(left) & plain(right)
    return pair & (left.isin(*seeds) | right.isin(*seeds)) if seeds else pair


def hash32(*cols: Column) -> Column:
    """First 32 bits of an MD5 as a number: equal in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def unit_hash(*cols: Column) -> Column:
    """Hash in [0, 1): a random number that does not depend on partitions."""
    return hash32(*cols) / lit(4294967296.0)

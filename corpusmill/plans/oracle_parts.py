"""Pieces of DuckDB SQL that restate column functions for checking."""

from __future__ import annotations

from corpusmill.functions import rules as R


def words(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def tokens(text: str) -> str:
    pattern = R.TOKEN_PATTERN.replace("'", "''")
    return f"coalesce(regexp_extract_all(lower({text}), '{pattern}'), [])"


def noise(t: str) -> str:
    months = "|".join(R.MONTHS)
    tests = [
        f"{t} in {words(R.NOISE_TOKENS)}", f"length({t}) <= 1", f"regexp_matches({t}, '^\\d+$')", f"regexp_matches({t}, '{R.COURSE_CODE}')", f"regexp_matches({t}, '{R.ROMAN}')", f"regexp_matches({t}, '_(?:{months})(?:_\\d{{2,4}})?$')",
        f"regexp_matches({t}, '(?:^(?:{months})_|_(?:{months})_|_(?:{months})$)')", f"regexp_matches({t}, '(?:^|_)\\d{{2,}}(?:_)|_\\d{{2,}}$')", f"(regexp_matches({t}, '\\d') and length({t}) >= 6)", f"length({t}) - length(replace({t}, '-', '')) >= 2", f"regexp_matches({t}, '{R.HEX_LIKE}')",
    ]
    return "(" + " or ".join(tests) + ")"


def hits(arr: str, table) -> str:
    return f"len(list_filter({arr}, lambda x: x in {words(table)}))"


def distinct_ratio(arr: str) -> str:
    return f"(len(list_distinct({arr})) / greatest(len({arr}), 1))"


def roster(arr: str) -> str:
    degree, anchor = hits(arr, R.DEGREE_HINTS), hits(arr, R.ANCHORS)
    codes = f"len(list_filter({arr}, lambda x: regexp_matches(x, '{R.COURSE_CODE}')))"
    return f"(len({arr}) > 0 and ({codes} >= 2 or ({degree} >= 4 and {hits(arr, R.ROSTER_MARKERS)} >= 1) or ({degree} >= 5 and {anchor} <= 2) or ({degree} >= 4 and {distinct_ratio(arr)} >= 0.72 and {anchor} <= 4)))"


def low_signal(arr: str) -> str:
    n, h = f"len({arr})", hits(arr, R.ANNOUNCEMENT_HINTS)
    return f"({n} < {R.MIN_SEGMENT_TOKENS} or {roster(arr)} or ({n} <= 20 and {h} >= 3) or ({n} <= 36 and {h} >= greatest(4, floor({n} / 4))) or {h} >= greatest(6, floor({n} / 3)) or ({n} >= 20 and {distinct_ratio(arr)} < 0.3))"


def skip_sequence(arr: str) -> str:
    n, h = f"len({arr})", hits(arr, R.ANNOUNCEMENT_HINTS)
    return f"({n} = 0 or {roster(arr)} or ({n} <= 8 and {h} >= 2) or ({n} <= 12 and {h} >= 3) or ({n} <= 4 and len(list_distinct({arr})) <= 2))"


def heading(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9\\s-]+', ' ', 'g'), '\\s+', ' ', 'g'), ' -')"


def drop_heading(h: str) -> str:
    return f"({h} in {words(R.SECTION_DROP_HEADINGS)} or regexp_matches({h}, '^(?:{'|'.join(R.SECTION_DROP_PREFIXES)})'))"


def drop_line(line: str) -> str:
    s = f"trim({line})"
    return f"({s} <> '' and ({s} in ('-', '*', 'o') or {drop_heading(heading(f"regexp_replace({s}, '^#+', '')"))} or regexp_matches({s}, '(?i)(?:{'|'.join(R.LINE_DROP_PATTERNS)})')))"


def any_of(text: str, table) -> str:
    return "(" + " or ".join(f"coalesce(contains({text}, '{x.replace(chr(39), chr(39) * 2)}'), false)" for x in table) + ")"


def corpus_line(line: str) -> str:
    low = f"lower(trim({line}))"
    w = f"regexp_extract_all({low}, '[a-z]+')"
    n, h = f"len({w})", hits(w, R.ANNOUNCEMENT_HINTS)
    codes = f"len(list_filter({tokens(low)}, lambda x: regexp_matches(x, '{R.COURSE_CODE}')))"
    clean = f"list_filter({tokens(low)}, lambda y: not {noise('y')})"
    return (
        f"({low} = '' or regexp_matches({low}, '^(?:page\\s+\\d+|\\d+\\s*\\|\\s*page|\\d+)$') or starts_with({low}, 'table ') or starts_with({low}, 'see table ') or {any_of(low, R.PARAGRAPH_DROP_PHRASES)} or {codes} >= 2 or {roster(clean)}"
        f" or {n} = 0 or ({n} <= 2 and len(list_filter({w}, lambda x: length(x) > 1)) = 0) or ({n} <= 3 and {hits(w, R.NOISE_TOKENS)} = {n}) or ({n} <= 10 and {h} >= 2) or ({n} <= 18 and {h} >= 3) or starts_with({low}, 'download file'))"
    )


def first_match(text: str, table, default: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({text}), '{p}') then '{k}'" for k, p in table) + f" else '{default}' end"


def by_type(kind: str, table: dict[str, int], default: int) -> str:
    return f"case {kind} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + f" else {default} end"


def host(url: str) -> str:
    return f"nullif(regexp_extract(lower({url}), '^[a-z][a-z0-9+.-]*://([^/:?#]*)', 1), '')"


def dedup_url(url: str) -> str:
    u = f"regexp_replace(lower({url}), '/+$', '')"
    base = f"regexp_replace(string_split({u}, '?')[1], '/+$', '')"
    kept = f"list_filter(string_split(regexp_extract({u}, '\\?(.*)$', 1), '&'), lambda p: string_split(p, '=')[1] not in {words(R.TRACKING_PARAMETERS)} and p <> '')"
    return f"case when len({kept}) > 0 then {base} || '?' || array_to_string({kept}, '&') else {base} end"


def hash32(*parts: str) -> str:
    return f"('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 8))::bigint"


RECORDS = """
rec as (select metadata.id as id, min(metadata.source_url) as url, min(metadata.title) as title, min(metadata.doc_type) as doc_type, min(metadata.department) as department, min(declared_lang) as lang, min(content) as content
        from crawldoc where metadata.id is not null group by 1)"""
SEGMENTS = "seg as (select segment_id, string_split(min(text), ' ') as t from textsegment where segment_id is not null and text is not null group by 1)"
VOCAB = f"with {SEGMENTS}, tok as (select unnest(t) as token from seg), voc as (select token, count(*) as count, row_number() over (order by count(*) desc, token) - 1 as token_id from tok group by 1 having count(*) >= 5)"

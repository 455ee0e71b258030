"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_RECORDS = """
r as (select metadata.id as id, min(content) as content, lower(min(metadata.source_url)) as url
      from crawldoc where content is not null and metadata.id is not null group by 1)"""

_LINES = f"""
with {_RECORDS},
h as (select id, content, regexp_extract(url, '://([^/:?#]*)', 1) as host from r where url is not null),
p as (select id, host, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as line_no
      from h where host <> ''),
n as (select id, host, line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9!-/:-@\\[-`{{-~]', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) as norm from p),
l as (select * from n where norm <> ''),
hc as (select host, count(*) as total from h group by 1),
c as (select host, norm, count(distinct id) as records from l group by 1, 2),
k as (select c.host, c.norm from c join hc using (host) where records >= 5 and records >= 0.1 * total)"""

_TERMS = f"""
with {_RECORDS},
w as (select id, trim(unnest(regexp_split_to_array(lower(content), '[ \\t\\r\\n]+')), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~') as term from r),
c as (select term, count(*)::bigint as occurrences, count(distinct id)::bigint as records from w where term <> '' group by 1),
t as (select count(*) as total from r),
m as (select term, occurrences, records, case when records < 3 then 'rare' when records > 0.2 * total then 'common' end as mark from c, t)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"{_LINES} select id, line_no::bigint as line_no from l join k using (host, norm)",
        "p7_found": f"{_TERMS} select term, mark from m where mark is not null",
        "p7_terms": f"{_TERMS} select term, occurrences, records, mark from m",
    }

"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusmill.functions import rules as R
from corpusmill.functions.text import alternation

lit = F.lit


def normalize(url: Column) -> Column:
    """Without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def normalize_for_dedup(url: Column, parameters=R.TRACKING_PARAMETERS) -> Column:
    """Lower case, without trailing slash (before and after removal) and tracking parameters; the rest keeps its order."""
    u = F.regexp_replace(F.lower(url), "/+$", "")
    base, query = F.substring_index(u, "?", 1), F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~F.substring_index(p, "=", 1).isin(*parameters) & (p != ""))
    base = F.regexp_replace(base, "/+$", "")
    return F.when(F.size(kept) > 0, F.concat(base, lit("?"), F.array_join(kept, "&"))).otherwise(base)


def host(url: Column) -> Column:
    """Lower-cased host; null without one."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/:?#]*)", 1)
    return F.when(h != "", h)


def allowed_domain(url: Column, domain: str) -> Column:
    """Host is the domain or below it; false without a host."""
    h = host(url)
    return F.coalesce((h == domain) | h.endswith("." + domain), lit(False))


def excluded(url: Column, patterns=R.EXCLUDED_URL) -> Column:
    return F.coalesce(url.rlike(alternation(patterns)), lit(False))


def first_match(text: Column, table, default: str) -> Column:
    """Label of the first rule that matches the lower-cased text."""
    low, out = F.lower(text), None
    for label, pattern in table:
        out = (F.when if out is None else out.when)(low.rlike(pattern), label)
    return F.coalesce(out.otherwise(default), lit(default))


def doc_type(url: Column, table=R.DOC_TYPES) -> Column:
    return first_match(url, table, R.DOC_TYPE_DEFAULT)


def department(url: Column, table=R.DEPARTMENTS) -> Column:
    return first_match(url, table, R.DEPARTMENT_DEFAULT)


def filename(url: Column) -> Column:
    """Last path part without its parameters, decoded; null if there is none."""
    name = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"://[^/]+(?:/[^/]*)*/([^/]+)$", 1)
    return F.when(name != "", F.try_url_decode(F.replace(name, lit("+"), lit("%2B"))))


def is_pdf(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(url, "[?#].*$", "")).endswith(".pdf"), lit(False))


def record_id(url: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the URL."""
    return F.substring(F.sha2(url, 256), 1, 16)

"""URL parts as Column expressions.

``parse_url`` is not used: it keeps upper case, drops hosts with ``_`` and fails on
stray ``%``. The domain is the lower-case host without user info, port and brackets,
or the whole text when there is no host. Each part is one pattern used once, so that
the expression stays small when Catalyst copies it into filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# RFC 3986 scheme; blanks and control characters before it are skipped.
_SCHEME = r"^[\x00-\x20]*(?:([A-Za-z][A-Za-z0-9+.\-]*):)"
_START = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
# Past the user info and, for a bracketed address, the opening bracket.
_HOST = _START + r"(?:[^/?#]*@)?+(?:[^\[/?#]*\[)?+((?<=\[)[^\]/?#]+|(?<!\[)[^:/?#]+)"
_LAST_LABEL = r"\.([^.]*)\z"
_AUTHORITY = _START + r"([^/?#]*)"
# What stands before the host ends at the last '@'; a host with brackets is all in them.
_BRACKETED = r"^(?:.*@)?\[([^\[\]]*)\](?::.*)?\z"
_FUTURE_HOST = r"^v[0-9A-Fa-f]+\..+\z"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4_TAIL = rf":(?:{_OCTET}\.){{3}}{_OCTET}\z"
_H = "[0-9A-Fa-f]{1,4}"
# Eight groups, or fewer with one '::' for the groups left out.
_IPV6 = "^(?:" + "|".join(
    [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{1,7}}:", rf":(?::{_H}){{1,7}}", "::"]
    + [rf"(?:{_H}:){{1,{n}}}(?::{_H}){{1,{7 - n}}}" for n in range(1, 7)]
) + r")(?:%[^%]+)?\z"


def _without_breaks(url: Column) -> Column:
    return F.translate(url, "\t\r\n", "")


def _all(text: Column, pattern: str) -> Column:
    """The pattern's group for every match: at most one for the patterns here."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _lower_host(host: Column) -> Column:
    """Lower case up to a zone id, which starts at '%' and keeps its case."""
    name = F.substring_index(host, "%", 1)
    return F.concat(F.lower(name), F.substring(host, F.length(name) + 1, F.length(host)))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_without_breaks(url), _SCHEME, 1))


def url_domain(url: Column) -> Column:
    host = F.get(F.transform(_all(_without_breaks(url), _HOST), _lower_host), F.lit(0))
    return F.coalesce(host, url)


def domain_tld(domain: Column) -> Column:
    return F.concat(F.lit("."), F.get(_all(domain, _LAST_LABEL), F.lit(0)))


def malformed_host(url: Column) -> Column:
    """Whether the authority has brackets that don't hold an IPv6 or a future address, and nothing else."""
    authority = F.regexp_extract(_without_breaks(url), _AUTHORITY, 1)
    host = F.regexp_extract(authority, _BRACKETED, 1)
    # An IPv4 tail stands for two groups.
    address = F.regexp_replace(host, _IPV4_TAIL, ":0:0")
    good = authority.rlike(_BRACKETED) & (host.rlike(_FUTURE_HOST) | address.rlike(_IPV6))
    return authority.rlike(r"[\[\]]") & ~good


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("url_domain", url_domain(F.col(url))).withColumn("tld", domain_tld(F.col("url_domain")))

"""The triage tables derived from the driver's parquet tables.

The SQL texts run unchanged in Spark (``{name}`` is filled with a DataFrame) and DuckDB
(with the table's name). Order lines supply matches, votes, reviews and scores by line
number; orders supply URLs.
"""

from __future__ import annotations

from datetime import datetime
from functools import cache, lru_cache
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from snarelight.functions.urls import with_url_parts
from snarelight.model import Tables
from snarelight.plans.maintenance import shaped

AS_OF = datetime(2001, 8, 2)

USERS = """
select c_custkey as user_id, c_name as name,
       concat(lower(replace(c_name, '#', '.')), '@example.com') as email,
       case when c_custkey % 50 = 0 then 'admin' when c_custkey % 50 in (1, 2) then 'analyst' else 'user' end as role,
       timestamp '1994-12-01 00:00:00' as created_at
from {customer}
"""

SUBMISSIONS = """
select o_orderkey as url_id, o_custkey as user_id,
       concat(case when o_orderkey % 3 = 0 then 'http://' else 'https://' end,
              case o_orderkey % 8
                when 0 then concat('verify-account-', cast(o_orderkey as string), '.tk')
                when 1 then concat('www.shop', cast(o_orderkey as string), '.com')
                when 2 then concat('10.', cast(o_orderkey % 250 as string), '.0.7')
                when 3 then 'bit.ly'
                when 4 then concat('paypal---help', cast(o_orderkey as string), '.ml')
                when 5 then concat('a.b.c.d.host', cast(o_orderkey % 40 as string), '.net')
                when 6 then 'LOGIN.Example.org:8443'
                else concat('news', cast(o_orderkey % 9 as string), '.ga') end,
              '/p/', cast(o_orderkey as string),
              case when o_orderkey % 7 = 0 then '?q=%2Fsecure' else '' end) as url,
       case when o_orderkey % 17 = 0 then null when o_orderstatus = 'F' then 'PHISHING'
            when o_orderstatus = 'O' then 'LEGITIMATE' else 'SUSPICIOUS' end as result_code,
       o_orderdate as created_at, cast(null as timestamp) as updated_at
from {orders}
"""

RULES = """
select cast(n_nationkey as bigint) as rule_id, n_name as rule_name, cast(null as string) as description,
       case n_nationkey when 0 then 'verify|secure|update|account|login' when 6 then 'paypal|amazon|microsoft'
            when 12 then 'shop|bank' when 18 then 'help' when 24 then 'secure|verify'
            when 1 then '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' when 7 then '---' when 13 then '%2f'
            when 19 then 'bit[.]ly|tinyurl|goo[.]gl'
            when 2 then 'BIT.LY' when 8 then 'login.example.org' when 14 then 'news3.ga' end as pattern,
       case n_nationkey % 6 when 0 then 'keyword' when 1 then 'regex' when 2 then 'domain'
                            when 3 then 'length' when 4 then 'tld' else 'other' end as rule_type,
       case n_regionkey when 0 then 'low' when 1 then 'medium' when 2 then 'high' when 3 then 'critical' else null end
         as risk_level,
       case n_nationkey when 4 then '.tk' when 10 then '.ml' when 16 then '.ga' when 22 then '.org' end as tld
from {nation}
"""

MATCHES = """
select l_orderkey * 25 + l_partkey % 23 as match_id, l_orderkey as url_id, l_partkey % 23 as rule_id,
       cast(null as string) as match_details, min(l_shipdate) as matched_at
from {lineitem}
where l_linenumber <= 3
group by l_orderkey, l_partkey % 23
"""

VOTES = """
select l_orderkey * 100000 + l_suppkey as vote_id, l_suppkey as user_id, l_orderkey as url_id,
       max(case when l_returnflag = 'R' then -1 else 1 end) as vote_value, min(l_shipdate) as created_at
from {lineitem}
where l_linenumber >= 3
group by l_orderkey, l_suppkey
"""

STATUSES = """
select l_orderkey * 2 + case when l_linestatus = 'O' then 1 else 0 end as status_id, l_orderkey as url_id,
       case when l_orderkey % 7 = 0 then null else l_orderkey % 60 end as reviewer_id,
       case when l_linestatus = 'O' then 'SUSPICIOUS' else 'PHISHING' end as result_code,
       case when l_linestatus = 'O' then 'Under Review' else 'Confirmed Phishing' end as label,
       case when l_orderkey % 10 = 0 then null else 'seed review' end as description,
       min(l_shipdate) as created_at
from {lineitem}
where l_linenumber = 1
group by l_orderkey, l_linestatus
"""

SCORES = """
select l_orderkey * 10 + l_linenumber as rep_id, l_orderkey as url_id,
       case when l_linenumber = 6 then 'src_a' else 'src_b' end as external_source,
       round(max(l_discount) * 10, 2) + 0.0 as avg_score, round(min(l_discount) * 10, 2) + 0.0 as online_score,
       case when max(l_discount) >= 0.075 then 'critical' when max(l_discount) >= 0.05 then 'high'
            when max(l_discount) >= 0.025 then 'medium' else 'low' end as risk_level,
       min(l_shipdate) as created_at
from {lineitem}
where l_linenumber >= 6
group by l_orderkey, l_linenumber
"""

VOTE_LOG = """
select event_id, ts, user_id, event_id % 20 as url_id,
       case when event_type in ('click', 'purchase') then 1 when event_type in ('view', 'signup') then -1 else 0 end
         as vote_value
from {events}
"""

# Every page is used: events take turns over all of them, each page three times in a row.
FEED = """
select e.event_id as seq, case when e.event_id % 29 = 0 then '  ' else p.url end as url,
       case when e.event_id % 5 = 0 then null else cast(date_trunc('second', e.ts) as string) end as dateadded,
       case when e.event_id % 11 = 0 then '' else e.event_type end as threat,
       case when e.value < 10 then 'online' when e.value < 20 then ' offline ' when e.value < 25 then '  ' else null end
         as url_status,
       case when e.event_id % 3 = 0 then null else e.props end as tags,
       case when e.event_id % 4 = 0 then null else cast(date_trunc('second', e.ts) as string) end as last_online
from (select *, cast(floor(event_id / 3) as bigint) % (select count(*) from {pages}) as page_no from {events}) e
join {pages} p on p.page_id = e.page_no
"""

REQUESTS = """
select e.event_id as seq, case when e.user_id % 40 = 7 then null when e.user_id % 40 = 8 then -5 else e.user_id end
         as user_id,
       case e.event_id % 13
         when 0 then '   '
         when 1 then concat(p.url, ';x')
         when 2 then concat('  ', p.url, ' ')
         when 3 then concat(p.url, chr(10), 'x')
         when 4 then concat('https://bit.ly/p/', cast(e.event_id as string))
         when 5 then concat('http://[', cast(e.event_id as string))
         when 6 then concat('User:pw@HOST', cast(e.event_id % 90 as string), '.example.org:99/x')
         when 7 then concat('//User@Host', cast(e.event_id % 90 as string), '.Example.org:99?y')
         else concat(p.url, '&e=', cast(e.event_id % 50 as string)) end as url,
       case e.event_type when 'error' then '' when 'view' then null when 'click' then 'PHISHING' else 'LEGITIMATE' end
         as result_code
from (select *, event_id % (select count(*) from {pages}) as page_no from {events}) e
join {pages} p on p.page_id = e.page_no
"""

ACCOUNT_REQUESTS = """
select event_id as seq,
       case event_id % 17 when 0 then ' ' when 1 then 'A' else concat(' Member ', cast(event_id as string)) end as name,
       case event_id % 19 when 0 then 'nobody'
            when 1 then concat('customer.', cast(user_id as string), '@example.com')
            when 2 then concat('MEMBER', cast(event_id % 300 as string), '@Example.com')
            else concat(' member', cast(event_id % 700 as string), '@example.com ') end as email
from {events}
"""

MATCH_REQUESTS = """
select event_id as seq, case when value > 45 then -1 else cast(floor(event_id / 2) as bigint) end as url_id,
       user_id % 27 as rule_id, case when event_type = 'error' then '  ' else concat(' note ', event_type) end as match_details
from {events}
"""

_MODEL = {
    "users": USERS,
    "rules": RULES,
    "url_rule_matches": MATCHES,
    "statuses": STATUSES,
    "votes": VOTES,
    "url_score_comparisons": SCORES,
}
_INPUTS = {
    "vote_log": VOTE_LOG,
    "feed": FEED,
    "requests": REQUESTS,
    "account_requests": ACCOUNT_REQUESTS,
    "match_requests": MATCH_REQUESTS,
}


def _used(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in Formatter().parse(sql) if name})


# Plans only: the rows are read again by every query.
@lru_cache
def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    return spark.sql(sql, **{n: given[n] if n in given else read(spark, sf_dir, n) for n in _used(sql)})


@lru_cache
def triage_tables(spark: SparkSession, sf_dir: str) -> Tables:
    derived = {name: shaped(derive(spark, sf_dir, sql), name) for name, sql in _MODEL.items()}
    submissions = with_url_parts(derive(spark, sf_dir, SUBMISSIONS))
    return Tables(url_submissions=shaped(submissions, "url_submissions"), **derived)


def input_rows(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    return derive(spark, sf_dir, _INPUTS[name], **given)


# --- the same tables for DuckDB -------------------------------------------------------


def sql_url_parts(source: str, *, url: str = "url") -> str:
    """``source`` with url_domain and tld added, in DuckDB SQL."""
    return rf"""
select * exclude (host_port, bare_host, host), case when contains(url_domain, '.')
         then concat('.', regexp_extract(url_domain, '([^.]*)$', 1)) end as tld
from (select *, case when host <> '' then host else {url} end as url_domain
      from (select *, concat(lower(regexp_extract(bare_host, '^[^%]*')), regexp_extract(bare_host, '%.*$')) as host
            from (select *, case when contains(host_port, '[') then regexp_extract(host_port, '\[([^\]]*)', 1)
                                 else regexp_extract(host_port, '^[^:]*') end as bare_host
                  from (select *, regexp_replace(regexp_extract(regexp_replace({url}, '[\t\r\n]', '', 'g'),
                                  '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '^.*@', '') as host_port
                        from {source}))))
"""


@cache
def duckdb_ctes() -> str:
    """``name as (...)`` for all derived tables, to follow WITH."""
    texts = _MODEL | _INPUTS | {"submission_rows": SUBMISSIONS}
    filled = {name: sql.format(**{n: n for n in _used(sql)}) for name, sql in texts.items()}
    filled["url_submissions"] = sql_url_parts("submission_rows")
    return ",\n".join(f"{name} as ({sql.strip()})" for name, sql in filled.items())

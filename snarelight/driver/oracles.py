"""DuckDB SQL that states each query's result by plain joins and subqueries.

These deliberately take another road than the Spark jobs (joins that multiply rows,
EXISTS, windows over whole groups), so that agreement means something.
"""

from __future__ import annotations

from snarelight.driver.tables import duckdb_ctes, sql_url_parts

_AS_OF = "timestamp '2001-08-02 00:00:00'"

_VOTE_SPLIT = """
select s.url_id, count(v.vote_id) filter (v.vote_value = 1) as phishing_votes,
       count(v.vote_id) filter (v.vote_value = -1) as legitimate_votes
from url_submissions s left join votes v using (url_id) group by s.url_id
"""

_CONFLICTS = """
select s.url_id, s.url, s.result_code, r.label as review_status, r.description as review_description,
       count(*) filter (v.vote_value = 1) as phishing_votes, count(*) filter (v.vote_value = -1) as legitimate_votes,
       count(v.vote_id) as total_votes
from url_submissions s join statuses r on r.url_id = s.url_id join votes v on v.url_id = s.url_id
where exists (from votes o where o.url_id = s.url_id and o.vote_value <>
              case s.result_code when 'PHISHING' then 1 when 'LEGITIMATE' then -1 else 0 end)
group by all
"""

_RANKED = """
select url_id, url, url_domain, result_code, risk_score, risk_level, vote_count, round(mean_vote, 6) as avg_vote_value,
       rank() over (order by risk_score desc) as risk_rank,
       case when mean_vote > 0.5 then 'Phishing Agreement' when mean_vote < -0.5 then 'Legitimate Agreement'
            else 'Uncertain' end as agreement_status
from (select s.url_id, s.url, s.url_domain, s.result_code, ifnull(x.avg_score, 0.5) as risk_score, x.risk_level,
             x.avg_score, count(v.vote_id) as vote_count, avg(v.vote_value) as mean_vote
      from url_submissions s left join url_score_comparisons x on x.url_id = s.url_id
                             left join votes v on v.url_id = s.url_id
      group by s.url_id, s.url, s.url_domain, s.result_code, x.avg_score, x.risk_level)
"""

_CONTRIBUTORS = """
select p.user_id, p.name, p.email, p.role, count(s.url_id) as total_submissions,
       count(*) filter (s.result_code = 'PHISHING') as phishing_count,
       count(*) filter (s.result_code = 'LEGITIMATE') as legitimate_count,
       count(*) filter (s.result_code = 'SUSPICIOUS') as suspicious_count
from users p left join url_submissions s on s.user_id = p.user_id
where p.role = 'user' group by all
"""

_VOTED_CODE = """
select s.* replace (ifnull(d.code, s.result_code) as result_code,
                    case when d.code is null then s.updated_at else {as_of} end as updated_at)
from url_submissions s
left join (select url_id, case when avg(vote_value) > 0 then 'PHISHING' else 'LEGITIMATE' end as code
           from votes group by url_id having count(*) >= 3 and abs(avg(vote_value)) > 0.3) d using (url_id)
""".format(as_of=_AS_OF)


def _idle(table: str) -> str:
    return f"""
select t.* from {table} t
where t.url_id not in (
  select s.url_id from url_submissions s
  where s.created_at < {_AS_OF} - interval 90 day
    and s.url_id not in (select url_id from votes) and s.url_id not in (select url_id from statuses)
    and s.url_id not in (select url_id from url_rule_matches))
"""


_BENIGN = """
select m.* from url_rule_matches m join url_submissions s using (url_id) join rules r using (rule_id)
where s.result_code = 'LEGITIMATE' and r.risk_level in ('high', 'critical')
"""


def _classified(strict: bool) -> str:
    counted = "select s.url_id, count(m.rule_id) as n from url_submissions s {} join url_rule_matches m using (url_id) group by 1"
    touched = "s.updated_at" if strict else f"case when s.result_code is null then {_AS_OF} else s.updated_at end"
    return f"""
select s.* replace (case when s.result_code is not null then s.result_code when c.n is null then null when c.n > 2 then 'PHISHING'
                         when c.n > 0 then 'SUSPICIOUS' else 'LEGITIMATE' end as result_code,
                    {touched} as updated_at)
from url_submissions s left join ({counted.format("inner" if strict else "left")}) c using (url_id)
"""


_FEED_ROWS = f"""
select seq, url, url_domain, tld, coalesce(try_cast(nullif(dateadded, '') as timestamp), {_AS_OF}) as created_at,
       'URLHaus: ' || case when ifnull(threat, '') = '' then 'Threat' else trim(threat) end as label,
       'Status: ' || coalesce(nullif(trim(url_status), ''), 'unknown') || '; Tags: ' || coalesce(nullif(trim(tags), ''), 'n/a')
         || '; Last seen: ' || coalesce(nullif(last_online, ''), 'n/a') || '.' as description,
       coalesce(try_cast(coalesce(nullif(last_online, ''), nullif(dateadded, '')) as timestamp), {_AS_OF}) as reviewed_at
from ({sql_url_parts("(select * replace (trim(url) as url) from feed where trim(url) <> '')")})
"""

_FEED_NEW = f"""
select * from ({_FEED_ROWS}) f
where f.url not in (select url from url_submissions)
qualify row_number() over (partition by f.url order by f.seq) = 1
"""

_FEED_COUNTS = """
select count(*) filter (n.seq is not null) as inserted, count(*) filter (n.seq is null) as skipped
from ({rows}) f left join (select seq from ({new}) order by seq limit {limit}) n using (seq)
where (select count(*) from ({new})) < {limit}
   or f.seq <= (select max(seq) from (select seq from ({new}) order by seq limit {limit}))
"""


def _feed_counts(limit: int) -> str:
    return _FEED_COUNTS.format(rows=_FEED_ROWS, new=_FEED_NEW, limit=limit)


_CHECKED = rf"""
select r.*, case when r.url = '' then 'url_required'
                 when length(r.url) > 2048 or regexp_matches(r.url, '[\n\r;]') then 'invalid_characters'
                 when ifnull(r.user_id, 0) = 0 then 'not_signed_in'
                 when contains(regexp_extract(r.url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '[')
                   <> contains(regexp_extract(r.url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), ']') then 'malformed_host'
                 when r.user_id not in (select user_id from users) then 'unknown_user' end as problem
from ({sql_url_parts("(select * replace (trim(url) as url, ifnull(nullif(result_code, ''), 'SUSPICIOUS') as result_code) from requests)")}) r
"""

_SUBMITTED = f"""
select *, case when problem is not null then problem
               when url in (select url from url_submissions) or turn > 1 then 'duplicate_url' end as reason
from (select *, row_number() over (partition by url, problem is null order by seq) as turn from ({_CHECKED}))
"""

_RULE_TESTS = """
select s.url_id, r.rule_id,
       'Matched ' || r.rule_type || ' rule: ' ||
         case r.rule_type when 'tld' then r.tld when 'length' then 'more than 38 characters' else r.pattern end as match_details
from {urls} s, rules r
where case r.rule_type when 'keyword' then regexp_matches(s.url, r.pattern, 'i') or regexp_matches(s.url_domain, r.pattern, 'i')
                       when 'regex' then regexp_matches(s.url, r.pattern, 'i') or regexp_matches(s.url_domain, r.pattern, 'i')
                       when 'tld' then s.tld = r.tld
                       when 'domain' then s.url_domain = lower(r.pattern)
                       when 'length' then length(s.url) > {long_url} else false end
"""

# Votes by islands: within one island all values agree; the vote stands on odd last islands.
_FOLDED = """
select user_id, url_id, max(vote_value) as vote_value, max(ts) as created_at
from (select *, max(island) over (partition by user_id, url_id) as last_island
      from (select *, sum(flip) over (partition by user_id, url_id order by ts, event_id) as island
            from (select *, case when vote_value = lag(vote_value) over (partition by user_id, url_id order by ts, event_id)
                            then 0 else 1 end as flip
                  from vote_log where vote_value in (-1, 1))))
where island = last_island
group by user_id, url_id having count(*) % 2 = 1
"""

# A vote's part of the stream, and the newest time of the parts before it less one hour.
_ARRIVED = """
select v.*, max(ts) over (order by part range between unbounded preceding and 1 preceding) - interval 1 hour as watermark
from (select v.*, least(2, cast(floor(3 * (epoch_us(v.ts) - (select min(epoch_us(ts)) from events))
          / ((select max(epoch_us(ts)) - min(epoch_us(ts)) from events) + 1)) as int)) + if(event_id % 50 = 0, 1, 0) as part
      from vote_log v where vote_value in (-1, 1)) v
"""
_SESSIONS = """
select user_id, min(ts) as session_start, max(ts) as last_seen, max(ts) + interval 8 hour as expires_at, count(*) as event_count
from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session_no
      from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 8 hour then 0 else 1 end as fresh
            from events))
group by user_id, session_no
"""

_SCORED = """
select x.* replace (round(b.score, 6) as avg_score,
                    case when b.score >= 0.75 then 'critical' when b.score >= 0.5 then 'high' when b.score >= 0.25 then 'medium'
                         else 'low' end as risk_level)
from url_score_comparisons x
join (select s.url_id,
             0.6::double * avg(case r.risk_level when 'critical' then 1 when 'high' then 0.75::double when 'medium' then 0.5::double
                               when 'low' then 0.25::double else 0 end)
               + (avg(v.vote_value) + 1) / 2 * 0.4::double as score
      from url_submissions s left join url_rule_matches m using (url_id) left join rules r on r.rule_id = m.rule_id
                             left join votes v on v.url_id = s.url_id
      group by s.url_id) b using (url_id)
"""

_DOSSIER = """
select s.*, 'url' as section, p.name as submitter_name, p.email as submitter_email, p.role as submitter_role
from url_submissions s join users p using (user_id)
union all by name
select m.*, 'rule' as section, r.rule_name, r.risk_level, r.rule_type from url_rule_matches m join rules r using (rule_id)
union all by name
select t.* exclude (reviewer_id), 'status' as section, p.name as reviewer_name
from statuses t left join users p on p.user_id = t.reviewer_id
union all by name
select v.* exclude (user_id), 'vote' as section, p.name as voter_name, p.role as voter_role from votes v join users p using (user_id)
union all by name
select *, 'score' as section from url_score_comparisons
"""

_SEARCH_COLUMNS = """
s.url_id, s.url, s.url_domain, s.tld, s.result_code, s.created_at, p.name as submitter, k.phishing_votes, k.legitimate_votes,
(select count(distinct m.rule_id) from url_rule_matches m where m.url_id = s.url_id) as rule_count,
(select max(o.vote_value) from votes o where o.url_id = s.url_id and o.user_id = 7) as current_user_vote
"""



def _audit() -> str:
    def unique(table: str, columns: str, key: str | None = None) -> str:
        return f"select '{table}' table_name, 'unique' check_name, '{columns}' column_names, count(*) - count(distinct {key or columns}) violations from {table}"

    def allowed(table: str, column: str, values: str) -> str:
        return f"select '{table}', 'allowed', '{column}', count(*) filter ({column} not in ({values})) from {table}"

    def required(table: str, columns: str) -> list[str]:
        return [
            f"select '{table}', 'required', '{c}', count(*) filter ({c} is null) from {table}" for c in columns.split()
        ]

    def reference(table: str, column: str, target: str, key: str) -> str:
        return (
            f"select '{table}', 'reference', '{column}', count(*) filter ({column} is not null and {column} not in"
            f" (select {key} from {target})) from {table}"
        )

    levels = "'low', 'medium', 'high', 'critical'"
    lines = [
        unique("users", "user_id"),
        unique("users", "email"),
        unique("url_submissions", "url_id"),
        unique("url_submissions", "url"),
        unique("rules", "rule_id"),
        unique("rules", "rule_name"),
        unique("url_rule_matches", "match_id"),
        unique("url_rule_matches", "url_id,rule_id", "(url_id, rule_id)"),
        unique("statuses", "status_id"),
        unique("votes", "vote_id"),
        unique("votes", "user_id,url_id", "(user_id, url_id)"),
        unique("url_score_comparisons", "rep_id"),
        allowed("users", "role", "'admin', 'analyst', 'user'"),
        allowed("rules", "rule_type", "'keyword', 'regex', 'domain', 'length', 'tld', 'other'"),
        allowed("rules", "risk_level", levels),
        allowed("votes", "vote_value", "-1, 1"),
        allowed("url_score_comparisons", "risk_level", levels),
        *required("users", "user_id name email role created_at"),
        *required("url_submissions", "url_id user_id url url_domain created_at"),
        *required("rules", "rule_id rule_name"),
        *required("url_rule_matches", "match_id url_id rule_id matched_at"),
        *required("statuses", "status_id url_id result_code label created_at"),
        *required("votes", "vote_id user_id url_id vote_value created_at"),
        *required("url_score_comparisons", "rep_id url_id created_at"),
        reference("url_submissions", "user_id", "users", "user_id"),
        reference("url_rule_matches", "url_id", "url_submissions", "url_id"),
        reference("url_rule_matches", "rule_id", "rules", "rule_id"),
        reference("statuses", "url_id", "url_submissions", "url_id"),
        reference("statuses", "reviewer_id", "users", "user_id"),
        reference("votes", "user_id", "users", "user_id"),
        reference("votes", "url_id", "url_submissions", "url_id"),
        reference("url_score_comparisons", "url_id", "url_submissions", "url_id"),
    ]
    return " union all ".join(lines)


def _job_reports() -> str:
    labels = {
        "reclassify_votes": "Apply vote-driven classification",
        "recompute_scores": "Recalculate blended risk scores",
        "cleanup_urls": "Remove inactive submissions",
        "cleanup_rule_matches": "Clean orphaned rule matches",
        "promote_users": "Promote active reporters",
        "auto_classify_pending": "Auto-classify pending URLs",
    }
    counts = {
        "reclassify_votes": f"select count(*) from ({_VOTED_CODE}) where updated_at is not null",
        "recompute_scores": "select count(*) from url_score_comparisons where url_id in (select url_id from url_submissions)",
        "cleanup_urls": f"select (select count(*) from url_submissions) - count(*) from ({_idle('url_submissions')})",
        "cleanup_rule_matches": f"select count(*) from ({_BENIGN})",
        "promote_users": "select count(*) from (select user_id from url_submissions group by 1 having count(*) >= 10)",
        "auto_classify_pending": "select count(*) from url_submissions where result_code is null",
    }
    lines = [
        f"select '{name}' as action, ({counts[name]}) as rows_affected, '{label} complete. Rows affected: ' || ({counts[name]}) || '.' as message"
        for name, label in labels.items()
    ]
    lines.append(
        "select 'import_urlhaus', inserted, 'Import URLHaus feed complete. Imported ' || inserted || ' URLs (skipped ' || skipped || ').'"
        f" from ({_feed_counts(250)})"
    )
    return " union all ".join(lines)


def _deleted() -> str:
    gone_urls = (
        "select url_id from url_submissions where result_code = 'SUSPICIOUS'"
        " or user_id in (select user_id from users where role = 'analyst')"
    )
    gone_users = "select user_id from users where role = 'analyst'"
    gone_rules = "select rule_id from rules where risk_level is null"
    kept = {
        "users": f"user_id not in ({gone_users})",
        "url_submissions": f"url_id not in ({gone_urls})",
        "rules": f"rule_id not in ({gone_rules})",
        "url_rule_matches": f"url_id not in ({gone_urls}) and rule_id not in ({gone_rules})",
        "statuses": f"url_id not in ({gone_urls})",
        "votes": f"url_id not in ({gone_urls}) and user_id not in ({gone_users})",
        "url_score_comparisons": f"url_id not in ({gone_urls})",
    }
    ids = dict(users="user_id", url_submissions="url_id", rules="rule_id", url_rule_matches="match_id", statuses="status_id")
    ids |= dict(votes="vote_id", url_score_comparisons="rep_id")
    lines = [f"select '{t}' as table_name, {ids[t]} as row_id from {t} where {w}" for t, w in kept.items()]
    lines.append(
        "select 'statuses without reviewer', status_id from statuses"
        f" where url_id not in ({gone_urls}) and (reviewer_id is null or reviewer_id in ({gone_users}))"
    )
    return " union all ".join(lines)


_COMMUNITY = f"""
select url_id, (select min(user_id) from users where role = 'admin') as reviewer_id,
       case when mean > 0.5 then 'PHISHING' when mean < -0.5 then 'LEGITIMATE' else 'SUSPICIOUS' end as result_code,
       case when mean > 0.5 then 'Community Confirmed Phishing' when mean < -0.5 then 'Community Confirmed Legitimate'
            else 'Under Community Review' end as label,
       'Automated status update based on ' || n || ' community votes. Average vote: ' || round(mean, 2) as description,
       {_AS_OF} as created_at
from (select url_id, count(*) as n, avg(vote_value) as mean from votes group by 1)
where n >= 2 and not exists (from statuses t where t.url_id = votes.url_id and t.created_at > {_AS_OF} - interval 1 day)
""".replace("votes.url_id", "x.url_id").replace("votes group by 1)", "votes group by 1) x")

_BODIES: dict[str, str] = {
    "users_by_role": "select user_id, name, email, role from users",
    "user_roles": "select user_id, name, email, role from users",
    "phishing_urls": "select url, result_code from url_submissions where result_code = 'PHISHING'",
    "result_counts": "select result_code, count(*) as url_count from url_submissions group by all",
    "contributor_stats": _CONTRIBUTORS,
    "contributor_stats_top": f"{_CONTRIBUTORS} order by total_submissions desc, user_id limit 10",
    "rule_usage": """
select r.rule_id, r.rule_name, r.rule_type, r.risk_level, count(m.url_id) as urls_matched
from rules r left join url_rule_matches m using (rule_id) group by all""",
    "vote_distribution": f"select s.url_id, s.url, k.phishing_votes, k.legitimate_votes from url_submissions s join ({_VOTE_SPLIT}) k using (url_id)",
    "url_listing": """
select s.url_id, s.url, s.url_domain, s.tld, s.result_code, p.name as submitter_name, p.email as submitter_email,
       count(m.rule_id) as matched_rules_count, string_agg(r.rule_name, ', ' order by r.rule_name) as matched_rule_names,
       s.created_at, s.updated_at
from url_submissions s join users p using (user_id) left join url_rule_matches m on m.url_id = s.url_id
                       left join rules r on r.rule_id = m.rule_id
group by all""",
    "vote_conflicts": _CONFLICTS,
    "vote_conflicts_top": f"""select * from ({_CONFLICTS})
order by total_votes desc, url_id desc, review_status nulls first, review_description nulls first limit 10""",
    "risk_rankings": f"{_RANKED} order by risk_score desc, url_id, risk_level nulls first, avg_score nulls first limit 20",
    "risk_rankings_all": _RANKED,
    "url_analysis_report": """
select s.url_id, s.url, s.url_domain, s.tld, s.result_code, count(distinct m.rule_id) as rules_triggered,
       count(distinct v.user_id) as voters_count, count(distinct t.status_id) as review_count,
       max(t.created_at) as last_review_date,
       case least(count(distinct m.rule_id), 3) when 3 then 'High Risk' when 2 then 'Medium Risk' when 1 then 'Low Risk'
            else 'No Rules Matched' end as risk_assessment,
       ifnull(x.avg_score, 0.0) as external_score
from url_submissions s left join url_rule_matches m on m.url_id = s.url_id left join votes v on v.url_id = s.url_id
     left join statuses t on t.url_id = s.url_id left join url_score_comparisons x on x.url_id = s.url_id
group by s.url_id, s.url, s.url_domain, s.tld, s.result_code, x.avg_score
having count(m.rule_id) + count(v.user_id) > 0""",
    "top_rule_submitters": """
select p.user_id, p.name, p.email, p.role, count(distinct s.url_id) as urls_submitted, count(*) as total_rule_matches,
       round(count(*)::double / count(distinct s.url_id), 6) as avg_rules_per_url
from users p join url_submissions s using (user_id) join url_rule_matches m on m.url_id = s.url_id
where p.role = 'user' group by all""",
    "risk_categories": """
select 'High_Risk_Phishing' as category, s.url_id, s.url, s.url_domain, s.result_code, count(*) as rule_count
from url_submissions s, url_rule_matches m, rules r
where m.url_id = s.url_id and r.rule_id = m.rule_id and s.result_code = 'PHISHING' and r.risk_level in ('high', 'critical')
group by all having count(*) > 1
union
select 'Suspicious_TLD', s.url_id, s.url, s.url_domain, s.result_code, count(*)
from url_submissions s, url_rule_matches m, rules r
where m.url_id = s.url_id and r.rule_id = m.rule_id and (r.rule_type = 'tld' or s.tld in ('.tk', '.ml', '.ga'))
group by all""",
    "review_timeline": f"""
select s.url_id, s.url, s.result_code, s.created_at as submission_date, t.status_id, t.label as status_label,
       t.result_code as review_result, p.name as reviewer_name, p.role as reviewer_role, t.created_at as review_date,
       round(julian(t.created_at) - julian(s.created_at), 6) as days_between_submission_and_review
from url_submissions s left join statuses t using (url_id) left join users p on p.user_id = t.reviewer_id
where s.created_at >= {_AS_OF} - interval 30 day and (t.reviewer_id is not null or s.result_code is not null)""",
    "rule_effectiveness": """
select r.rule_id, r.rule_name, r.rule_type, r.risk_level, count(distinct m.url_id) as urls_matched,
       count(distinct m.url_id) filter (s.result_code = 'PHISHING') as phishing_matches,
       count(distinct m.url_id) filter (s.result_code = 'LEGITIMATE') as legitimate_matches,
       round(count(distinct m.url_id) filter (s.result_code = 'PHISHING')::double / count(distinct m.url_id) * 100, 2)
         as phishing_accuracy_percent
from rules r join url_rule_matches m using (rule_id) left join url_submissions s on s.url_id = m.url_id
group by all order by urls_matched desc, phishing_accuracy_percent desc, rule_id limit 25""",
    "tld_submission_rank": """
select url_id, url, url_domain, tld, result_code, created_at,
       row_number() over (partition by tld order by created_at desc, url_id desc) as submission_rank_in_tld,
       count(*) over (partition by tld) as total_submissions_in_tld
from url_submissions where tld is not null""",
    "dashboard_totals": """
select count(*) as total_urls, count(*) filter (result_code = 'PHISHING') as phishing,
       count(*) filter (result_code = 'LEGITIMATE') as legitimate, count(*) filter (result_code = 'SUSPICIOUS') as suspicious,
       count(*) - count(result_code) as unknown, (select count(*) from users) as total_users,
       (select count(*) from rules) as total_rules
from url_submissions""",
    "recent_urls": f"""
select s.url_id, s.url, s.url_domain, s.result_code, s.created_at, p.name as submitter, k.phishing_votes, k.legitimate_votes
from url_submissions s join users p using (user_id) join ({_VOTE_SPLIT}) k on k.url_id = s.url_id
order by s.created_at desc, s.url_id desc limit 5""",
    "search_urls": f"""
select {_SEARCH_COLUMNS}
from url_submissions s join users p using (user_id) join ({_VOTE_SPLIT}) k on k.url_id = s.url_id
where (lower(s.url) like '%a%ount%' or lower(s.url_domain) like '%a%ount%') and s.result_code = 'PHISHING'
  and s.url_id in (select url_id from url_rule_matches where rule_id = 4)
order by s.created_at desc, s.url_id desc limit 100""",
    "search_urls_all": f"""
select {_SEARCH_COLUMNS}
from url_submissions s join users p using (user_id) join ({_VOTE_SPLIT}) k on k.url_id = s.url_id
where contains(lower(s.url), 'p/1')""",
    "status_facet": """
select ifnull(result_code, '') as result_code, count(*) as url_count from url_submissions s
where contains(lower(url), 'p/1') and exists (from url_rule_matches m where m.url_id = s.url_id and m.rule_id = 4)
group by 1""",
    "user_facet": """
select user_id, count(*) as url_count from url_submissions s
where contains(lower(url), 'p/1') and result_code = 'LEGITIMATE'
  and exists (from url_rule_matches m where m.url_id = s.url_id and m.rule_id = 4)
group by 1""",
    "search_facets": """
with found as (
  from url_submissions s
  where contains(lower(url), 'p/1') and exists (from url_rule_matches m where m.url_id = s.url_id and m.rule_id = 4))
select 'result_code' as facet, ifnull(result_code, '') as value, count(*) as url_count from found where user_id = 7 group by 2
union all select 'user_id', user_id::varchar, count(*) from found where result_code = 'LEGITIMATE' group by 2
union all select 'tld', tld, count(*) from found where user_id = 7 and result_code = 'LEGITIMATE' group by 2
union all select 'total', null, count(*) from found where user_id = 7 and result_code = 'LEGITIMATE' having count(*) > 0""",
    "rule_catalog": "select rule_id, rule_name, rule_type, risk_level from rules",
    "url_dossier": _DOSSIER,
    "available_rules": """
select s.url_id, string_agg(r.rule_name, ', ' order by r.rule_name) as available_rules, count(*) as available_count
from url_submissions s, rules r
where not exists (from url_rule_matches m where m.url_id = s.url_id and m.rule_id = r.rule_id)
group by 1""",
    "viewer_votes": """
select s.url_id, s.url_id % 100 as user_id, v.vote_value as current_user_vote
from url_submissions s left join votes v on v.url_id = s.url_id and v.user_id = s.url_id % 100""",
    "feed_summary": """
select count(*) as url_count, max(s.created_at) as last_import
from url_submissions s join users p using (user_id) where p.email = 'customer.7@example.com'""",
    "vote_tally": """
select url_id, count(*) filter (vote_value = 1) as phishing_votes, count(*) filter (vote_value = -1) as legitimate_votes
from votes group by 1""",
    "health_count": "select count(*) as url_count from url_submissions",
    "inserted_url_check": """
select s.url_id, s.url, s.url_domain, s.result_code, s.created_at, count(m.rule_id) as rules_matched
from url_submissions s left join url_rule_matches m using (url_id) where s.url = 'https://bit.ly/p/11' group by all""",
    "recently_updated": f"""
select url_id, url, result_code, updated_at from ({_VOTED_CODE}) where updated_at >= {_AS_OF} - interval 1 minute
order by updated_at desc, url_id limit 5""",
    "status_text_search": """
select status_id, url_id, label, result_code, description from statuses where description ilike '%seed_review%'
order by created_at desc, status_id limit 5""",
    "activity_counts": """
select count(*) as remaining_urls, count(*) filter (url_id in (select url_id from votes)) as urls_with_votes
from url_submissions""",
    "rule_match_check": """
select r.rule_id, r.rule_name, count(m.url_id) as urls_matched
from rules r left join url_rule_matches m using (rule_id) where r.rule_name = 'NATION_3' group by all""",
    "top_scores": """
select url_id, avg_score, risk_level, external_source from url_score_comparisons
order by avg_score desc nulls last, rep_id limit 5""",
    "match_validity": """
select count(*) as total_rule_matches,
       count(*) filter (url_id in (select url_id from url_submissions) and rule_id in (select rule_id from rules)) as valid_matches
from url_rule_matches""",
    # The reader numbers rows by their place in the files.
    "feed_rows": f"select n.place as seq, f.* exclude (seq) from ({_FEED_ROWS}) f join (select seq, row_number() over (order by seq) - 1 as place from feed) n using (seq)",
    "export_urls": f"""
select s.url as "URL", s.url_domain as "Domain", s.tld as "TLD", s.result_code as "Status", p.name as "Submitter",
       strftime(s.created_at, '%Y-%m-%d %H:%M:%S') as "Submitted", cast(k.phishing_votes as varchar) as "Phishing votes",
       cast(k.legitimate_votes as varchar) as "Legitimate votes"
from url_submissions s join users p using (user_id) join ({_VOTE_SPLIT}) k on k.url_id = s.url_id""",
    "apply_snapshot": _VOTED_CODE,
    "apply_changes": f"""
select 'url_submissions' as table_name, url_id as row_id, result_code from ({_VOTED_CODE})
union all
select 'url_rule_matches', match_id, null from url_rule_matches where match_id not in (select match_id from ({_BENIGN}))""",
    "parse_urls": f"""
select page_id, url_domain, tld, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme
from ({sql_url_parts("pages")})""",
    "submit_urls": rf"""
select seq, user_id, url, url_domain, tld, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) as scheme,
       length(url) as url_length, result_code, reason
from ({_SUBMITTED})""",
    "store_submissions": f"""
select url_id, user_id, url, url_domain, tld, result_code, created_at from url_submissions
union all
select (select max(url_id) from url_submissions) + row_number() over (order by seq), user_id, url, url_domain, tld, result_code, {_AS_OF}
from ({_SUBMITTED}) where reason is null""",
    "link_named_rules": """
select s.url_id, r.rule_id, 'auto' as match_details
from url_submissions s, rules r
where s.tld = '.tk' and (r.rule_name in ('NATION_3', 'NATION_4') or (r.rule_type = 'keyword' and r.pattern ilike '%verify%'))
  and not exists (from url_rule_matches m where m.url_id = s.url_id and m.rule_id = r.rule_id)""",
    "add_rule_matches": """
select url_id, rule_id, match_details, reason, count(*) as request_count
from (select *, case when problem is not null then problem
                     when turn > 1 or exists (from url_rule_matches m where m.url_id = q.url_id and m.rule_id = q.rule_id)
                     then 'already_applied' end as reason
      from (select *, row_number() over (partition by url_id, rule_id, problem is null order by seq) as turn
            from (select seq, url_id, rule_id, nullif(trim(match_details), '') as match_details,
                         case when url_id not in (select url_id from url_submissions) then 'unknown_url'
                              when rule_id not in (select rule_id from rules) then 'unknown_rule' end as problem
                  from match_requests)) q)
group by all""",
    "remove_rule_matches": """
select match_id, url_id, 'kept' as outcome from url_rule_matches
where (match_id, url_id) not in (select l_orderkey * 25 + l_partkey % 23, l_orderkey from lineitem where l_tax > 0.04)
union all
select distinct l_orderkey * 25 + l_partkey % 23, l_orderkey, 'not_found' from lineitem
where l_tax > 0.04 and (l_orderkey * 25 + l_partkey % 23, l_orderkey) not in (select match_id, url_id from url_rule_matches)""",
    "delete_submissions": _deleted(),
    "fold_votes": _FOLDED,
    "stream_votes": _FOLDED.replace("from vote_log", f"from (select * from ({_ARRIVED}) where watermark is null or ts >= watermark) as vote_log"),
    "stream_votes_late": f"select event_id, ts, user_id, url_id, vote_value, watermark from ({_ARRIVED}) where ts < watermark",
    "stream_sessions_all": _SESSIONS,
    "reclassify_by_votes": _VOTED_CODE,
    "annotate_admin_statuses": """
select t.* exclude (url_code, hit) replace (
  case when hit then t.description || ' | Updated by system based on agreement threshold' else t.description end as description,
  case when hit then ifnull(t.url_code, t.result_code) else t.result_code end as result_code)
from (select t.*, s.result_code as url_code,
             ifnull(p.role = 'admin', false) and (select count(*) from votes v where v.url_id = t.url_id) >= 2 as hit
      from statuses t join url_submissions s using (url_id) left join users p on p.user_id = t.reviewer_id) t""",
    "cleanup_inactive": _idle("url_submissions"),
    "cleanup_inactive_scores": _idle("url_score_comparisons"),
    "add_rule_and_match": """
select url_id, 'Suspicious Subdomain Count' as rule_name, 'Matched: Multiple subdomain levels detected' as match_details
from url_submissions where length(url) - length(replace(url_domain, '.', '')) >= 4""",
    "recompute_scores": _SCORED,
    "community_statuses": _COMMUNITY,
    "community_statuses_stored": f"""
select status_id, url_id, reviewer_id, result_code, label, description, created_at from statuses where label like '%Community%'
union all
select * from (
  select (select max(status_id) from statuses) + row_number() over (order by url_id) as status_id,
         url_id, reviewer_id, result_code, label, description, created_at from ({_COMMUNITY}))
where label like '%Community%'""",
    "label_text_search": """
select status_id, url_id, label, result_code, description from statuses where label ilike '%confirmed%'
order by created_at desc, status_id limit 5""",
    "url_display": f"""
select url_id, url, strftime(created_at, '%Y-%m-%d %H:%M') as submitted,
       printf('%.2f%%', ifnull(100.0 * k.phishing_votes / nullif(k.phishing_votes + k.legitimate_votes, 0), 0.0)) as phishing_share
from url_submissions left join ({_VOTE_SPLIT}) k using (url_id)""",
    "store_feed_urls": f"""
select (select max(url_id) from url_submissions) + row_number() over (order by seq) as url_id,
       (select max(user_id) from users) + 1 as user_id, url, url_domain, tld, 'PHISHING' as result_code, created_at
from (select * from ({_FEED_NEW}) order by seq limit 250)""",
    "store_feed_statuses": f"""
select (select max(status_id) from statuses) + row_number() over (order by seq) as status_id,
       (select max(url_id) from url_submissions) + row_number() over (order by seq) as url_id, cast(null as bigint) as reviewer_id,
       'PHISHING' as result_code, label, description, reviewed_at as created_at
from (select * from ({_FEED_NEW}) order by seq limit 250)""",
    "cleanup_rule_matches": f"select * from url_rule_matches where match_id not in (select match_id from ({_BENIGN}))",
    "promote_users": """
select p.* replace (case when p.role = 'user' and s.n >= 10 and s.bad >= 5 then 'analyst' else p.role end as role)
from users p left join (select user_id, count(*) as n, count(*) filter (result_code = 'PHISHING') as bad
                        from url_submissions group by 1) s using (user_id)""",
    "auto_classify": _classified(strict=False),
    "auto_classify_strict": _classified(strict=True),
    "feed_import": f"select * from ({_FEED_NEW}) order by seq limit 250",
    "feed_import_25": f"select * from ({_FEED_NEW}) order by seq limit 25",
    "feed_import_all": _FEED_NEW,
    "stream_feed": _FEED_NEW,
    "feed_import_counts": _feed_counts(250),
    "feed_import_counts_25": _feed_counts(25),
    "ensure_feed_user": f"""
select user_id, name, email, role, created_at from users
union all
select (select max(user_id) from users) + 1, 'URLHaus Feed', 'threat-feed@snarelight.example', 'analyst', {_AS_OF}
where 'threat-feed@snarelight.example' not in (select email from users)""",
    "register_users": """
select seq, name, email, case when reason is null then same_fold > 1 end as case_variant, reason
from (select *, count(*) filter (reason is null) over (partition by lower(email))
                + (select count(*) from users p where lower(p.email) = lower(r.email)) as same_fold
      from (select *, case when problem is not null then problem
                           when email in (select email from users) or turn > 1 then 'email_taken' end as reason
            from (select *, row_number() over (partition by email, problem is null order by seq) as turn
                  from (select seq, trim(name) as name, trim(email) as email,
                               case when length(trim(name)) < 2 then 'name_too_short'
                                    when not contains(email, '@') or length(trim(email)) > 255 then 'invalid_email' end as problem
                        from account_requests))) r)""",
    "maintenance_run": _job_reports(),
    "evaluate_rules": _RULE_TESTS.format(urls="url_submissions", long_url=38)
    + " and not exists (from url_rule_matches m where m.url_id = s.url_id and m.rule_id = r.rule_id)",
    "stream_submit": f"""
select n.seq, n.user_id, n.url, n.url_domain, n.tld, n.result_code, h.rule_id
from ({_SUBMITTED}) n
left join ({_RULE_TESTS.format(urls=f"(select seq as url_id, url, url_domain, tld from ({_SUBMITTED}))", long_url=75)}) h on h.url_id = n.seq
where n.reason is null""",
    "integrity_audit": _audit(),
    "user_sessions": _SESSIONS,
    # A stream closes a session once the watermark (newest event less one hour) has passed its expiry.
    "stream_sessions": f"select * from ({_SESSIONS}) where expires_at <= (select max(ts) from events) - interval 1 hour",
}

ORACLES: dict[str, str] = {name: f"with {duckdb_ctes()}\nselect * from ({body.strip()})" for name, body in _BODIES.items()}

"""The query available_rules reports the URLs of all users, each with the rules it lacks."""

from collections import defaultdict

import __spark_entry__ as contract
from snarelight.driver.tables import triage_tables

SF_DIR = "/root/testdata/sf0.001"


def test_every_url_that_lacks_a_rule_is_reported(spark):
    t = triage_tables(spark, SF_DIR)
    rules = {r["rule_id"]: r["rule_name"] for r in t.rules.collect()}
    taken = defaultdict(set)
    for r in t.url_rule_matches.select("url_id", "rule_id").collect():
        taken[r["url_id"]].add(r["rule_id"])
    want = {}
    for r in t.url_submissions.select("url_id").collect():
        free = sorted(n for i, n in rules.items() if i not in taken[r["url_id"]])
        if free:
            want[r["url_id"]] = (", ".join(free), len(free))
    rows = contract.queries()["available_rules"](spark, SF_DIR).collect()
    assert len(rows) == len(want)
    assert {r["url_id"]: (r["available_rules"], r["available_count"]) for r in rows} == want

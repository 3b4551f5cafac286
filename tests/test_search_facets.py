"""All facets of a search from one scan, against the facets counted one by one."""

import contextlib
import io
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from helpers import rows
from snarelight.plans import search
from snarelight.plans.search import Search
from snarelight.session import new_folder

SEARCHES = [
    Search(text=text, result_code=code, user_id=user, rule_id=rule, tld=tld)
    for text, code, user, rule, tld in product(["", "a"], ["", "PHISHING", "nope"], [None, "3", "x"], [None, 1], ["", "com"])
    if (text, rule) in (("", None), ("a", 1))
]


@pytest.fixture
def gaps(seed):
    """The seed URLs with missing codes, users and domains."""
    urls = seed.url_submissions
    for column, every in (("result_code", 3), ("user_id", 4), ("tld", 5)):
        urls = urls.withColumn(column, F.when(F.col("url_id") % every > 0, F.col(column)))
    return seed.with_tables(url_submissions=urls)


def one_by_one(t, chosen):
    out = {("result_code", code): n for code, n in rows(search.status_facet(t, chosen))}
    out |= {("user_id", None if user is None else str(user)): n for user, n in rows(search.user_facet(t, chosen))}
    out |= {("tld", tld): n for tld, n in Counter(r.tld for r in search.matching(t, chosen.without("tld")).collect()).items()}
    total = search.matching(t, chosen).count()
    return out | ({("total", None): total} if total else {})


@pytest.mark.parametrize("chosen", SEARCHES[::3])
def test_facets_equal_those_counted_one_by_one(gaps, chosen):
    got = {(facet, value): n for facet, value, n in rows(search.search_facets(gaps, chosen))}
    assert got == one_by_one(gaps, chosen)


def test_no_urls_give_no_rows(seed):
    none = seed.with_tables(url_submissions=seed.url_submissions.where("false"))
    assert search.search_facets(none).count() == 0


def test_one_scan_one_shuffle_and_the_text_filter_at_the_scan(spark, seed):
    folder = new_folder(spark, "facets")
    seed.url_submissions.write.parquet(folder)
    t = seed.with_tables(url_submissions=spark.read.parquet(folder))
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        search.search_facets(t, Search(text="a", result_code="PHISHING", user_id=3)).explain("simple")
    plan = said.getvalue()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1
    assert "created_at" not in plan[plan.index("ReadSchema") :]

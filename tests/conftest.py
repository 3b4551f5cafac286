import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from helpers import DAY, table  # noqa: E402

from snarelight.model import Tables  # noqa: E402
from snarelight.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# People and score sources are made up. The URLs, rules, codes, votes and scores, which expected results need.
SEED = {
    "users": [
        (1, "Root Account", "admin@triage.example", "admin", DAY),
        (2, "Lead Reviewer", "analyst@triage.example", "analyst", DAY),
        (3, "Priya Nair", "priya.nair@example.com", "user", DAY),
        (4, "Olga Brandt", "olga.brandt@example.com", "user", DAY),
        (5, "Tomas Ferreira", "tomas.ferreira@example.com", "user", DAY),
    ],
    "rules": [
        (1, "Suspicious Keywords", None, "verify|secure|update|account|login", "keyword", "high", None),
        (2, "IP Address in URL", None, r"^\d+\.\d+\.\d+\.\d+", "regex", "critical", None),
        (3, "Suspicious TLD", None, None, "tld", "medium", ".tk"),
        (4, "Long URL Length", None, None, "length", "medium", None),
        (5, "Multiple Dashes", None, "-{3,}", "regex", "low", None),
        (6, "Percent Encoding", None, "%[0-9A-F]{2}", "regex", "high", None),
        (7, "Suspicious Domain Pattern", None, "paypal|amazon|microsoft", "keyword", "high", None),
        (8, "Short URL Service", None, r"bit\.ly|tinyurl|goo\.gl", "regex", "medium", None),
    ],
    "url_submissions": [
        (i, user, url, domain, tld, code, DAY, None)
        for i, user, url, domain, tld, code in [
            (1, 3, "https://verify-paypal-account-secure.tk/login", "verify-paypal-account-secure.tk", ".tk", "PHISHING"),
            (2, 4, "https://www.amazon.com/products/item123", "amazon.com", ".com", "LEGITIMATE"),
            (3, 3, "http://192.168.1.100/secure-update-account", "192.168.1.100", None, "PHISHING"),
            (4, 5, "https://www.microsoft.com/account/signin", "microsoft.com", ".com", "LEGITIMATE"),
            (5, 4, "https://bit.ly/suspicious-link-xyz", "bit.ly", ".ly", "SUSPICIOUS"),
            (6, 3, "https://update-bank-account-now.tk/verify", "update-bank-account-now.tk", ".tk", "PHISHING"),
            (7, 5, "https://www.github.com/user/repo", "github.com", ".com", "LEGITIMATE"),
            (8, 4, "http://suspicious-domain-with-many-dashes---here.com/path", "suspicious-domain-with-many-dashes---here.com", ".com", "SUSPICIOUS"),
            (9, 3, "https://login-apple-verify-id.tk/account", "login-apple-verify-id.tk", ".tk", "PHISHING"),
            (10, 5, "https://www.google.com/search?q=test", "google.com", ".com", "LEGITIMATE"),
        ]
    ],
    "url_rule_matches": [
        (i + 1, url, rule, None, DAY)
        for i, (url, rule) in enumerate(
            [(1, 1), (1, 3), (1, 7), (3, 2), (3, 1), (5, 8), (6, 1), (6, 3), (8, 5), (9, 1), (9, 3)]
        )
    ],
    "statuses": [
        (1, 1, 2, "PHISHING", "Confirmed Phishing", "first", DAY),
        (2, 2, 1, "LEGITIMATE", "Verified Legitimate", "second", DAY),
        (3, 3, 2, "PHISHING", "Confirmed Phishing", "third", DAY),
        (4, 4, 1, "LEGITIMATE", "Verified Legitimate", "fourth", DAY),
        (5, 5, 2, "SUSPICIOUS", "Under Review", "fifth", DAY),
    ],
    "votes": [
        (i + 1, user, url, value, DAY)
        for i, (user, url, value) in enumerate([(3, 1, 1), (4, 1, 1), (5, 2, -1), (3, 3, 1), (4, 4, -1), (5, 5, 1)])
    ],
    "url_score_comparisons": [
        (1, 1, "Engine Alpha", 0.85, 0.90, "high", DAY),
        (2, 2, "Engine Beta", 0.05, 0.02, "low", DAY),
        (3, 3, "Engine Alpha", 0.92, 0.95, "critical", DAY),
        (4, 4, "Engine Beta", 0.03, 0.01, "low", DAY),
        (5, 5, "Engine Gamma", 0.65, 0.70, "medium", DAY),
    ],
}


@pytest.fixture(scope="session")
def seed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("seed"))
    for name, data in SEED.items():
        table(spark, name, data).coalesce(1).write.parquet(f"{root}/{name}")
    return Tables.from_parquet(spark, root)

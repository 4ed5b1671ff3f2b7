import random

import pytest

from tests.conftest import duckdb_rows, rows_of
from tidemark.llm import url_filter
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES
from tidemark.llm.url_filter import Rule, filter_urls

RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"), Rule("bad.net", "", "block"), Rule("good.bad.net", "/a/b", "allow"), Rule("tie.net", "/", "allow"), Rule("tie.net", "/", "block")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
    path = rest[end:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def urls():
    rng = random.Random(3)
    made = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'www.', 'a.B.'])}{rng.choice(['example.org', 'Example.ORG', 'x.com', 'bad.net', 'good.bad.net', 'tie.net', 'notexample.org', 'org', 'com:80'])}{rng.choice(['', '/', '/es', '/es/', '/es/x', '/en/1', '/en/12/3', '/en/2', '/fr/', '/de/q', '/a/b/c', '/a/bc', '/A/b'])}{rng.choice(['', '?q=/es/', '#f', '?a#b'])}" for _ in range(300)]
    return [*made, None, "", "no scheme", "://", "x://", "http:///path", "http://é.org/ü", "a://b://c/d", "http://x.org/" + "s/" * 3000]


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_RULES, 1])
def test_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    rows = [(i, u, "clash", 1) for i, u in enumerate(urls())]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string, Host int"), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(rows[r["page_id"]][1]), r["url"]


def test_query_matches_its_sql(spark, data_dir):
    got = QUERIES["op7_url_filter"](spark, data_dir)
    names, want = duckdb_rows(ORACLES["op7_url_filter"], data_dir)
    assert sorted(got.columns) == names and rows_of(got) == want


def test_empty(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []

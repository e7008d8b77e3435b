import re

import pytest
from pyspark.sql import functions as F

from sayplace.llm.common import Workspace
from sayplace.llm.queries import RULES, SUFFIXES
from sayplace.llm.url_filter import domain, judge, reputation, suffix

URLS = [
    None, "", "no scheme", "http://", "http://Www.EXAMPLE.com/en/x?y#z", "https://a.example.com/en/", "https://example.com/en", "http://www.example.com/de/1", "x://b.net/es/q", "x://b.net/fr/", "x://b.net/it/",
    "http://com/", "http://com", "http://xcom/", "http://a.org?b://c.com/en/", "http://notexample.com/en/", "http://h.org/\npath#f", "http://É.org/a"]


def by_hand(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_rules(spark):
    df = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(URLS)] + [(1, URLS[1], "h", "p"), (None, URLS[4], "h", "p")], "page_id long, url string, host string, path string")
    none = spark.createDataFrame([], "id long, bad int")
    rows = judge(df, "page_id", "url", none, RULES, SUFFIXES).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        host, path, (rule, verdict) = by_hand(URLS[r.id] if r.id is not None else URLS[4])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "allow")
    assert judge(df.limit(0), "page_id", "url", none, RULES).count() == 0


def test_levels(spark):
    hosts = spark.createDataFrame([("a.b.example.com",), ("example.com",), ("b.org",), ("x.y.b.org",), ("com",), ("",)], "host string")
    top = suffix(F.col("host"), SUFFIXES)
    got = [tuple(r) for r in hosts.select("host", top, domain(F.col("host"), top)).collect()]
    assert got == [
        ("a.b.example.com", "example.com", "b.example.com"), ("example.com", "example.com", "example.com"), ("b.org", "org", "b.org"), ("x.y.b.org", "org", "b.org"), ("com", "com", "com"), ("", "", "")]


@pytest.fixture(scope="module")
def reputations(spark):
    pages = [("bad.spam.org", 1)] * 40 + [("worse.spam.org", 1)] * 38 + [("worse.spam.org", 0)] * 2 + [("good.fine.org", 0)] * 60 + [("odd.fine.org", 1)] + [("fine.org", 0)] * 30 + [(f"s{k}.misc.org", 0) for k in range(30)]
    hosts = [(h,) for h, _ in pages] + [("new.spam.org",), ("new.fine.org",), ("new.net",)]
    frame = reputation(Workspace(spark, "test"), spark.createDataFrame(pages, "host string, bad int"), spark.createDataFrame(hosts, "host string"), ["org"])
    return {r.host: r for r in frame.collect()}


def test_shrinkage(reputations):
    r = reputations
    assert r["bad.spam.org"].verdict == r["worse.spam.org"].verdict == "block"
    assert r["good.fine.org"].verdict == r["new.fine.org"].verdict == "allow"
    # One bad page of a good domain is shrunk towards it; a new host has its domain's mean.
    assert r["odd.fine.org"].mean < 0.9 and r["odd.fine.org"].verdict == "allow"
    assert r["new.spam.org"].mean > 0.7 > 0.3 > r["new.fine.org"].mean
    assert all(0 <= x.mean <= 1 and x.low <= x.mean for x in r.values())
    assert r["bad.spam.org"].n == 40 and r["new.net"].n == 0


def test_null_outcomes(spark):
    df = spark.createDataFrame([(1, "http://a.org/"), (2, "http://a.org/"), (2, "http://b.org/")], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, None), (2, 1), (None, 1), (9, 1)], "id long, bad int")
    assert judge(df, "page_id", "url", outcomes, []).count() == 3

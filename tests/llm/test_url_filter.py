"""Dated lists: intervals, suffixes and prefixes, ties, nulls; all against a loop."""

import random

from graphwright.llm.queries import oracle_sql, queries
from graphwright.llm.url_filter import filter_urls, validity_intervals
from tests.compare import duck, same

CAPTURE, ENTRY = "page_id long, url string, fetched long, list string", "list string, pattern string, action string, effective long, n int"


def test_query_agrees_with_sql(spark, small):
    same(queries()["op1_url_filter"](spark, small), duck(small), oracle_sql()["op1_url_filter"])


def test_intervals(spark):
    entries = [("l", "a.com", "add", 1, 0), ("l", "a.com", "remove", 5, 0), ("l", "a.com", "add", 7, 0), ("l", "a.com", "add", 7, 0), ("l", "b.com", "add", 3, 0), ("l", "b.com", "remove", 3, 0), ("l", None, "add", 1, 0), ("l", "c.com", "add", None, 0)]
    got = validity_intervals(spark.createDataFrame(entries, ENTRY))
    assert sorted(tuple(r) for r in got.collect()) == [("l", "a.com", 1, 5), ("l", "a.com", 7, None)]


def test_against_a_loop(spark):
    random.seed(1)
    hosts = ["a.com", "x.a.com", "b.org", "c.b.org", "a.com:80", "net"]
    captures = [(i, f"http://{random.choice(hosts)}/{random.choice(['', 'p', 'p/q', 'p/q/?z=1', 'pq'])}", random.randrange(12), "clash") for i in range(300)]
    captures += [(1, None, 3, ""), (2, "no url", 3, ""), (3, "http://a.com/", None, ""), captures[0], captures[0]]
    entries = [(f"l{random.randrange(2)}", random.choice(["a.com", "com", "b.org", "a.com/p", "b.org/p/q", "net"]), random.choice(["add", "add", "remove"]), random.randrange(12), 0) for _ in range(40)]
    got = filter_urls(spark.createDataFrame(captures, CAPTURE), spark.createDataFrame(entries, ENTRY)).collect()
    assert len(got) == len(captures)

    def state(pattern, name, at):
        known = [e for e in entries if e[0] == name and e[1] == pattern and e[3] <= at]
        if not known:
            return False
        last = max(e[3] for e in known)
        return all(e[2] == "add" for e in known if e[3] == last)

    def covering(url, at):
        if url is None or "://" not in url or at is None:
            return []
        rest = url.split("://")[1].split("?")[0]
        host, _, path = rest.partition("/")
        host = host.split(":")[0]
        found = []
        for pattern in {e[1] for e in entries}:
            h, _, p = pattern.partition("/")
            inside = (host == h or host.endswith("." + h)) if not p else host == h and ("/" + path.rstrip("/") + "/").startswith("/" + p + "/")
            found += [(pattern, name) for name in ("l0", "l1") if inside and state(pattern, name, at)]
        return found

    for r in got:
        expected = covering(r["url"], r["fetched"])
        assert r["active_entries"] == len(expected) and r["blocked"] == bool(expected), (r, expected)
        if expected:
            assert len(r["pattern"]) == max(len(p) for p, _ in expected)


def test_empty_tables(spark):
    captures, entries = spark.createDataFrame([(1, "http://a.com/", 3, "")], CAPTURE), spark.createDataFrame([("l", "a.com", "add", 1, 0)], ENTRY)
    none = filter_urls(captures, entries.limit(0)).first()
    assert none["blocked"] is False and none["pattern"] is None
    assert filter_urls(captures.limit(0), entries).count() == 0

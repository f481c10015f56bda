import random
import re

from gradus.llm import queries, url_filter

RULES = [(h, p, v, f"{h}{p}") for h, p, v in queries.RULES]
KIND = "host string, path string, verdict string, rule string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, entries, default="allow"):
    host, path = parts(url)
    fits = [e for e in entries if host and (host == e[0] or host.endswith("." + e[0])) and path.startswith(e[1])]
    best = max(fits, key=lambda e: (e[3] is not None, len(e[0]) + len(e[1]), len(e[0])), default=None)
    return (host, path, best[3] if best else None, best[2] if best else default)


def urls():
    rng = random.Random(1)
    hosts = ["example.net", "EXAMPLE.net", "a.b.example.com", "notexample.com", "org", "x.org", "net", "t.net:80", "deep.spam-farm.example.com", "", "É.net"]
    out = [f"{rng.choice(['http', 'https', 'ftp'])}://{h}{p}{q}" for h in hosts for p in ["", "/", "/en/", "/en", "/de/x", "/fr/y/z", "//"] for q in ["", "?a=/de/", "#/fr/", "?x://y"]]
    return out + [None, "", "no scheme", "://", "a://b://c/de/", "http://line\nbreak.net/en/x", "http://" + "long." * 300 + "example.net/en/" + "p" * 5000]


def test_against_brute_force(spark):
    entries = RULES + [("spam-farm.example.com", "", "block", None)]
    rows = list(enumerate(urls()))
    rows += [(None, "http://a.net/"), (3, rows[3][1]), (3, "http://other.org/fr/")]
    frame = spark.createDataFrame([(i, u, "mine") for i, u in rows], "page_id long, url string, host string")
    got = url_filter.judge(frame, spark.createDataFrame(entries, KIND)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *brute(u, entries)) for i, u in rows), key=repr), key


def test_long_hosts_and_longest_entries(spark):
    """A host of very many labels, entries of several labels, and path lengths that only some hosts have."""
    entries = [("a.b.c.d.net", "", "block", "a.b.c.d.net"), ("net", "/x/yy", "allow", "net/x/yy"), ("d.net", "/x", "block", None), ("NET", "/é", "block", "net/é")]
    rows = [(0, "http://" + "l." * 50_000 + "a.b.c.d.net/x"), (1, "http://d.net/x/yyy"), (2, "http://zd.net/x/y"), (3, "http://z.d.net/xx"), (4, "http://c.d.net"), (5, "http://q.net/é?"), (6, "http://..net/x/yy"), (7, "http://net./x/yy")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(entries, KIND)).collect()
    entries[3] = ("net", *entries[3][1:])
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {i: brute(u, entries) for i, u in rows}


def test_many_entries_and_false_hits(spark, monkeypatch):
    """A filter of one block passes nearly all, and the join still gives exact verdicts."""
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    entries = [(f"h{i}.example", "/a/", "block", f"h{i}.example/a/") for i in range(3000)]
    rows = [(i, f"http://www.h{i}.example/{'a' if i % 2 else 'b'}/x") for i in range(2900, 3100)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(entries, KIND)).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {i: brute(u, entries)[2:] for i, u in rows}


def test_empty(spark):
    none, listed = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], KIND)
    assert url_filter.judge(none, spark.createDataFrame(RULES, KIND)).count() == 0
    assert [tuple(r) for r in url_filter.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), listed).collect()] == [(1, "a.net", "/", None, "allow")]

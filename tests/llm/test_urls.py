import duckdb
import numpy as np
import pytest

from millrace.llm import common, urls

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "https://a.b.Example.ORG/en/1?q=/es/", "http://example.org/en/2", "http://org",
    "http://notexample.org/es/", "http://example.com/fr/", "http://com/de/#x", "http://x.com/de", "http://x.com?a=://y.org/", "x://a.org#/", "http://u@h.org:80/\n/p",
    "http://" + "a." * 3000 + "org/" + "p" * 5000, "http://example.org/es/x",
]


def slow(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    best = None
    for rule, verdict in urls.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


@pytest.fixture
def pages(spark):
    return lambda us: spark.createDataFrame([(k, u, "h", "clash") for k, u in enumerate(us)], "page_id long, url string, html string, host string")


def test_rules(spark, pages, data_dir):
    d = data_dir(pages=pages(URLS))
    got = {r.page_id: tuple(r)[1:] for r in urls.op4_url_filter(spark, d).collect()}
    assert got == {k: slow(u) for k, u in enumerate(URLS)}
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{d}/pages.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.sql(urls.OP4_SQL).fetchall()} == got
    assert urls.op4_url_filter(spark, data_dir(pages=pages([]))).collect() == []


def test_collisions_are_confirmed(spark, monkeypatch):
    """With all digests equal the full strings decide."""
    scratch = common.Scratch(spark, "test")
    monkeypatch.setattr(urls, "digest", lambda entries: np.zeros(len(entries), np.int64))
    # built in this process, for workers have the real digest
    import json

    folder = scratch.mkdir("i")
    _, top = common.open_fs(folder)
    rules = [b"a.org/\tallow", b"b.org/\tblock", b"c.org/x\tblock"]
    np.zeros(3, np.int64).tofile(f"{top}/shard-000000.keys")
    np.array([0, 12, 24, 37]).astype(np.int64).tofile(f"{top}/shard-000000.ends")
    open(f"{top}/shard-000000.blob", "wb").write(b"".join(rules))
    open(f"{top}/lengths.json", "w").write(json.dumps({"host": [5], "path": [1, 2]}))
    index = urls.Index(folder)
    assert index.find(["c.org/x", "a.org/", "d.org/", "b.org/"]) == ["block", "allow", None, "block"]


def test_large_sharded_list(spark):
    scratch = common.Scratch(spark, "test")
    folder = scratch.mkdir("big")
    rules = [(f"h{k}.net/", "block" if k % 2 else "allow") for k in range(3000)] + [("h1.net/", "allow"), (None, "block")]
    urls.build(spark.createDataFrame(rules, "rule string, verdict string"), folder, shards=5)
    asked = [(k, f"https://w.h{k}.net/p") for k in range(0, 4000, 7)]
    got = urls.judge(spark.createDataFrame(asked, "k long, url string"), folder).collect()
    assert len(got) == len(asked)
    for r in got:
        want = (f"h{r.k}.net/", "block" if r.k % 2 else "allow") if r.k < 3000 else (None, "allow")
        assert (r.rule, r.verdict) == want
    index = urls.Index(folder)
    assert len(index.shards) == 5 and all((s[0][1:] >= s[0][:-1]).all() for s in index.shards)
    assert index.find(["h1.net/"]) == ["block"]


def test_empty_list(spark, pages):
    scratch = common.Scratch(spark, "test")
    folder = scratch.mkdir("none")
    urls.build(spark.createDataFrame([], "rule string, verdict string"), folder)
    assert {r.verdict for r in urls.judge(pages(URLS), folder).collect()} == {"allow"}

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fit = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://a.net", "http://a.net/", "http://a.net?x=/en/", "https://x.Example.NET/en/1?q#f", "https://example.net/en", "https://notexample.net/en/",
    "https://b.example.com/de/", "https://example.com/DE/", "ftp://deep.er.org/fr/x", "http://org/fr/", "http://a.org/fr", "x://y://z.net/", "http://net./", "http://.net/", "http://a..net/en/", "http://É.net/", "http://a.net:80/", "://net/",
    "http://a.org#frag/fr/", "http://a.net/\n/en/", "http://example.net/en/" + "x" * 5000,
]


def test_edges(spark):
    df = spark.createDataFrame([(i, u, "k", "a") for i, u in enumerate(URLS)] + [(0, URLS[0], "k", "a"), (None, URLS[5], "k", "a")], "page_id bigint, url string, keys string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = urls.judge(df, rules).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        u = URLS[5] if r.page_id is None else URLS[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == brute(u, RULES), u
    assert urls.judge(df.filter(F.lit(False)), rules).count() == 0
    assert {r.verdict for r in urls.judge(df, rules.filter(F.lit(False))).collect()} == {"allow"}


def many(spark, seed):
    r = random.Random(seed)
    labels = ["a", "b", "c", "net", "org", "example"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "/".join(r.choice(["en", "de", "x"]) for _ in range(r.randint(0, 3)))
    rules = list({(host(), path()): r.choice(["block", "allow"]) for _ in range(60)}.items())
    rules = [(h, p, a) for (h, p), a in rules]
    pages = [(i, f"http://{host()}{path()}") for i in range(600)]
    return pages, rules, spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(rules, "host string, path string, action string")


@pytest.mark.parametrize("seed, most", [(1, urls.PART_BITS), (2, urls.PART_BITS), (1, 200)])
def test_many_rules(spark, monkeypatch, seed, most):
    """By cascades over all keys, and over parts of them in turn."""
    monkeypatch.setattr(urls, "PART_BITS", most)
    pages, rules, df, rf = many(spark, seed)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, rf).collect()}
    # of rules of one length any may stand where host and path split differently
    for i, u in pages:
        assert got[i] == brute(u, rules), u


def test_cascade_is_exact(spark):
    keys = spark.range(20000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b"), "id")
    levels = urls.cascade(keys, keys.filter("id % 7 = 0"))
    assert len(levels) >= 3
    rows = keys.toPandas()
    found = urls.member(levels, rows["a"].to_numpy(np.int64).view(np.uint64), rows["b"].to_numpy(np.int64).view(np.uint64))
    assert (found == (rows["id"] % 7 == 0)).all()

import pytest

from promptgauge.llm import url_filter as op
from promptgauge.llm.queries import URL_RULES

URLS = [
    "https://www.Example.com/en/page?x=1",
    "http://example.com/en/",
    "http://example.com/en",
    "http://a.b.example.com/en/x/y/z#frag",
    "http://shop.net/es/1",
    "http://shop.net/de/1",
    "http://net/fr/",
    "http://xnet/fr/",
    "http://plain.com",
    "http://plain.com?q=/en/",
    "HTTP://UPPER.COM/EN/",
    "no scheme",
    "http://",
    "",
    None,
    "http://example.com/en/" + "deep/" * 3000,
    "http://" + "sub." * 2000 + "example.com/en/",
    "ftp://a://example.com/en/",
    "http://example.com/en/\nnext",
]


def brute(url):
    at = url.find("://") if url else -1
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, action = max(fits, default=(0, None, "allow"))
    return host, path, rule, action


def rules(spark, rows=URL_RULES):
    return spark.createDataFrame(rows, "action string, host string, path string")


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    found = op.judged_urls(pages, rules(spark)).collect()
    assert sorted((r["page_id"], *r[1:]) for r in found if r["rule"]) == sorted((i, *brute(u)) for i, u in enumerate(URLS * 2) if brute(u)[2])
    assert {r["page_id"]: tuple(r[1:]) for r in found} == {i: brute(u) for i, u in enumerate(URLS * 2)} and len(found) == 2 * len(URLS)


def test_repeated_and_null_ids(spark):
    pages = spark.createDataFrame([(None, URLS[0]), (1, URLS[0]), (1, URLS[0]), (1, URLS[4])], "page_id long, url string")
    assert sorted(r["verdict"] for r in op.judged_urls(pages, rules(spark)).collect()) == ["allow"] * 3 + ["block"]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert op.judged_urls(pages, rules(spark)).collect() == []
    some = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [tuple(r) for r in op.judged_urls(some, rules(spark, [])).collect()] == [(1, "a.com", "/x", None, "allow")]


def test_equal_rules_block(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x/")], "page_id long, url string")
    both = rules(spark, [("allow", "a.com", "/x/"), ("block", "A.com", "/x/"), (None, "a.com", "/x/")])
    assert op.judged_urls(pages, both).first()["verdict"] == "block"


def test_bad_rule(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x/")], "page_id long, url string")
    with pytest.raises(Exception, match="a rule needs a path"):
        op.judged_urls(pages, rules(spark, [("allow", "a.com", "/x")])).collect()


def test_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x/")], "page_id long, url string")
    plan = op.judged_urls(pages, rules(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_of_equally_long_rules_the_greatest_wins(spark):
    rules = [("allow", "a.com", "/b/"), ("block", "com", "/b/c/"), ("allow", "x.org", "/y/"), ("block", "org", "/y/zz/"), ("allow", "w.x.org", "/"), ("block", "org", "/yz/")]
    table = spark.createDataFrame(rules, "action string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.com/b/c/d"), (2, "http://www.x.org/yz/")], "page_id long, url string")
    for parts in (1, 4):
        found = {r.page_id: (r.rule, r.verdict) for r in op.judged_urls(pages.repartition(parts), table.repartition(parts)).collect()}
        assert found == {1: ("com/b/c/", "block"), 2: ("org/yz/", "block")}

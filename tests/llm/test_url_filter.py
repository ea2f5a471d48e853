from pyspark.sql import functions as F

from twinvec.llm import url_filter as U

URLS = {
    1: "http://A.Example.NET/en/x?y", 2: "https://b.example.net/de/", 3: "http://example.com/de/1", 4: "http://x.example.com/den",
    5: "http://news.org/fr/1", 6: "http://news.org/fr", 7: None, 8: "no scheme/net/", 9: "http://planet/", 10: "http://a.net",
    11: "ftp://h.org?x=://q.net/", 12: "http://a.net#/en/", 13: "http://É.COM/é?#", 14: "",
}
RULES = {1: "example.net/en/", 2: "net/", 3: "example.com/de/", 5: "org/fr/"}
PARTS = {1: ("a.example.net", "/en/x"), 7: ("", ""), 8: ("", ""), 9: ("planet", "/"), 10: ("a.net", ""), 11: ("h.org", ""), 12: ("a.net", ""),
         13: ("É.com", "/é"), 14: ("", "")}


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", 0.5) for i, u in URLS.items()], "page_id long, url string, host string, mean double")
    outcomes = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in U.judge(pages, outcomes).collect()}
    assert len(got) == len(URLS)
    for i, r in got.items():
        assert r["rule"] == RULES.get(i)
        assert r["verdict"] == {"net/": "block", "example.com/de/": "block"}.get(r["rule"], "allow")
        if i in PARTS:
            assert (r["host"], r["path"]) == PARTS[i]
    assert U.judge(pages.limit(0), outcomes).collect() == []


def test_reputation_shrinks_towards_the_domain(spark):
    counts = [("bad.a.com", 100, 100, 95), ("new.a.com", 5, 0, 0), ("good.b.com", 200, 200, 2), ("new.b.com", 3, 0, 0), ("one.b.com", 1, 1, 1),
              ("x.c.org", 50, 50, 5)]
    d = spark.createDataFrame(counts, "host string, n_pages long, n long, k long")
    rep = {r["host"]: r for r in U.reputation(d).collect()}
    assert len(rep) == len(counts)
    assert all(r["bound"] <= r["mean"] and 0 <= r["mean"] <= 1 for r in rep.values())
    assert rep["bad.a.com"]["bound"] > 0.3 > rep["good.b.com"]["mean"]
    assert rep["new.a.com"]["mean"] > rep["new.b.com"]["mean"]  # a host without outcomes takes its domain's rate
    assert rep["one.b.com"]["bound"] < 0.3  # one bad page is not enough


def test_repeated_pages_and_outcomes(spark):
    pages = spark.createDataFrame([(1, "http://s.a.com/x")] * 3 + [(i, "http://s.a.com/y") for i in range(2, 80)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, True) for i in range(80)] * 2 + [(500, None), (None, True)], "page_id long, bad boolean")
    got = U.judge(pages, outcomes)
    assert got.count() == 81
    assert got.select("verdict").distinct().count() == 1
    assert got.select(F.first("verdict")).first()[0] == "block"

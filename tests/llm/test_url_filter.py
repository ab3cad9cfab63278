from pivotspark.llm import url_filter as U

PAGES = "page_id long, url string, html string, host string, block int"
URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x", "https://example.net/en", "http://example.net/en/",
        "http://x.net/en/", "http://net/", "http://example.com/de/1?x#y", "http://notexample.com/de/", "http://a.org/fr/b",
        "http://a.org/fr", "http://www.bad.org/p/?utm_source=f&b=2&a=1#top", "https://m.bad.org:443/p?a=1&b=2",
        "http://bad.org/q", "http://bad.org/q", "http://u@h.org\n/fr/"]


def brute(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for r in U.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path):
            if best is None or len(r.rule) > len(best.rule):
                best = r
    return host, path, best


def pages(spark):
    return spark.createDataFrame([(i, u, None, "clash", 1) for i, u in enumerate(URLS)], PAGES)


def test_rules_and_list(spark):
    listed = spark.createDataFrame([("http://bad.org/p?b=2&a=1",), ("http://bad.org/p/?a=1&b=2",), (None,)], "url string")
    rows = U.judge(pages(spark), listed).collect()
    assert sorted(r.page_id for r in rows) == list(range(len(URLS)))
    for r in rows:
        host, path, rule = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule.rule if rule else None)
        on_list = r.page_id in (13, 14)
        assert r.listed == on_list
        assert r.verdict == (rule.verdict if rule else "block" if on_list else "allow")


def test_false_positives_are_removed(spark, monkeypatch):
    # A filter of 64 bits for many entries passes nearly everything.
    monkeypatch.setattr(U, "BITS_PER_ENTRY", 0)
    listed = spark.createDataFrame([(f"http://l{i}.org/x",) for i in range(300)], "url string")
    assert not any(r.listed for r in U.judge(pages(spark), listed).collect())


def test_shuffled_filter_gives_the_same(spark, monkeypatch):
    listed = spark.createDataFrame([(f"http://bad.org/{c}",) for c in "pq"], "url string")
    want = sorted(U.judge(pages(spark), listed).collect())
    monkeypatch.setattr(U, "BROADCAST_BLOCKS", 0)
    assert sorted(U.judge(pages(spark), listed).collect()) == want


def test_empty_tables(spark):
    none = pages(spark).limit(0)
    assert U.judge(none, none.select("url")).count() == 0
    assert U.judge(pages(spark), none.select("url")).where("listed").count() == 0

import math

from loomtext.llm import url_filter as U

URLS = [None, "", "no scheme", "http://A.NET/x", "https://net", "http://x.example.net/en/1?q", "http://planet/x", "http://example.com/de/#a", "http://b.org/fr/?x", "http://b.org/fr", "ftp://example.org/es/", "http://É.Net/\ny"]


def expected(url):
    rest = (url or "").partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [r for r in U.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return host, path, max((r[0] + r[1] for r in fits), key=len, default=None)


def test_rules(spark):
    rows = U.judge(spark.createDataFrame(list(enumerate(URLS * 2)), "page_id int, url string").withColumnRenamed("page_id", "host2")).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule) == expected(r.url)
        assert r.verdict in ("allow", "block") and (r.difference is None) == (r.rule is not None)
    assert U.judge(spark.createDataFrame([], "page_id int, url string, host string")).count() == 0


def test_models():
    m = U.Markov(["abab", "abc"], order=2)
    assert math.isclose(sum(m.p("ab", chr(c)) for c in range(256)), 1)
    rows = [(f"http://spam{i}.example.org/win", False) for i in range(200)] + [(f"http://news{i}.example.org/story", True) for i in range(200)]
    ratio = U.Ratio(rows)
    assert ratio.difference("http://spam999.example.org/win") < ratio.threshold <= ratio.difference("http://news999.example.org/story")
    assert U.calibrated([]) == -math.inf

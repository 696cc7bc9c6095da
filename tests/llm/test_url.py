import re

from runnel.llm import url_filter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()


def ruled(host, path):
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return (best.text, best.verdict) if best else (None, None)


URLS = [
    "https://Sub.EXAMPLE.org/en/1/x", "https://example.org/en/2", "http://notexample.org/es/", "http://example.org/es/a?b", "http://a.com/fr/x", "http://a.com/de/x#y", "http://com/de/",
    "http://a.net/p?q=1&r=2", "noscheme", "", None, "://", "http://", "http://x.org", "http://x.org?/", "a://b://c.org/d", "HTTP://A.CoM/DE/", "http://é.org/\nx", "http://user@a.com:80/de/",
]


def test_rules_against_brute_force(spark):
    rows = list(enumerate(URLS)) + [(0, URLS[0])]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = split(URLS[r.page_id])
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_trees_learn_from_the_ruled(spark):
    rows = [(k, f"http://s{k}.org/{'en/a/b/c/' if k % 2 else 'x'}{k}") for k in range(400)] + [(1000 + k, f"http://bad{k * 7919}.com/de/zz{k * k}?a=1&b={k}&c=3") for k in range(400)]
    rows += [(5000 + k, f"http://q{k}.net/x{k}") for k in range(30)] + [(6000 + k, f"http://bad{k * 7919}.net/de/zz{k * k}?a=1&b={k}&c=3") for k in range(30)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string")).where("page_id >= 5000").collect()
    assert all(r.rule is None for r in got)
    assert sum(r.verdict == ("allow" if r.page_id < 6000 else "block") for r in got) >= 57


def test_edges(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.judge(none).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/", "h", "p"), (None, None, None, None)], "page_id bigint, url string, host string, suffix string")
    assert {(r.page_id, r.host, r.verdict) for r in url_filter.judge(one).collect()} == {(1, "a.net", "allow"), (None, "", "allow")}

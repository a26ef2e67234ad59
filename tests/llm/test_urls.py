import random

import pytest

from sitegauge.llm import urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules, unwanted=urls.UNWANTED_HOSTS):
    host, path = split(url)
    fits = lambda h: host == h or host.endswith("." + h)
    best = None
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if host and fits(h) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    if best:
        return host, path, best[1], best[0]
    return host, path, None, "block" if host and any(map(fits, unwanted)) else "allow"


def check(spark, found, rules=urls.GIVEN_RULES, table=None):
    pages = spark.createDataFrame([(i, u, "h", "k", 1) for i, u in found], "page_id bigint, url string, host string, key string, part int").repartition(4)
    got = sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, table).collect()), key=str)
    assert got == sorted(((str(i), *brute(u, rules)) for i, u in found), key=str)


def test_odd_urls(spark):
    check(spark, [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://net"), (6, "http://net/"), (7, "http://EXAMPLE.net/en/x?y#z"),
        (8, "http://example.net/en"), (9, "https://a.b.example.com/de/"), (10, "http://example.com?de/"), (11, "x://y://org/fr/"),
        (None, "http://m.example.org/fr/1"), (1, "http://x.net/"), (1, "http://x.net/"), (12, "http://xnet/"), (13, "http://fakeexample.com/de/"),
        (14, "http://casino-win.example.com/de/1"), (15, "http://m.casino-win.example.com/a"), (16, "http://.net/"), (17, "http://" + "a." * 3000 + "net/"),
    ])
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_nested_rules_and_a_hot_host(spark):
    draw = random.Random(4)
    hosts = ["a", "b.a", "c.b.a", "d.c.b.a", "b", "a.b", "ab", "b-a.a", "x.a"]
    rules = {}
    for _ in range(40):
        rules[draw.choice(hosts) + "/" + draw.choice(["", "p/", "p/q/", "r"])] = draw.choice(["block", "allow"])
    pairs = [(v, r) for r, v in rules.items()]
    # Rules of one length that fit one url have different hosts; the longer host wins.
    pairs = [p for p in pairs if len([q for q in pairs if len(q[1]) == len(p[1])]) == 1 or p[1].endswith("/")]
    found = [(i, f"http://{'a' if i % 3 == 0 else draw.choice(hosts)}/{draw.choice(['', 'p', 'p/', 'p/q/z', 'r1'])}") for i in range(600)]

    def best(url):
        host, path = split(url)
        fit = [(len(r), len(r.split('/', 1)[0]), r, v) for v, r in pairs
               if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fit)[2:] if fit else (None, "allow")

    pages = spark.createDataFrame(found, "page_id bigint, url string").repartition(5)
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, urls.rule_table(spark, pairs)).collect()}
    assert got == {i: best(u) for i, u in found}


@pytest.mark.parametrize("rules", [[], [("block", "noslash")]])
def test_no_usable_rules(spark, rules):
    table = urls.rule_table(spark, rules) if rules else spark.createDataFrame([], "rule string, verdict string")
    check(spark, [(1, "http://a.net/"), (2, None)], [], table)

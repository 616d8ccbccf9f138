import math
import re
import zlib
from collections import Counter

import pytest

from gridlake.llm import url_filter
from tests.llm.common import as_dict, table


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return lower(host), re.match("[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fit = [(len(r), r, v) for r, v in url_filter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fit)[1:] if fit else (None, None)


def symbols(url):
    t = re.sub("[1-9]", "0", lower(url))
    return "^^" + re.sub("[^a-z0" + re.escape(url_filter.SIGNS) + "]", "*", t) + "$"


def brute(urls):
    """url -> (score, cut), from the definition."""
    labels = {u: {"allow": 1, "block": 0, None: None}[rule(*split(u))[1]] for u in set(urls) if u}
    held = {u for u in labels if zlib.crc32(u.encode()) % 5 == 0}
    c = {1: Counter(), 0: Counter()}
    for u, y in labels.items():
        if y is not None and u not in held:
            s = symbols(u)
            c[y].update(s[i : i + 3] for i in range(len(s) - 2))
    m, k = 4.0, url_filter.SYMBOLS

    def p(y, g):
        n = c[y]
        total = sum(n.values())
        pick = lambda f: sum(v for x, v in n.items() if f(x))
        zero = (pick(lambda x: x[2] == g[2]) + m / k) / (total + m)
        c1, c2 = pick(lambda x: x[1] == g[1]), pick(lambda x: x[:2] == g[:2])
        one = zero if c1 < 8 else (pick(lambda x: x[1:] == g[1:]) + m * zero) / (c1 + m)
        return one if c2 < 8 else (n[g] + m * one) / (c2 + m)

    both = all(sum(x.values()) for x in c.values())
    memo = {}
    score = {}
    for u in labels:
        s = symbols(u)
        gs = [s[i : i + 3] for i in range(len(s) - 2)]
        for g in gs:
            if g not in memo:
                memo[g] = math.log(p(1, g)) - math.log(p(0, g)) if both else 0.0
        score[u] = sum(memo[g] for g in gs) / len(gs)
    bins = Counter()
    for u in held:
        if labels[u] is not None:
            bins[max(-1024, min(1024, math.floor(score[u] * 64))), labels[u]] += 1
    a, r = (sum(v for (b, y), v in bins.items() if y == z) for z in (1, 0))
    best, cut = 0.5, min((b for b, _ in bins), default=0) / 64
    if a and r:
        for b in sorted({b for b, _ in bins}):
            got = (sum(v for (x, y), v in bins.items() if y == 1 and x >= b) / a + sum(v for (x, y), v in bins.items() if y == 0 and x < b) / r) / 2
            if got > best:
                best, cut = got, b / 64
    else:
        cut = 0.0
    return score, cut


def check(spark, rows):
    df = spark.createDataFrame([(i, u, "z", "z", 1.0) for i, u in rows], "page_id long, url string, k string, host string, score double")
    got = as_dict(url_filter.judge(df), "page_id")
    score, cut = brute([u for _, u in rows])
    for i, u in rows:
        r = got[i]
        host, path = split(u)
        name, says = rule(host, path)
        s = score.get(u, 0.0)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name), u
        assert r["score"] == pytest.approx(s, abs=1e-9) and r["cut"] == pytest.approx(cut)
        if says or abs(s - cut) > 1e-9:
            assert r["verdict"] == (says or ("allow" if s >= cut else "block"))


def test_whole_table(spark):
    check(spark, [(r.page_id, r.url) for r in table(spark, "pages").select("page_id", "url").collect()])


def test_cases(spark):
    urls = [None, "", "no scheme", "https://WWW.Example.COM/en/x?y", "https://www.example.com/EN/", "http://a.b.net/es/1#f", "http://net/fr/", "http://xnet/fr/", "x://com", "x://com/", "x://notcom/", "http://é.org?/p/://", "http://", "h://q.com//en/", "http://z.net/es", "://example.com/en/"]
    check(spark, list(enumerate(urls)))
    check(spark, [(1, "http://a.org/" + "x" * 50_000), (2, "http://b.com/y"), (3, "http://c.net/es/z")])


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge(df).count() == 3
    assert url_filter.judge(df.limit(0)).count() == 0

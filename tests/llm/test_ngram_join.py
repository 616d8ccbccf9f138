import random
import re

import duckdb
import numpy as np
import pytest

from gridlake.llm import ngram_join
from gridlake.llm.components import components
from tests.llm.common import SF, as_dict, docs, table


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k=5, num=80):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        near = {j for x in s for j in holders.get(x, ())}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= num * (len(s) + len(sets[j]) - both):
                up[find(i)] = find(j)
        for x in s:
            holders.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def same(spark, rows, **how):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, rows), **how).collect()}
    assert got == brute(rows, how.get("k", 5), how.get("num", 80))


def near_copies(n, words, edits, seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_whole_table(spark):
    same(spark, [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()])


def test_borderline_groups(spark, monkeypatch):
    texts = near_copies(60, 90, 4, 1) + near_copies(40, 12, 2, 2) + near_copies(30, 4, 1, 3) + near_copies(50, 300, 12, 4)
    random.Random(5).shuffle(texts)
    rows = list(enumerate(texts, 100))
    same(spark, rows)
    monkeypatch.setattr(ngram_join, "PER_SALT", 7)  # every common n-gram salted
    monkeypatch.setattr(ngram_join, "PER_BUCKET", 500)
    same(spark, rows)
    same(spark, rows, num=60, k=3)
    monkeypatch.setattr(ngram_join, "PER_SALT", 50_000)
    monkeypatch.setattr(ngram_join, "LONG", 5)  # probes first
    same(spark, rows)


def test_hot_passages(spark, monkeypatch):
    """Texts that share passages, many of them by nothing else, with n-grams hot beyond a few holders."""
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(10**6)}"
    passages = [[word() for _ in range(n)] for n in (30, 55, 80)]
    texts = []
    for p in passages:
        for _ in range(40):  # the passage is 75 to 100 % of the text
            own = [word() for _ in range(rnd.randrange(0, len(p) // 3))]
            texts.append(" ".join(p + own if rnd.random() < 0.5 else own + p))
    for _ in range(30):  # two passages, the second cut
        p, q = rnd.sample(passages, 2)
        texts.append(" ".join(p + q[: rnd.randrange(len(q))] + [word() for _ in range(rnd.randrange(9))]))
    texts += near_copies(60, 70, 6, 8)
    rnd.shuffle(texts)
    rows = list(enumerate(texts, 1000))
    same(spark, rows, hot=3)
    same(spark, rows, hot=1)
    monkeypatch.setattr(ngram_join, "PART", 3000)
    monkeypatch.setattr(ngram_join, "PER_SALT", 3)
    monkeypatch.setattr(ngram_join, "PER_COUNT", 900)
    same(spark, rows, hot=8)
    same(spark, rows)


def test_cases(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "A b"), (5, "a  B"), (6, "b a"), (7, "a b c d e"), (8, "a b c d e f"), (9, long), (10, long + " tail"), (11, "a b c d e"), (12, "a b")]
    same(spark, rows)
    twice = docs(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None)])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(twice).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, 1, 1), (None, 0, None)], key=str)
    assert ngram_join.join(docs(spark, [])).count() == 0


def test_keep_one(spark):
    src = docs(spark, [(3, "a b c d e f"), (1, "A b c d e f"), (2, "other words stand here now"), (5, None), (None, "a b c d e f")])
    out = ngram_join.keep_one(src)
    assert out.columns == src.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 2, 5, None]


def test_filters_never_prune_a_link():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rnd.integers(0, 200, rnd.integers(1, 80)).astype(np.uint64))
        b = np.unique(np.r_[a[rnd.random(len(a)) < 0.9], rnd.integers(0, 200, rnd.integers(0, 9)).astype(np.uint64)])
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        link = 100 * both >= 80 * (len(a) + len(b) - both)
        least = ngram_join.needed(len(a), len(b), 80)
        assert link == (both >= least)
        if link:
            assert ngram_join.suffix_filter(a, b, least)
            assert set(a[: ngram_join.prefix_length(len(a), 80)]) & set(b[: ngram_join.prefix_length(len(b), 80)])


@pytest.mark.parametrize("kind", ["path", "star", "random", "none", "salted"])
def test_components(spark, kind, monkeypatch):
    if kind == "salted":
        monkeypatch.setitem(components.__globals__, "HEAVY", 7)
    rnd = random.Random(3)
    e = {"path": [(i, i + 1) for i in range(70)], "star": [(500, i) for i in range(99)], "random": [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)], "none": [], "salted": [(500, i) for i in range(99)] + [(i, i + 1) for i in range(95, 130)]}[kind]
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in e:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = as_dict(components(spark.createDataFrame(e, "a long, b long")), "node")
    assert {n: r["root"] for n, r in got.items()} == {n: find(n) for n in up}


@pytest.mark.parametrize("in_task, jobs", [(5000, 8), (60, None)])
def test_components_in_task(spark, in_task, jobs):
    rnd = random.Random(4)
    e = [(i, i + 1) for i in range(-300, 400)] + [(2000, 1000 + i) for i in range(200)] + [(3000 + rnd.randrange(400), 3000 + rnd.randrange(400)) for _ in range(300)]
    e += [(9000, 9000), (None, 9001), (9002, None), *e[:50]]
    rnd.shuffle(e)
    up = {n: n for x in e if None not in x for n in x}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in e:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    edges = spark.createDataFrame(e, "a long, b long")
    spark.sparkContext.setJobGroup(f"components {in_task}", "")
    got = components(edges, in_task=in_task).collect()
    ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {in_task}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.node, r.root) for r in got) == sorted((n, find(n)) for n in up)
    assert jobs is None or ran <= jobs  # the driver plans no rounds


def test_few_jobs(spark):
    """The driver's memory grows with the jobs of a join."""
    src = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    spark.sparkContext.setJobGroup("few jobs", "")
    ngram_join.join(src).write.format("noop").mode("overwrite").save()
    ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < ran <= 60


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = {d: (n, c) for d, n, c in con.execute(ngram_join.SQL).fetchall()}
    assert got == brute([(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()])

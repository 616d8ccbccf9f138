import random

import numpy as np
import pytest

from gridlake.llm import mixing
from tests.llm.common import docs


def made(n=900):
    rnd = random.Random(6)
    rows = []
    for i in range(n):
        y = rnd.choices([0, 1, 2], [0.7, 0.2, 0.1])[0]
        own = [[f"good{k}" for k in range(9)], [f"low{k}" for k in range(9)], [f"bad{k}" for k in range(9)]][y]
        rows.append((i, " ".join(rnd.choice(own) if rnd.random() < 0.4 else f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(5, 80))), y))
    return rows


def labels(spark, rows):
    return spark.createDataFrame([(i, int(y != 1), int(y == 2)) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_few_marked_words_decide_a_long_text():
    """Two words of a domain in 400 others; posteriors stay as sure as the shares among texts without them."""
    rnd = random.Random(8)
    texts, y = [], []
    for i in range(1200):
        c = i % 3
        text = [f"w{rnd.randrange(4000)}" for _ in range(400)]
        for _ in range(2 if c else 0):
            text[rnd.randrange(400)] = f"{'xlb'[c]}{rnd.randrange(12)}"
        texts.append(" ".join(text))
        y.append(c)
    m = mixing.fit(texts[:900], y[:900], 3, np.ones(3) / 3)
    raw = [t.encode() for t in texts[900:]]
    p, _ = m.posteriors(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(b) for b in raw])])
    assert np.mean(p.argmax(1) == y[900:]) > 0.95
    assert p.mean(0) == pytest.approx(np.ones(3) / 3, abs=0.05)


def test_targets_are_met(spark):
    rows = made()
    out = mixing.mix(docs(spark, [r[:2] for r in rows]), labels(spark, rows)).collect()
    assert len(out) == len(rows) and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in out)
    p = np.array([[r.p_good, r.p_low, r.p_toxic] for r in out])
    assert p.sum(1) == pytest.approx(np.ones(len(p)))
    y = {i: c for i, _, c in rows}
    assert np.mean(p.argmax(1) == [y[r.doc_id] for r in out]) > 0.9
    tokens = np.array([r.tokens for r in out])
    assert tokens.tolist() == [len(dict((i, t) for i, t, _ in rows)[r.doc_id].split()) for r in out]
    got = (np.array([r.rate for r in out]) * tokens) @ p
    want = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * mixing.SHARE * tokens.sum()
    assert np.abs(got - want).max() < 0.002 * want.sum()


def test_rates_against_plain_projected_gradient(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 80)
    n = rng.integers(1, 50, 80)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "tokens long, p array<double>")
    goal = [float(x) for x in np.array([0.9, 0.1, 0.0]) * n.sum()]
    rate, reached = mixing.rates(df, goal)
    r = np.ones(80)
    a = n[:, None] * p
    for _ in range(20_000):
        r = np.maximum(0, r - (p @ (r @ a - goal)) / (n[:, None] * p * p).sum())
    assert np.abs(np.array(reached) - goal).max() <= np.abs(r @ a - goal).max() + 0.01 * n.sum()
    assert min(x[0] for x in df.select(rate).collect()) >= 0


def test_soft_posteriors_reach_the_targets(spark):
    """Steps gain little and most rates end at 0, but the targets can be met."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet([6, 3, 3], 400)
    n = rng.integers(1, 50, 400)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "tokens long, p array<double>")
    goal = np.array([0.70, 0.25, 0.05]) * 0.5 * n.sum()
    rate, reached = mixing.rates(df, [float(x) for x in goal])
    assert np.abs(np.array(reached) - goal).max() < 1e-4 * goal.sum()
    r = np.array([x[0] for x in df.select(rate).collect()])
    assert r.min() >= 0 and (r * n) @ p == pytest.approx(np.array(reached))


def test_rates_are_the_nearest_to_one(spark):
    """Of all rates that meet the targets those nearest to 1: none along the targets' null space is nearer."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([2, 1, 1], 200)
    n = rng.integers(1, 50, 200)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "tokens long, p array<double>")
    goal = np.array([0.60, 0.30, 0.10]) * 0.7 * n.sum()
    rate, reached = mixing.rates(df, [float(x) for x in goal])
    r = np.array([x[0] for x in df.select(rate).collect()])
    assert np.abs(np.array(reached) - goal).max() < 1e-4 * goal.sum()
    free = np.flatnonzero(r > 1e-3)
    a = (n[:, None] * p)[free]
    for _ in range(20):
        d = rng.normal(size=len(free))
        d -= a @ np.linalg.solve(a.T @ a, a.T @ d)
        d *= 1e-4 * r[free].min() / np.abs(d).max()
        near, was = (n[free] * np.square(r[free] + d - 1)).sum(), (n[free] * np.square(r[free] - 1)).sum()
        assert near >= was - 1e-9 * was


def test_targets_out_of_reach_end_at_the_optimum(spark):
    p = np.array([0.5, 0.3, 0.2])
    df = spark.createDataFrame([(n, p.tolist()) for n in range(1, 40)], "tokens long, p array<double>")
    goal = np.array([300.0, 50.0, 0.0])
    _, reached = mixing.rates(df, goal.tolist())
    assert reached == pytest.approx((p * (p @ goal) / (p @ p)).tolist(), rel=1e-3)


def test_totals_are_reported(spark):
    rows = made(200)
    out = mixing.mix(docs(spark, [r[:2] for r in rows]), labels(spark, rows))
    told = out.schema["rate"].metadata
    assert set(told) == {"targets", "reached"} and set(told["reached"]) == set(mixing.DOMAINS)
    got = out.selectExpr(*(f"sum(rate * tokens * p_{d}) AS {d}" for d in mixing.DOMAINS)).first().asDict()
    assert got == pytest.approx(told["reached"])


def test_cases(spark):
    rows = made(60)
    odd = [(901, None), (902, ""), (903, "word " * 50_000), (904, "x"), (904, "x"), (None, "y z")]
    out = mixing.mix(docs(spark, [r[:2] for r in rows] + odd), labels(spark, rows)).collect()
    assert len(out) == 66 and {r.tokens for r in out if r.doc_id in (901, 902)} == {0}
    assert mixing.mix(docs(spark, [(1, "a b")]), labels(spark, []), share=0.5).count() == 1
    assert mixing.mix(docs(spark, []), labels(spark, [])).count() == 0

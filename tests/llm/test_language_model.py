import math
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from gridlake.llm import language_model, shared
from tests.llm.common import SF, docs, table


def tokens(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


class Slow:
    """The same model from its formula, token by token."""

    def __init__(self, rows, order, m):
        self.m, self.order, self.grams, self.history = m, order, Counter(), Counter()
        self.one = Counter()
        for d, t in rows:
            if held(d):
                continue
            seq = ["<s>"] + tokens(t)
            self.one.update(seq[1:])
            for i in range(1, len(seq)):
                for n in range(2, order + 1):
                    if i - n + 1 >= 0:
                        self.grams[tuple(seq[i - n + 1 : i + 1])] += 1
                        self.history[tuple(seq[i - n + 1 : i])] += 1
        self.n, self.v = sum(self.one.values()), len(self.one)

    def base(self, w):
        return (self.one[w] + 1) / (self.n + self.v + 1)

    def p(self, h, w):
        if not h:
            return self.base(w)
        low = self.p(h[1:], w)
        c = self.history[h]
        return (self.grams[(*h, w)] + self.m * low) / (c + self.m) if c else low

    def row(self, t):
        seq = ["<s>"] + tokens(t)
        s = sum(math.log10(self.p(tuple(seq[max(0, i - self.order + 1) : i]), seq[i])) for i in range(1, len(seq)))
        return len(seq) - 1, sum(self.one[w] > 0 for w in seq[1:]), self.n, sum(math.log10(self.base(w)) for w in seq[1:]), s


def same(spark, rows, order=3, **how):
    slow = Slow(rows, order, language_model.STRENGTH)
    got = language_model.score(docs(spark, rows), order=order, **how).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert r.held_out == held(r.doc_id)
        n, known, all_, base, s = slow.row(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, all_)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(s, rel=1e-9)
    return slow


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_formula(spark, order, monkeypatch):
    monkeypatch.setattr(language_model, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(language_model, "BUCKET_KEYS", 3_000)
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").limit(60).collect()]
    rows += [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "The the THE"), (10_005, "word " * 30_000), (10_006, "é ñ")]
    same(spark, rows, order)


def test_whole_table(spark):
    same(spark, [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()])


def test_automaton_fails_to_shorter_states():
    """States, arcs and failure arcs of a small corpus, and the score of a text that needs each of them."""
    texts = ["a b c", "a b d", "b c"]
    free = [i for i in range(20) if not held(i)]
    rows = list(zip(free, texts))
    t = pa.RecordBatch.from_pydict({"g": [0] * 4, "k": free[:4], "held": [False] * 3 + [True], "t": [*texts, "a b c d z b"]})
    t = pa.Table.from_batches(shared.pack_pass({"k": pa.int64(), "held": pa.bool_()})(iter([t])))
    asked = language_model._ask(3, 64, 1 << 62)(t)
    answers = language_model._answer(asked)
    slow = Slow(rows, 3, 8.0)
    right = answers.append_column("all_tokens", pa.array([slow.n] * answers.num_rows)).append_column("all_types", pa.array([slow.v] * answers.num_rows))
    got = language_model._score(3, 64, 8.0, "k", pa.int64())(t, right).to_pylist()
    assert got[3]["score"] == pytest.approx(slow.row("a b c d z b")[-1])


def test_states_sum_to_one():
    rows = [(i, t) for i, t in enumerate(["a b c", "a b", "b c a c", "", "c c c b"])]
    slow = Slow(rows, 3, 8.0)
    types = [*slow.one, "<unseen>"]
    for h in [(), ("a",), ("a", "b"), ("z",), ("<s>", "a")]:
        assert sum(slow.p(h, w) for w in types) == pytest.approx(1)


def test_repeats_and_empty(spark):
    got = language_model.score(docs(spark, [(1, "a b"), (1, "a b"), (None, "a")])).collect()
    assert sorted(r.n_tokens for r in got) == [2, 3, 3]
    assert language_model.score(docs(spark, [])).count() == 0
    only_held = next(i for i in range(100) if held(i))
    r = language_model.score(docs(spark, [(only_held, "x y")])).collect()[0]
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_sql():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    slow, texts = Slow(rows, 3, language_model.STRENGTH), dict(rows)
    for d, h, *got in con.execute(language_model.SQL).fetchall():
        assert h == held(d) and got == [pytest.approx(x, rel=1e-9) for x in slow.row(texts[d])]

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from gridlake.llm import shared, suffix_dedup
from gridlake.llm.shared import prefix_hashes
from tests.llm.common import SF, docs, table


def brute(rows, length=50):
    big = 1 << 62
    order = sorted(rows, key=lambda r: big if r[0] is None else r[0])
    first = {}
    for d, t in order:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], big if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (big if d is None else d):
                gone[s : s + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows, **how):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs(spark, rows), **how).collect()), key=str)
    assert got == brute(rows, how.get("length", 50))


def made(seed, n=60):
    rnd = random.Random(seed)
    stock = ["".join(rnd.choice("abcde é") for _ in range(rnd.choice([49, 50, 51, 75, 140, 400]))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(6)):
            p = rnd.choice(stock) if rnd.random() < 0.6 else "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(120)))
            a = rnd.randrange(len(p) + 1) if rnd.random() < 0.3 else 0
            parts.append(p[a:])
        rows.append((i * 3 % n, "".join(parts)))
    return rows


@pytest.mark.parametrize("salted", [False, True])
def test_against_brute_force(spark, monkeypatch, salted):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 4_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_KEYS", 200)
    if salted:
        monkeypatch.setattr(suffix_dedup, "PER_SALT", 2)
    same(spark, made(1))
    same(spark, made(2), length=30)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]
    same(spark, rows)


def test_cases(spark):
    x = "".join(random.Random(9).choice("abcdefghij") for _ in range(100_000))
    rows = [(5, x), (3, x[100:170]), (4, x[:49]), (1, "a" * 70), (2, "b" + "a" * 200 + "b"), (6, None), (7, ""), (None, x[:60]), (None, x[:60]), (5, x[200:260] + "tail"), (8, "ab" * 80), (9, "ba" * 60)]
    same(spark, rows)
    assert suffix_dedup.dedup(docs(spark, [])).count() == 0


def test_suffix_order():
    rnd = np.random.default_rng(3)
    buf = rnd.integers(97, 99, 3000).astype(np.uint8)
    p = prefix_hashes(buf)
    at = rnd.integers(0, 2900, 800)
    seg = np.sort(rnd.integers(0, 9, 800))
    order = suffix_dedup.suffix_order(buf, p, at, seg, 40)
    want = sorted(range(800), key=lambda i: (seg[i], buf[at[i] : at[i] + 40].tobytes(), i))
    assert order.tolist() == want


def test_collisions_are_verified(monkeypatch):
    real = suffix_dedup.span_hashes
    monkeypatch.setattr(suffix_dedup, "span_hashes", lambda p, s, e: real(p, s, e) & np.uint64(1))
    rnd = np.random.default_rng(4)
    buf = rnd.integers(97, 99, 400).astype(np.uint8)
    at = np.arange(0, 380)
    doc = rnd.integers(0, 50, 380)
    got = suffix_dedup.least_holder(buf, at, np.zeros(380, np.int64), doc, 8)
    for i in range(380):
        assert got[i] == min(doc[j] for j in range(380) if (buf[j : j + 8] == buf[i : i + 8]).all())


def in_process(rows, length=50, k=20, groups=3, buckets=2):
    """The steps of ``dedup`` on tables in this process."""
    cut = lambda t, name: [t.filter(pc.equal(t.column(name), v)) for v in sorted(set(t.column(name).to_pylist()))]
    texts = {}
    for g in range(groups):
        part = rows[g::groups]
        batch = pa.RecordBatch.from_pydict({"g": [g] * len(part), "k": [d for d, _ in part], "t": [t for _, t in part]})
        texts[g] = pa.Table.from_batches(shared.pack_pass({"k": pa.int64()})(iter([batch])))

    def by_group(f, answers):
        empty = answers.slice(0, 0)
        return [f(t, answers.filter(pc.equal(answers.column("g"), g)) if answers.num_rows else empty) for g, t in texts.items()]

    ask = pa.concat_tables([suffix_dedup._ask_anchors(length, k, buckets)(t) for t in texts.values()])
    anchors = pa.concat_tables([suffix_dedup._answer_anchors(t) for t in cut(ask, "bucket")])
    blocks = pa.concat_tables(by_group(suffix_dedup._ask_blocks(length, k, buckets), anchors))
    whole = pa.concat_tables([suffix_dedup._answer_blocks(t) for t in cut(blocks, "bucket")])
    pieces = pa.concat_tables(by_group(suffix_dedup._ask_bytes(length, k, buckets), whole))
    every = pa.concat_tables([whole, *(suffix_dedup._answer_bytes(length)(t) for t in cut(pieces, "bucket"))])
    out = pa.concat_tables(by_group(suffix_dedup._remove(length, k, "doc_id", pa.int64()), every)).to_pylist()
    return sorted((tuple(r.values()) for r in out), key=str)


@pytest.mark.parametrize("bits", [0, 2, 64])
def test_colliding_block_hashes(monkeypatch, bits):
    """With first hashes of blocks that collide, all or most of them, no other byte goes."""
    real = suffix_dedup.Blocks.__init__

    def init(self, *how):
        real(self, *how)
        self.h = self.h & np.uint64((1 << bits) - 1)

    monkeypatch.setattr(suffix_dedup.Blocks, "__init__", init)
    rows = made(3)
    assert in_process(rows) == brute(rows)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted((tuple(r) for r in con.execute(suffix_dedup.SQL).fetchall()), key=str)
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]
    assert got == brute(rows)


def split_texts(rows, g, pieces):
    """A group's texts as they come in a large table: in many small pieces."""
    out = []
    for i in range(pieces):
        part = rows[i::pieces]
        batch = pa.RecordBatch.from_pydict({"g": [g] * len(part), "k": [d for d, _ in part], "t": [t for _, t in part]})
        out += shared.pack_pass({"k": pa.int64()})(iter([batch]))
    return pa.Table.from_batches(out)


def test_small_pieces_are_put_together():
    rows = made(5)
    whole, split = split_texts(rows, 0, 1), split_texts(rows, 0, 20)
    assert split.num_rows == 20
    (one,) = suffix_dedup._table_blocks(whole, 50, 20)
    (many,) = suffix_dedup._table_blocks(split, 50, 20)
    assert sorted(one[2].h.tolist()) == sorted(many[2].h.tolist())
    assert sorted(one[1].tolist()) == sorted(many[1].tolist())


def test_equal_anchors_without_an_equal_string_send_no_bytes():
    """In large tables anchors coincide; blocks that share no string of ``length`` bytes needn't be compared."""
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    shared_words = [word(34) for _ in range(50)]
    texts = [split_texts([(d, "".join(word(60) + w for w in shared_words) + word(60)) for d in (2 * g, 2 * g + 1)], g, 1) for g in range(3)]
    asked = pa.concat_tables([suffix_dedup._ask_anchors(50, 20, 1)(t) for t in texts])
    anchors = suffix_dedup._answer_anchors(asked)
    of = lambda t, g: t.filter(pc.equal(t.column("g"), g))
    blocks = pa.concat_tables([suffix_dedup._ask_blocks(50, 20, 1)(t, of(anchors, g)) for g, t in enumerate(texts)])
    assert sum(len(x.as_py()) for x in blocks.column("h")) > 0
    whole = suffix_dedup._answer_blocks(blocks)
    pieces = [suffix_dedup._ask_bytes(50, 20, 1)(t, of(whole, g)) for g, t in enumerate(texts)]
    assert sum(len(x.as_py()) for t in pieces for x in t.column("h")) <= 8 * 10  # of some hundred; hashes of 10 bits can agree


def test_strings_that_occur_once_are_not_sorted(monkeypatch):
    sizes, real = [], suffix_dedup.suffix_order

    def order(buf, p, at, segment, most):
        names = [buf[i : i + most].tobytes() for i in at.tolist()]
        assert all(names.count(x) > 1 for x in set(names))
        sizes.append(len(at))
        return real(buf, p, at, segment, most)

    monkeypatch.setattr(suffix_dedup, "suffix_order", order)
    rows = made(8)
    assert in_process(rows) == brute(rows)
    assert sum(sizes) > 0

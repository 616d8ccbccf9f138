import re
from itertools import permutations

import numpy as np
import pytest

from gridlake.llm import filter_audit
from tests.llm.common import docs, table


def brute(rows, labels):
    """{(part, order, step): counts}, document by document and order by order."""
    good, toxic = ({d for d, *v in labels if v[k] == 1} for k in (0, 1))
    failed = []
    for d, text, source in rows:
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        copy = d is not None and any(o is not None and o < d and (t or "") == text for o, t, _ in rows)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": copy}
        failed.append((d, source or "", {k for k, v in bad.items() if v}))
    out = {}
    for part in {p for _, p, _ in failed}:
        own = [(d, f) for d, p, f in failed if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, c in enumerate(order, 1):
                gone = [(d, f) for d, f in left if c in f]
                left = [(d, f) for d, f in left if c not in f]
                total[c] += len(gone)
                out[part, "".join(order), k] = [len(left), len(gone), sum(c in f for _, f in own) - len(gone), sum(f == {c} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def got(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark):
    d, lab = table(spark, "documents"), table(spark, "labels")
    want = brute([(r.doc_id, r.text, r.source) for r in d.collect()], [(r.doc_id, r.quality, r.toxic) for r in lab.collect()])
    assert got(filter_audit.audit(d, lab)) == want


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None, "en", None, 1), (2, "", "en", "", 1), (3, long, "en", "a", 1), (4, long, "en", "a", 1), (4, long, "en", "a", 1), (None, long, "en", "b", 1), (None, "x #", None, None, None)]
    rows += [(5, "é" * 60 + "AB", "en", "b", 1), (6, "Wort wort\x0bwort wort\x85 " * 40_000, "en", "b", 1), (7, "word " * 300, "en", "c", 1), (8, long + " 100%", "en", "c", 1), (9, long, "en", "c", 1)]
    labels = [(4, 1, 1), (4, 0, None), (9, 1, 0), (9, 1, 0), (None, 1, 1), (8, None, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(filter_audit.audit(docs(spark, rows), lab)) == brute([(r[0], r[1], r[3]) for r in rows], [x for x in labels if x[0] is not None])
    assert got(filter_audit.audit(docs(spark, rows), lab.limit(0)))
    assert filter_audit.audit(docs(spark, []), lab).count() == 0


def test_many_equal_rows(spark):
    """One text and no text make up most rows."""
    rows = [(i, None if i % 3 else "same text", "en", "s", 1) for i in range(5000)]
    out = got(filter_audit.audit(docs(spark, rows), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")))
    assert out["s", "EABCD", 1] == [2, 4998, 0, 0, 0, 0, 4998 * 60] and out["s", "AEBCD", 1] == [0, 5000, 0, 2, 1, 1, 2 * 120 + 4998 * 60]


@pytest.mark.parametrize("bits", [0, 1, 64])
def test_equal_hashes_are_told_apart(monkeypatch, bits):
    """Words whose hashes agree are still different words."""
    real = filter_audit.word_hashes
    monkeypatch.setattr(filter_audit, "word_hashes", lambda *a: real(*a) & np.uint64(((1 << bits) - 1) << (64 - bits)))
    texts = ["a b a c", "", "b", "a  aa aaa aa é è é", "x y z x y z x"]
    parts = [t.encode() for t in texts]
    made = filter_audit.scanned(np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])])
    assert made["distinct"].tolist() == [len(set(t.split())) for t in texts]
    assert made["words"].tolist() == [len(t.split()) for t in texts] and made["chars"].tolist() == [len(t) for t in texts]

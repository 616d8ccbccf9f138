import random
import zlib

import numpy as np
import pytest

from gridlake.llm import toxicity
from tests.llm.common import docs

WORDS = [f"{a}{b}" for a in "b c d f g l m n p r s t".split() for b in "a e i o u an en on".split()]


def made(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        w = ["".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 60))]
        y = rnd.random() < 0.25
        if y:
            for _ in range(rnd.randrange(1, 4)):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(["zukk", "Vexxo", "kwod" + rnd.choice(WORDS)]))
        rows.append((i, " ".join(w), rnd.choice(["en", "de"]), "s", int(y)))
    return rows


def labels(spark, rows):
    return spark.createDataFrame([(r[0], 1, r[4]) for r in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows = made(1600)
    src = docs(spark, [r[:4] for r in rows])
    out = toxicity.judge(src, labels(spark, rows)).collect()
    assert len(out) == len(rows)
    y = {r[0]: r[4] for r in rows}
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    right = np.mean([r.predicted == y[r.doc_id] for r in held])
    assert len(held) > 300 and right > 0.97
    clean = toxicity.keep_clean(src, labels(spark, rows))
    assert clean.columns == src.columns
    kept = {r.doc_id for r in clean.collect()}
    assert np.mean([(d in kept) != bool(v) for d, v in y.items()]) > 0.97


def test_labels_of_the_held_fold_are_never_read(spark):
    rows = made(300)
    flip = [(*r[:4], 1 - r[4]) if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r for r in rows]
    src = docs(spark, [r[:4] for r in rows])
    a, b = ({r.doc_id: r.score for r in toxicity.judge(src, labels(spark, x)).collect()} for x in (rows, flip))
    assert a == b


def test_cases(spark):
    rows = made(200)
    odd = [(9001, None), (9002, ""), (9003, "x"), (9004, "zukk " * 60_000), (9004, "zukk"), (None, "zukk")]
    src = docs(spark, [r[:4] for r in rows] + [(i, t, None, None) for i, t in odd])
    out = toxicity.judge(src, labels(spark, rows)).collect()
    assert len(out) == 206 and all(0 <= r.score <= 1 for r in out)
    none = labels(spark, rows).limit(0)
    assert {r.predicted for r in toxicity.judge(docs(spark, [(1, "a"), (2, None)]), none).collect()} == {0}
    assert toxicity.judge(docs(spark, []), none).count() == 0


def test_blocks_of_words_do_not_matter():
    rows = made(120)
    m = toxicity.fit([r[1] for r in rows], [r[4] for r in rows])
    raw = [r[1].encode() for r in rows]
    offs = np.r_[0, np.cumsum([len(b) for b in raw])].astype(np.int64)
    h, r = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), offs)
    whole = m.pooled(h, r, len(raw))
    for step in (7, 64):
        assert m.pooled(h, r, len(raw), step) == pytest.approx(whole, abs=1e-5)


def test_calibration_has_the_frequencies_of_all_labelled_rows(spark, monkeypatch):
    """Caps change the sample's mix of classes, but neither calibration nor the rows it counts."""
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 60)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 120)
    rnd = random.Random(3)
    rows = [(*r[:4], int(rnd.random() < (0.3 if r[4] else 0.05))) for r in made(1600)]  # labels that no score separates
    out = toxicity.judge(docs(spark, [r[:4] for r in rows]), labels(spark, rows)).collect()
    share = np.mean([r[4] for r in rows])
    assert np.mean([r.score for r in out]) == pytest.approx(share, abs=0.04)
    assert all(r.threshold != 0.3 for r in out)

import random

from gridlake.llm import decontaminate
from tests.llm.common import docs, table
from tests.llm.test_ngram_join import shingles


def brute(rows, items, num=80):
    out = set()
    sets = [(d, shingles(t)) for d, t in rows]
    for i, t in items:
        s = shingles(t)
        for d, g in sets:
            if s and 100 * len(s & g) >= num * len(s):
                out.add((d, i, len(s), len(s & g)))
    return out


def found(spark, rows, items, **how):
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(docs(spark, rows), b, **how).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    return {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got}


def test_whole_tables(spark):
    d, b = table(spark, "documents"), table(spark, "benchmark")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.find(d, b).collect()}
    assert got == brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    left = decontaminate.remove(d, b)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in d.collect()} - {x[0] for x in got}


def test_edited_passages(spark):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 5, 8, 30, 60, 150, 400])))) for i in range(40)]
    rows = []
    for d in range(150):
        text = [word() for _ in range(rnd.randrange(900))]
        for _ in range(rnd.randrange(3)):
            w = rnd.choice(items)[1].split()
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = word()
            at = rnd.randrange(len(text) + 1)
            text[at:at] = w
        rows.append((d, " ".join(text)))
    want = brute(rows, items)
    assert len(want) > 40
    assert found(spark, rows, items) == want
    assert found(spark, rows, items, most=2_000) == want  # block by block


def test_cases(spark):
    items = [(1, None), (2, ""), (3, "one two"), (4, "A b c d e f g"), (4, "A b c d e f g"), (5, "word " * 50)]
    rows = [(1, None), (2, ""), (3, "One TWO"), (4, "x a b c d e f g y"), (4, "x a b c d e f g y"), (5, "one two three"), (6, "word " * 40_000), (None, "a b c d e f g")]
    assert found(spark, rows, items) == {(3, 3, 1, 1), (4, 4, 3, 3), (6, 5, 1, 1), (None, 4, 3, 3)}
    assert found(spark, [], items) == set() and found(spark, rows, []) == set()

import random
import re
import zlib
from collections import Counter

import numpy as np

from gridlake.llm import spelling
from tests.llm.common import docs, table


def edits(a, b):
    """Whether exactly one letter is inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def lowered(run):
    return re.sub("[A-Z]", lambda m: m[0].lower(), run)


def count(rows, slip=199, size=6, least=5):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= size and k >= least}


def group(n):
    near = {w: [] for w in n}
    by = {}
    for w in n:  # words that share what is left without one letter
        for i in range(len(w) + 1):
            for k in {(w[:i], w[i:]), (w[:i], w[i + 1 :])}:
                by.setdefault(k, set()).add(w)
    for same in by.values():
        for a in same:
            near[a] += [b for b in same if edits(a, b)]
    near = {w: sorted(set(v), key=lambda b: (-n[b], b)) for w, v in near.items()}
    form = {w: v[0] if v and n[v[0]] >= 5 * n[w] else None for w, v in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def made(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark):
    d = table(spark, "documents")
    got = made(spelling.variants(spelling.counted(d, slip=199)))
    want = group(count([(r.doc_id, r.text) for r in d.collect()]))
    assert got == want and any(v[0] for v in want.values())


def test_all_near_words_are_found(spark):
    """With words of few letters, of letters that share bits, of very many letters, and anagrams."""
    rnd = random.Random(3)
    n = {"".join(rnd.choices("abcéÅê", k=rnd.choice([5, 6, 7]))): rnd.choice([5, 5, 9, 30, 200]) for _ in range(500)}
    n |= {"".join(rnd.sample("listen", 6)): 7 for _ in range(60)}
    n["z" * 300_000] = 5
    n["z" * 300_001] = 50
    got = made(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    want = group({w: k for w, k in n.items() if len(w) < 100})
    want |= {"z" * 300_000: ("z" * 300_001, "z" * 300_001, 5, 1, 50), "z" * 300_001: (None, "z" * 300_001, 50, 1, None)}
    assert got == want


def test_forms_lead_to_a_root(spark):
    """A chain of forms, each five times as frequent, and a tie that the order of code points decides."""
    n = {"lettera": 5, "letterb": 25, "letterbc": 125, "letterbcd": 625, "letterbcde": 3125, "zzzzzz": 5, "zzzzzé": 30, "zzzzzy": 30}
    got = made(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == group(n)
    assert got["lettera"][:2] == ("letterb", "letterbcde") and got["zzzzzz"][0] == "zzzzzy"


def test_counts(spark):
    rows = [(1, None), (2, ""), (3, "Wörter WÖRTER wÖrter Straße×straße Ābcdefgh don't snake_case"), (3, "Wörter"), (None, "letters " * 12), (4, "x" * 200_000), (5, "abcdef" * 20_000 + " short a")]
    rows += [(i, " ".join(["letters", "Letters", "another", "wörÿter"])) for i in range(10, 400)]
    for slip in (0, 1, 7, 199):
        assert {r.word: r.n for r in spelling.counted(docs(spark, rows), least=1, slip=slip).collect()} == count(rows, slip, least=1)
    assert spelling.variants(spelling.counted(docs(spark, []))).count() == 0


def test_checksums():
    words = [b"", b"a", "é".encode() * 32, b"x" * 64, b"y" * 65, b"z" * 500]
    before = [b"", b"1:", b"123456789:", b"x" * 90]
    codes, at = (v.ravel() for v in np.meshgrid(range(len(words)), range(len(before))))
    got = spelling._checksums(words, codes, np.array([zlib.crc32(b) for b in before], np.uint32)[at])
    assert got.tolist() == [zlib.crc32(before[j] + words[i]) for i, j in zip(codes, at)]


def test_no_join_passes_the_words_through_the_driver(spark, tmp_path):
    """At Spark's own threshold words of some 10 MB were broadcast, more than a small driver holds."""
    words = spark.createDataFrame([("letter", 50), ("leter", 5), ("lettter", 6), ("planets", 9)], "word string, n long")
    words.write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    for df in (spelling.near_pairs(words), spelling.variants(words)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan

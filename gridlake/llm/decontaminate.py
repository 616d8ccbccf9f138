"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item is a small part of a long document, so their whole sets are never alike. Items are therefore put in
classes by size (powers of two), and for each class documents are seen through overlapping windows not much larger
than the class's items: within a window the item's share is large, and one-permutation MinHash sketches of item
and window agree somewhere. Every agreement is a candidate, and each candidate is verified by exact containment in
the whole document. Windows that hold no value of any sketch can't agree and aren't sketched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import chunks, grams, text_buffer, word_hashes, words

WORDS = 5
BINS = 64
FEW = 8  # filled bins below which a sketch doesn't decide
BLOCK_BYTES = 8 << 20  # text of items that one index holds; more items are searched block by block


class Index:
    """Sketches and sets of a block of items. ``classes``: class -> window step in shingles."""

    def __init__(self, ids: list, texts: list[str | None], k: int = WORDS):
        self.ids, self.k = ids, k
        buf, offs = text_buffer(pa.array(texts, pa.string()))
        low, s, e, r = words(buf, offs)
        h, rows = grams(word_hashes(low, s, e), r, k)
        pair = np.unique(np.stack([rows.astype(np.uint64), h], 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
        self.item, self.gram = pair[:, 0].astype(np.int64), pair[:, 1]
        self.size = np.bincount(self.item, minlength=len(ids))
        self.start = np.r_[0, np.cumsum(self.size)]
        # one-permutation MinHash: an item's value in a bin is its least hash there
        key = np.unique(np.stack([self.item.astype(np.uint64), self.gram % np.uint64(BINS), self.gram], 1), axis=0) if len(pair) else np.zeros((0, 3), np.uint64)
        first = np.r_[True, (key[1:, :2] != key[:-1, :2]).any(1)] if len(key) else np.zeros(0, bool)
        value, owner = key[first, 2], key[first, 0].astype(np.int64)
        # too few filled bins to tell, so such an item's hits all go to the exact check
        self.few = np.bincount(owner, minlength=len(ids)) < FEW
        order = np.argsort(value, kind="stable")
        self.value, self.owner = value[order], owner[order]
        self.step = 1 << (np.floor(np.log2(np.maximum(self.size, 1))).astype(np.int64) + 1)
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(self.value >> np.uint64(42)).astype(np.int64)] = True

    def agrees(self, h: np.ndarray, at: int, item: int) -> bool:
        """Whether a window over position ``at``, of twice the class's step, has the same sketch value in that bin."""
        step, v = int(self.step[item]), h[at]
        for w in (at // step, at // step - 1):
            if w >= 0:
                part = h[w * step : (w + 2) * step]
                if part[part % np.uint64(BINS) == v % np.uint64(BINS)].min() == v:
                    return True
        return False

    def search(self, buf: np.ndarray, offs: np.ndarray, num: int):
        """(row, item, shared) with 100 * shared >= num * size of the item's set."""
        low, s, e, r = words(buf, offs)
        h, rows = grams(word_hashes(low, s, e), r, self.k)
        out = []
        hit = np.flatnonzero(self.bloom[(h >> np.uint64(42)).astype(np.int64)]) if len(self.value) else np.zeros(0, np.int64)
        if not len(hit):
            return out
        lo, hi = np.searchsorted(self.value, h[hit], "left"), np.searchsorted(self.value, h[hit], "right")
        real = hi > lo
        hit, lo, hi = hit[real], lo[real], hi[real]
        begin = np.searchsorted(rows, np.arange(len(offs)))
        cut = np.r_[0, np.flatnonzero(np.diff(rows[hit])) + 1, len(hit)] if len(hit) else [0]
        for x, y in zip(cut[:-1], cut[1:]):
            row = int(rows[hit[x]])
            own = h[begin[row] : begin[row + 1]]
            found: set[int] = set()
            for j in range(x, y):
                for item in self.owner[lo[j] : hi[j]].tolist():
                    if item not in found and (self.few[item] or self.agrees(own, int(hit[j] - begin[row]), item)):
                        found.add(item)
            whole = np.unique(own)
            for item in sorted(found):
                g = self.gram[self.start[item] : self.start[item + 1]]
                i = np.minimum(np.searchsorted(whole, g), len(whole) - 1)
                shared = int((whole[i] == g).sum())
                if 100 * shared >= num * len(g):
                    out.append((row, item, shared))
        return out


def blocks(items: DataFrame, key: str, text: str, most: int) -> list[tuple[list, list]]:
    """The items in lists of about ``most`` bytes of text, one at a time on the driver."""
    src = items.select(items[key].alias("k"), items[text].alias("t"))
    size = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // most) or 1
    for b in range(n):
        part = src.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b) if n > 1 else src
        rows = part.collect()
        if rows:
            yield [r["k"] for r in rows], [r["t"] for r in rows]


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", num: int = 80, k: int = WORDS, most: int | None = None) -> DataFrame:
    """(key, item key, n_item, n_shared, containment) where a document holds at least ``num`` % of an item's shingles.

    Shingles are of ``k`` words, A-Z lower-cased; an item or document of fewer words has its whole sequence as its
    one shingle, so such an item is only found in a document of the same words. Null, empty and blank texts hold
    nothing and are found nowhere. Items beyond ``most`` bytes are searched block by block, each block broadcast.
    A row's pairs come once; repeated rows of a document or an item give one pair. No items: no rows."""
    spark = docs.sparkSession
    src = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    kinds = {key: dict(docs.dtypes)[key], item_key: dict(items.dtypes)[item_key]}
    schema = f"{key} {kinds[key]}, {item_key} {kinds[item_key]}, n_item bigint, n_shared bigint"
    item_type = items.schema[item_key].dataType
    out = None
    for ids, texts in blocks(items, item_key, item_text, most or BLOCK_BYTES):
        cast = spark.sparkContext.broadcast(Index(ids, texts, k))

        def run(batches, cast=cast):
            index = cast.value
            for rows, buf, offs in chunks(batches, "t"):
                got = index.search(buf, offs, num)
                if got:
                    r = pa.array([g[0] for g in got], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).take(r), pa.array([index.ids[g[1]] for g in got], arrow_type), pa.array([int(index.size[g[1]]) for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())],
                        [key, item_key, "n_item", "n_shared"],
                    )

        from pyspark.sql.pandas.types import to_arrow_type

        arrow_type = to_arrow_type(item_type)
        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.distinct().withColumn("containment", F.col("n_shared") / F.col("n_item"))


def remove(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without rows whose key holds an item; rows with a null key stay unless their own text does."""
    bad = find(docs, items, key, text, **how).select(F.col(key).alias("__bad")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["__bad"]), "left_anti")


#: Exact containment of five-word shingles, whatever finds the candidates.
SQL = r"""
WITH w AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark WHERE text IS NOT NULL),
g AS (
  SELECT DISTINCT side, id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i+4], ' ') ELSE 'short ' || array_to_string(ws, ' ') END AS gram
  FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(i) WHERE len(ws) > 0),
n AS (SELECT id AS item_id, count(*) AS n_item FROM g WHERE side = 1 GROUP BY 1),
s AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM g d JOIN g b ON d.gram = b.gram AND d.side = 0 AND b.side = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared::DOUBLE / n_item AS containment FROM s JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""

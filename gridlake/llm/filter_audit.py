"""How five quality filters interact: what each removes in every order of them, and what it alone would remove."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import chunks, materialise, word_hashes

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
PAIRS = 1 << 18  # pairs of words whose bytes are compared at once
SPACE, CAPITAL, SYMBOL, START = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = SPACE
_CLASS[65:91] = CAPITAL
_CLASS[list(b"#$%&*|")] = SYMBOL
_CLASS |= np.where((np.arange(256) & 0xC0) == 0x80, 0, START).astype(np.uint8)  # of a code point


@dataclass(frozen=True)
class Limits:
    """A: fewer than ``words`` words; B: distinct words under ``distinct`` percent of words; C: capitals over
    ``capitals`` percent of code points; D: a symbol; E: the text of a smaller id."""

    words: int = 200
    distinct: int = 50
    capitals: int = 2


def _equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from a and from b are the same, span by span."""
    out = np.empty(len(a), bool)
    for i in range(0, len(a), PAIRS):
        x, y, n = a[i : i + PAIRS], b[i : i + PAIRS], size[i : i + PAIRS]
        ends = np.cumsum(n)
        step = np.arange(ends[-1])
        step -= np.repeat(ends - n, n)
        differ = buf[np.repeat(x, n) + step] != buf[np.repeat(y, n) + step]
        out[i : i + PAIRS] = np.add.reduceat(differ, ends - n, dtype=np.int64) == 0
    return out


def distinct_words(buf: np.ndarray, s: np.ndarray, e: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """How many different words buf[s:e] each of ``n`` rows has.

    Row and word hash are one sort key; neighbours of equal keys are compared byte by byte, and a row in which such
    words differ is counted by its words themselves."""
    if not len(s):
        return np.zeros(n, np.int64)
    low = 64 - n.bit_length()
    key = word_hashes(buf, s, e) >> np.uint64(64 - low)
    key |= rows.astype(np.uint64) << np.uint64(low)
    by = np.argsort(key)
    key = key[by]
    again = np.flatnonzero(key[1:] == key[:-1])
    a, b = by[again], by[again + 1]
    size = (e - s)[a]
    same = size == (e - s)[b]
    same[same] = _equal(buf, s[a[same]], s[b[same]], size[same])
    out = np.bincount(rows, minlength=n) - np.bincount(rows[a], minlength=n)
    for r in np.unique(rows[a[~same]]).tolist():
        own = np.flatnonzero(rows == r)
        out[r] = len({buf[x:y].tobytes() for x, y in zip(s[own].tolist(), e[own].tolist())})
    return out


def scanned(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of each text, by byte classes and their prefix sums."""
    n = len(offs) - 1
    kind = _CLASS[buf]

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offs[1:]] - total[offs[:-1]]

    inside = (kind & SPACE) == 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offs[(offs > 0) & (offs < len(buf))]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offs, s, "right") - 1
    return {"words": count(first), "distinct": distinct_words(buf, s, e, rows, n), "capitals": count((kind & CAPITAL) > 0), "symbols": count((kind & SYMBOL) > 0), "chars": count((kind & START) > 0)}


def _measure_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in chunks(batches):
        made = scanned(buf, offs)
        keys = [hashlib.sha256(buf[a:b]).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *map(pa.array, made.values()), pa.array(keys, pa.binary())], ["doc_id", "part", *made, "text_key"])


def measures(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, words, distinct, capitals, symbols, chars, text_key) of each document.

    Whole texts, null as empty; words are runs without white space, case counts. ``part`` is a column's value as text,
    empty where null. Texts are the same where SHA-256 of their bytes is. No rows from an empty table; a repeated row
    is measured as often as it stands there."""
    src = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    return src.mapInArrow(_measure_pass, f"doc_id {dict(docs.dtypes)['doc_id']}, part string, words bigint, distinct bigint, capitals bigint, symbols bigint, chars bigint, text_key binary")


def failures(docs: DataFrame, labels: DataFrame, part: str = "source", limits: Limits = Limits()) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of each document: bit k of the mask says that it fails filter k of A to E.

    Filter E fails where a smaller id has the same text; rows of one id don't fail it by each other, and rows without id
    neither fail it nor make others fail. ``good`` and ``toxic`` say that ``labels`` has a row of the id with quality 1
    and with toxic 1. Measures are written once; the least id of a text comes from partial minima, and only texts that
    occur twice or more meet their documents again, in a join whose hot keys adaptive execution splits."""
    m = measures(docs, part)
    bad = [F.col("words") < limits.words, 100 * F.col("distinct") < limits.distinct * F.col("words"), 100 * F.col("capitals") > limits.capitals * F.col("chars"), F.col("symbols") > 0]
    m = materialise(m.select("doc_id", "part", "text_key", sum((b.cast("int") * (1 << k) for k, b in enumerate(bad)), F.lit(0)).alias("own")))
    least = m.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("text_key", "least")
    marked = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic")).where("of is not null and (good or toxic)")
    out = m.join(least, "text_key", "left").join(marked, F.col("doc_id") == F.col("of"), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * 16
    return out.select("doc_id", "part", (F.col("own") + copy).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _total(each: str, test, what: str) -> Column:
    return F.aggregate(F.filter(each, test), F.lit(0).cast("bigint"), lambda acc, x: acc + x[what])


def interactions(failed: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from (part, mask, good, toxic).

    Documents become at most 32 counts a part before anything else; all orders are sums over those. A document that
    fails k filters falls to each of them in 120 / k of the 120 orders, which gives ``shapley``."""
    counts = failed.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    each = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("each"))
    out = each.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    bits = lambda text: sum(((F.instr(text, c) > 0).cast("int") * (1 << k) for k, c in enumerate(LETTERS)), F.lit(0))
    out = out.withColumns({"prior": bits(F.expr("substring(filter_order, 1, step - 1)")), "own": bits(F.expr("substring(filter_order, step, 1)"))})
    prior, own = F.col("prior"), F.col("own")
    fails = lambda x: x["mask"].bitwiseAND(own) != 0
    before = lambda x: x["mask"].bitwiseAND(prior) != 0
    here = lambda x: fails(x) & ~before(x)
    share = F.aggregate(F.filter("each", fails), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"] * (F.lit(len(ORDERS)) / F.bit_count(x["mask"])).cast("bigint"))
    return out.select(
        "part",
        "filter_order",
        "step",
        _total("each", lambda x: ~fails(x) & ~before(x), "n").alias("kept"),
        _total("each", here, "n").alias("removed"),
        _total("each", lambda x: fails(x) & before(x), "n").alias("redundant"),
        _total("each", lambda x: x["mask"] == own, "n").alias("unique_fails"),
        _total("each", here, "good").alias("good_lost"),
        _total("each", here, "toxic").alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", limits: Limits = Limits()) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): what the
    filters A to E do, applied in each of their 120 orders. See ``failures`` for the cases; an empty table has no rows."""
    return interactions(failures(docs, labels, part, limits))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT w.doc_id, part, CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(w.doc_id > least AS INT) AS mask,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM w LEFT JOIN labels ON w.doc_id = labels.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.l || b.l || x.l || d.l || e.l AS filter_order FROM f a, f b, f x, f d, f e WHERE len(list_distinct([a.l, b.l, x.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, step, (SELECT bit FROM f WHERE l = filter_order[step]) AS own, (SELECT coalesce(sum(bit), 0)::INT FROM f WHERE strpos(filter_order[1 : step - 1], l) > 0) AS prior
    FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, filter_order, step,
    CAST(coalesce(sum(n) FILTER (mask & (prior | own) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & own > 0 AND mask & prior = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & own > 0 AND mask & prior > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & own > 0 AND mask & prior = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & prior = 0), 0) AS BIGINT) AS toxic_lost,
    CAST(coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & own > 0), 0) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""

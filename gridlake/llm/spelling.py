"""Spelling variants: words of a corpus one edit apart, found by bands of letter-parity masks, and the form each goes back to."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import chunks, materialise

BITS = 63  # of a mask: 26 for a to z, 37 shared by the 64 letters from U+00C0
TABLED = 64  # bytes, or letters, of a word up to which checksums are combined by tables and letters compared by distance
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF
_shifts: list[np.ndarray] = []


def _shift_tables() -> np.ndarray:
    """t[n, k, b]: what byte k, of value b, of a CRC-32 becomes when n zero bytes follow; CRCs are sums of these."""
    if not _shifts:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
        t = np.empty((TABLED + 1, 4, 256), np.uint32)
        t[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32)[:, None])
        for n in range(TABLED):
            t[n + 1] = (t[n] >> 8) ^ step[t[n] & 255]
        _shifts.append(t)
    return _shifts[0]


def runs(buf: np.ndarray, offs: np.ndarray, least: int) -> tuple[pa.Array, np.ndarray]:
    """The runs of letters A-Z, a-z and U+00C0 to U+00FF of at least so many code points, A-Z lower-cased, and their rows."""
    lead = buf == _LEAD
    inside = _LETTER[buf] | lead
    inside[1:] |= lead[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offs[(offs > 0) & (offs < len(buf))]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    leads = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=leads[1:])
    long = (e - s) - (leads[e] - leads[s]) >= least
    s, e = s[long], e[long]
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[s] += 1
    mark[e] -= 1
    data = _LOWER[buf[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]]
    ends = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=ends[1:])
    return pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.searchsorted(offs, s, "right") - 1


def _checksums(words: list[bytes], codes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each occurrence's prefix, of which ``before`` has the CRCs, and word."""
    t = _shift_tables()
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    size = np.array([len(w) for w in words])
    n = np.minimum(size, TABLED)[codes]
    h = own[codes]
    for k in range(4):
        h ^= t[n, k, (before >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(size[codes] > TABLED).tolist():
        h[i] = zlib.crc32(words[codes[i]], int(before[i]))
    return h


def _count_pass(least: int, slip: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in chunks(batches, most=8 << 20):
            found, at = runs(buf, offs, least)
            if not len(found):
                continue
            coded = found.dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary
            slipped: Counter[str] = Counter()
            if slip:
                before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in rows.column(0).to_pylist()], np.uint32)
                words = names.cast(pa.large_binary()).to_pylist()
                h = _checksums(words, codes, before[at])
                hit = h % np.uint32(slip) == 0
                for c, x in zip(codes[hit].tolist(), h[hit].tolist()):
                    w = words[c].decode()
                    x %= len(w)
                    if len(w) > least:
                        slipped[w[:x] + w[x + 1 :]] += 1
                codes = codes[~hit]
            n = np.bincount(codes, minlength=len(names))
            kept = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(kept)).cast(pa.string()), pa.array(n[kept])], ["word", "n"])
            if slipped:
                yield pa.RecordBatch.from_arrays([pa.array(slipped.keys(), pa.string()), pa.array(slipped.values(), pa.int64())], ["word", "n"])

    return run


def counted(docs: DataFrame, size: int = 6, least: int = 5, slip: int = 0) -> DataFrame:
    """(word, n) of the words of ``size`` code points or more that occur ``least`` times or more in all documents.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, with A-Z in lower case; null texts have none. With
    ``slip``, a run of which CRC-32 of ``<doc_id>:<run>`` is a multiple of it loses one letter, the one that CRC-32
    modulo its length names; a null id is empty there. Counts are summed by chunk, by task and then by word."""
    src = docs.select("doc_id", "text").where("text is not null")
    return src.mapInArrow(_count_pass(size, slip), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


#: Every third bit: two bits that differ leave one of these sets equal.
BANDS = [sum(1 << b for b in range(k, BITS, 3)) for k in range(3)]
#: Each letter flips its bit, so that the mask has the letters that occur an odd number of times.
_PARITY = "aggregate(filter(split(word, ''), c -> c <> ''), 0L, (m, c) -> m ^ shiftleft(1L, if(ascii(c) < 128, ascii(c) - 97, 26 + (ascii(c) - 192) % 37)))"
#: Whether long words are the same but for the letter after their common start, which halving steps find.
_START = "aggregate(sequence(30, 0), 0, (p, k) -> if(p + shiftleft(1, k) <= least(x.size, y.size) AND substring(x.word, p + 1, shiftleft(1, k)) = substring(y.word, p + 1, shiftleft(1, k)), p + shiftleft(1, k), p))"
_SAME_REST = f"substring(x.word, {_START} + if(x.size >= y.size, 2, 1)) = substring(y.word, {_START} + if(y.size >= x.size, 2, 1))"


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of each two of ``words`` (word, n) that one inserted, deleted or replaced letter parts, a < b.

    An edit flips at most two bits of the mask, so of three bands of bits one is equal: words meet in the buckets of
    equal bands. Buckets hold words of one length and of one more, the length filter, and are divided by half words:
    with h half the lesser length, an edit leaves the first h letters or the other half's number of last letters as
    they are. So each word stands in twelve buckets, those of few letters and common bands are no larger for it, and
    adaptive execution splits what is still large. Masks are compared within a bucket, then letters; pairs found in
    several buckets count once. Joins here are merged, for a broadcast would pass all words through the driver."""
    w = words.select("word", "n", F.char_length("word").alias("size"), F.expr(_PARITY).alias("parity"))
    w = w.withColumn("least", F.explode(F.array(F.col("size"), F.col("size") - 1)))
    half = F.floor(F.col("least") / 2).cast("int")
    sides = [F.substring("word", F.lit(1), half), F.substring("word", F.col("size") - F.col("least") + half + 1, F.col("least") - half)]
    keys = [F.xxhash64(F.lit(k), F.col("parity").bitwiseAND(F.lit(band)), "least", F.lit(side), part) for k, band in enumerate(BANDS) for side, part in enumerate(sides)]
    held = w.select(F.explode(F.array(*keys)).alias("bucket"), "word", "n", "size", "parity")
    x, y = held.alias("x"), held.alias("y").hint("merge")
    edit = f"CASE WHEN greatest(x.size, y.size) <= {TABLED} THEN levenshtein(x.word, y.word, 1) = 1 ELSE {_SAME_REST} END"
    near = f"bit_count(x.parity ^ y.parity) <= 2 - abs(x.size - y.size) AND abs(x.size - y.size) <= 1 AND x.word < y.word AND {edit}"
    met = x.join(y, F.expr(f"x.bucket = y.bucket AND {near}"))
    return met.select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form on each word's way. Ways have no circles, since forms are more
    frequent than their words; every round doubles the steps that are taken at once."""
    at = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("further"))
        new = materialise(at.join(on.hint("merge"), at["root"] == on["via"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("via").isNotNull().alias("moved")))
        at = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return at


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of ``words`` (word, n), which must be distinct.

    ``form`` is the near word of largest n, of equal ones the least in code-point order, if it is ``times`` as frequent
    or more, else null; ``root`` is where forms lead in the end, the word itself without a form. No words, no rows."""
    words = materialise(words.select("word", "n"))
    pairs = materialise(near_pairs(words))
    both = pairs.select(F.col("a").alias("of"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near")).alias("x")).unionByName(pairs.select(F.col("b").alias("of"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("near")).alias("x")))
    best = both.groupBy("of").agg(F.count(F.lit(1)).alias("n_near"), F.min("x").alias("x"))
    taken = -F.col("x.less") >= times * F.col("n")
    out = words.join(best.hint("merge"), words["word"] == best["of"], "left")
    out = materialise(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("x.near")).alias("form"), F.when(taken, -F.col("x.less")).alias("form_n")))
    last = roots(out.where("form is not null")).withColumnRenamed("word", "of")
    return out.join(last.hint("merge"), out["word"] == last["of"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_FROM = "".join(map(chr, range(0xC0, 0x100)))
_TO = "".join(map(chr, range(33, 97))).replace("'", "''")  # one byte each, for DuckDB's levenshtein counts bytes
SQL = rf"""
WITH RECURSIVE run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
runs AS (SELECT row_number() OVER () AS id, r, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM (SELECT doc_id, r, count(*) AS times FROM run WHERE length(r) >= 6 GROUP BY doc_id, r)),
tab AS (SELECT i AS b, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS t FROM (SELECT unnest(range(256)) AS i)),
crc AS (SELECT id, x, CAST(4294967295 AS BIGINT) AS c FROM runs
    UNION ALL SELECT id, x[3:], xor(c >> 8, t) FROM crc JOIN tab ON b = xor(c & 255, CAST('0x' || x[1:2] AS BIGINT)) WHERE x <> ''),
slips AS (SELECT r, times, xor(c, CAST(4294967295 AS BIGINT)) AS h FROM crc JOIN runs USING (id) WHERE crc.x = ''),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, times FROM slips),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n, translate(word, '{_FROM}', '{_TO}') AS k FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
near AS (SELECT a.word, b.word AS other, b.n FROM words a JOIN words b ON abs(strlen(a.k) - strlen(b.k)) <= 1 AND levenshtein(a.k, b.k) = 1),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -n, other := other)) AS x FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -x.less >= 5 * w.n THEN x.other END AS form, CASE WHEN -x.less >= 5 * w.n THEN -x.less END AS form_n FROM words w LEFT JOIN best ON w.word = best.word),
way AS (SELECT word, word AS root FROM forms UNION ALL SELECT way.word, form FROM way JOIN forms ON way.root = forms.word WHERE form IS NOT NULL)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM forms f JOIN way ON f.word = way.word JOIN forms l ON way.root = l.word WHERE l.form IS NULL
"""

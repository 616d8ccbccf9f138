"""Helpers of this subpackage: materialised tables, Arrow text batches, vectorised word hashes."""

from __future__ import annotations

import ctypes
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 2 << 20  # bytes of text that a kernel handles at once; a longer text is a chunk of its own
PACK_BYTES = 24 << 20  # bytes of text that a task holds before it sends them off
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_tables: dict[int, np.ndarray] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode, where none need be named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gridlake-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: one computation, no lineage."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/gridlake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def learn_in_task(rows: DataFrame, learn):
    """``learn(list of dicts)`` of a bounded set of rows, run in one task; its result comes back pickled."""

    def run(batches):
        got = [r for b in batches for r in b.to_pylist()]
        give_back()
        model = pickle.dumps(learn(got))
        del got
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    first = rows.repartition(1).mapInArrow(run, "model binary").first()
    return learn([]) if first is None else pickle.loads(first[0])


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def give_back() -> None:
    """Returns freed memory to the system: workers stay for later tasks, beside others on their machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, nulls empty, and the offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(o[-1] - o[0]), int(o[0])), o - o[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK):
    """(rows, buffer, offsets) with at most ``most`` bytes of text, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        buf, offs = text_buffer(b.column(b.schema.names.index(text)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
            j = min(j, b.num_rows)
            yield b.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j
    give_back()


def _powers(base: int, n: int) -> np.ndarray:
    t = _tables.get(base)
    if t is None or len(t) < n:
        size = max(n, CHUNK + 64)
        t = np.empty(size, np.uint64)
        t[0], k = 1, 1
        while k < size:  # doubling: t[k:2k] = t[:k] * base^k
            m = min(k, size - k)
            np.multiply(t[:m], np.uint64(pow(base, k, 1 << 64)), out=t[k : k + m])
            k += m
        _tables[base] = t
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash (mod 2^64) of buf[:i]; see ``span_hashes``."""
    p = np.empty(len(buf) + 1, np.uint64)
    p[0] = 0
    pw, step, acc = _powers(_BASE, len(buf) + 1), 1 << 15, np.uint64(0)
    for i in range(0, len(buf), step):  # in pieces that stay in cache
        j = min(i + step, len(buf))
        t = buf[i:j].astype(np.uint64)
        t += np.uint64(1)
        t *= pw[i:j]
        t[:1] += acc
        np.cumsum(t, out=p[i + 1 : j + 1])
        acc = p[j]
    return p


def span_hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], the same wherever equal bytes stand."""
    h = p[end] - p[start]
    h *= _powers(_INV, len(p))[start]
    return h


def words(buf: np.ndarray, offs: np.ndarray, letters: np.ndarray | None = None):
    """(lower-cased bytes, starts, ends, rows) of the runs of bytes that aren't white space.

    ``letters``: a table of 256 booleans, to take runs of these bytes instead. Words end where rows end."""
    low = _LOWER[buf]
    sp = _SPACE[buf] if letters is None else ~letters[buf]
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return low, z, z, z
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = sp[:-1], sp[1:]
    cut = offs[(offs > 0) & (offs < n)]
    before[cut], after[cut - 1] = True, True
    np.logical_not(sp, out=sp)
    before &= sp
    after &= sp
    s = np.flatnonzero(before)
    e = np.flatnonzero(after) + 1
    return low, s, e, np.searchsorted(offs, s, "right") - 1


def word_hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans."""
    h = span_hashes(prefix_hashes(low), s, e)
    h ^= (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def grams(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, and their rows; a row of 1 to k-1 words counts as one gram.

    The order of words matters, and so does the number of words in a short row."""
    if not len(h):
        return h, rows
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[first, len(rows)])
    out_h, out_r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= k:
        ok = rows[k - 1 :] == rows[: len(rows) - k + 1]
        acc = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            acc *= np.uint64(0xC2B2AE3D27D4EB4F)
            acc += h[j : len(h) - k + 1 + j]
        out_h, out_r = mix(acc[ok]), rows[: len(rows) - k + 1][ok]
    short = first[count < k]
    if len(short):
        extra = []
        for i in short:
            acc = 0
            n = 0
            while i + n < len(rows) and rows[i + n] == rows[i]:
                acc = (acc * 0x9FB21C651E98DF25 + int(h[i + n])) & _MASK
                n += 1
            extra.append((acc * 31 + n) & _MASK)
        out_h = np.r_[out_h, mix(np.array(extra, np.uint64))]
        out_r = np.r_[out_r, rows[short]]
        order = np.argsort(out_r, kind="stable")
        out_h, out_r = out_h[order], out_r[order]
    return out_h, out_r


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte by byte, so that equal bytes stand together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def pack_pass(kinds: dict[str, pa.DataType]):
    """Rows of (g, other columns, t) by group: a group's texts of some batches, compressed together."""
    names = ["g", *kinds, "bytes", "z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush():
            for g, rows in held.items():
                z = pa.compress(b"".join(r[-1] for r in rows), codec="zstd", asbytes=True)
                cols = []
                for i, kind in enumerate([*kinds.values(), pa.int64()]):
                    v = pa.concat_arrays([r[i] for r in rows]).cast(kind)
                    cols.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), *cols, pa.array([z], pa.binary())], names)

        for rows, buf, offs in chunks(batches, "t", PACK_BYTES // 2):
            g = rows.column(0).to_numpy()
            by = np.argsort(g, kind="stable")
            cut = np.r_[0, np.flatnonzero(np.diff(g[by])) + 1, len(g)]
            for x, y in zip(cut[:-1], cut[1:]):
                own = by[x:y]
                text = b"".join(buf[offs[i] : offs[i + 1]].tobytes() for i in own.tolist())
                cols = [rows.column(1 + i).take(pa.array(own)) for i in range(len(kinds))]
                held.setdefault(int(g[own[0]]), []).append((*cols, pa.array(np.diff(offs)[own]), text))
            size += len(buf)
            if size > PACK_BYTES:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    return run


def packed(src: DataFrame, kinds: dict[str, pa.DataType]) -> DataFrame:
    """(g, lists of the other columns, bytes, z) from rows of (g, the columns of ``kinds``, t)."""
    types = dict(src.dtypes)
    schema = ", ".join(["g bigint", *(f"{c} array<{types[c]}>" for c in kinds), "bytes array<bigint>", "z binary"])
    return src.select("g", *kinds, "t").mapInArrow(pack_pass(kinds), schema)


def unpacked(table: pa.Table, names: list[str], most: int = CHUNK):
    """(rows with the named columns, bytes, offsets) of a group's texts, in pieces of bounded size."""
    for i in range(table.num_rows):
        sizes = table.column("bytes")[i].values.to_numpy()
        rows = pa.RecordBatch.from_arrays([table.column(c)[i].values for c in names], names)
        whole = np.frombuffer(pa.decompress(table.column("z")[i].as_py(), int(sizes.sum()), codec="zstd", asbytes=True), np.uint8)
        offs, at = np.r_[0, np.cumsum(sizes)], 0
        while at < len(sizes):
            end = min(max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1), len(sizes))
            yield rows.slice(at, end - at), whole[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
            at = end
    give_back()


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, how often each occurs) by one sort; ``x`` may be sorted in place."""
    x.sort()
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    at = np.flatnonzero(first)
    return x[at], np.diff(at, append=len(x))


def squeezed(x: np.ndarray, width: int) -> bytes:
    """``planes``, compressed."""
    return pa.compress(planes(x, width), codec="zstd", asbytes=True)


def unsqueezed(blob: bytes, n: int, width: int) -> np.ndarray:
    return from_planes(pa.decompress(blob, n * width, codec="zstd", asbytes=True), width)

"""Removal of long byte strings that an earlier document holds, decided by a hash-compared suffix sort.

A string of ``length`` bytes is represented by its anchor: the k-gram with the least hash in it, so equal strings
have equal anchors at equal offsets. Texts are dealt into groups of bounded size, and three questions go from the
groups to buckets of anchors:

1. which anchors do two groups hold? The others are settled;
2. of those, which blocks (an anchor with all the strings that it represents) does a smaller document hold whole?
3. where an anchor has several different blocks that agree in one of ``Blocks.kin``, their bytes go to a bucket,
   whose strings, without those whose hash no other has, are put in order by a mergesort that compares suffixes by
   prefix hashes: a binary search over lengths finds the common extension of two suffixes, and the byte behind it
   decides. Neighbours whose common extension reaches ``length`` are compared byte by byte.

A block that another document holds whole has nothing to sort: it is removed by equality with the other, which is
verified by ``Blocks.digests``, a second 64-bit hash of its bytes of another kind than the first. So only strings that
agree in two independent hashes, 128 bits, or byte by byte, are removed; a collision of the first hash removes nothing.

No group of equal strings is ever gathered: a group of texts sends each block once, with its least document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import _INV, CHUNK, _powers, distinct, mix, packed, prefix_hashes, span_hashes, unpacked

LENGTH = 50
GROUP_BYTES = 12 << 20
BUCKET_KEYS = 400_000
PER_SALT = 20_000  # groups that may hold an anchor before its strings are dealt out one by one
_LAST = np.iinfo(np.int64).max
_TWICE = np.uint64(40)  # bit of an asked block that two documents of its group hold


def gram_hashes(p: np.ndarray, n: int, k: int) -> np.ndarray:
    """Hashes of the k bytes at each of the n starts, not mixed."""
    out, step, inv = np.empty(n, np.uint64), 1 << 15, _powers(_INV, len(p))
    for i in range(0, n, step):
        j = min(i + step, n)
        np.subtract(p[i + k : j + k], p[i:j], out=out[i:j])
        out[i:j] *= inv[i:j]
    return out


def leftmost_min(h: np.ndarray, w: int, step: int = 1 << 14) -> np.ndarray:
    """Position of the first value with the least upper half in each window of w values, by doubling, in pieces that
    stay in cache."""
    n = len(h) - w + 1
    out = np.empty(n, np.int32)
    for i in range(0, n, step):
        val = h[i : min(i + step, n) + w - 1] & np.uint64(0xFFFFFFFF00000000)
        val |= np.arange(i, i + len(val), dtype=np.uint64)  # of equal halves the first is less
        size = 1
        while size < w:
            d = min(size, w - size)
            val = np.minimum(val[:-d], val[d:])
            size += d
        out[i : i + len(val)] = val.astype(np.uint32)
    return out


class Blocks:
    """Anchors of a chunk: positions p, first and last string lo..hi that each represents, row, keys A and H."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int, k: int):
        self.buf, self.length, self.longest = buf, length, 2 * length - k
        n = len(buf) - length + 1
        empty = np.zeros(0, np.int64)
        self.p = self.lo = self.hi = self.row = empty
        self.a = self.h = np.zeros(0, np.uint64)
        self.prefix = None
        if n <= 0:
            return
        p = prefix_hashes(buf)
        grams = gram_hashes(p, len(buf) - k + 1, k)
        at = leftmost_min(grams, length - k + 1)
        new = np.ones(n, bool)
        np.not_equal(at[1:], at[:-1], out=new[1:])
        cuts = offs[1:-1]
        new[cuts[cuts < n]] = True
        for cut in cuts.tolist():  # strings don't cross rows
            new[max(0, cut - length + 1) : cut] = False
        self.lo = np.flatnonzero(new)
        if not len(self.lo):
            return
        self.row = np.searchsorted(offs, self.lo, "right") - 1
        self.hi = np.minimum(np.append(self.lo[1:], n) - 1, offs[self.row + 1] - length)
        self.p = at[self.lo].astype(np.int64)
        self.a = mix(grams[self.p])
        h = span_hashes(p, self.lo, self.hi + length)
        h += (self.p - self.lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        h ^= (self.hi - self.lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        self.h = mix(h)
        self.prefix = p

    def digests(self, i: np.ndarray) -> np.ndarray:
        """A second hash of the bytes of blocks i: their words of 8 bytes, mixed one after the other."""
        view = np.ndarray(max(0, len(self.buf) - 7), "<u8", np.ascontiguousarray(self.buf), 0, (1,))
        lo, size = self.lo[i], self.hi[i] - self.lo[i] + self.length
        acc = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (self.p[i] - self.lo[i]).astype(np.uint64)
        for w in range(0, self.longest if len(i) else 0, 8):  # as many for every block
            acc ^= view[lo + np.minimum(w, size - 8)]  # a word beyond the block's end is its last one
            mix(acc)
        return acc

    def kin(self, i: np.ndarray, k: int) -> np.ndarray:
        """Three hashes of 10 bits for blocks i: of the anchor with two thirds of a string's other bytes, all before it,
        half of them, none. Blocks that share a string of one anchor agree in the same one of them at least."""
        p, lo, end = self.p[i], self.lo[i], self.hi[i] + self.length
        rest = self.length - k
        wide, out = 2 * rest // 3, np.zeros(len(i), np.uint32)
        for before in (wide, rest // 3, 0):
            s, e = p - before, p + k + wide - before
            ok = (s >= lo) & (e <= end)
            h = np.where(ok, span_hashes(self.prefix, np.maximum(s, lo), np.minimum(e, end)), self.h[i] + np.uint64(before + 1))
            out = out << np.uint32(10) | (mix(h) >> np.uint64(54)).astype(np.uint32)
        return out


def _texts(table, most: int = CHUNK):
    """(rows, bytes, offsets) of a group's texts; small pieces, as large tables have them, are put together."""
    held, size = [], 0
    for piece in unpacked(table, ["k"]):
        if held and size + len(piece[1]) > most:
            yield _one(held)
            held, size = [], 0
        held.append(piece)
        size += len(piece[1])
    if held:
        yield _one(held)


def _one(held):
    if len(held) == 1:
        return held[0]
    rows = pa.RecordBatch.from_arrays([pa.concat_arrays([r.column(0) for r, _, _ in held])], ["k"])
    return rows, np.concatenate([b for _, b, _ in held]), np.r_[0, np.cumsum(np.concatenate([np.diff(o) for _, _, o in held]))]


def _table_blocks(table, length: int, k: int):
    """(doc of each row, Blocks, offsets) by chunk. Null keys are after all others."""
    for rows, buf, offs in _texts(table):
        doc = rows.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
        yield rows, doc, Blocks(buf, offs, length, k), offs


def _gather(table, length: int, k: int):
    """(A, H, doc) of all blocks of a group."""
    parts = [(b.a, b.h, doc[b.row]) for _, doc, b, _ in _table_blocks(table, length, k)]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]


def _repeated(x: np.ndarray) -> np.ndarray:
    """The sorted values that occur twice or more."""
    u, n = distinct(x.copy())
    return u[n > 1]


def _first_of(*cols: np.ndarray) -> np.ndarray:
    """True for the first of each run of equal rows of sorted columns."""
    n = len(cols[0])
    out = np.ones(n, bool)
    if n:
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return out


def _binary(x: np.ndarray, cut: np.ndarray) -> pa.Array:
    """One binary value for each x[cut[i]:cut[i + 1]]."""
    ends = (cut * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _cuts(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(_first_of(sorted_)), len(sorted_))


def _rows(g, bucket, cols):
    """One row for each bucket; ``cols``: name -> array, in any order."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = _cuts(b)
    out = {"g": pa.array(np.full(len(cut) - 1, g, np.int64)), "bucket": pa.array(b[cut[:-1]].astype(np.int32))}
    return pa.table(out | {name: _binary(x[order], cut) for name, x in cols.items()})


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key.copy()) % np.uint64(buckets)).astype(np.int64)


def _ends(col) -> list[np.ndarray]:
    """Of each chunk of a binary column, where its rows begin and end in its data."""
    return [np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, c.offset * 4).astype(np.int64) for c in col.cast(pa.binary()).chunks if len(c)]


def _sizes(col) -> np.ndarray:
    """Bytes in each row of a binary column."""
    return np.concatenate([np.diff(e) for e in _ends(col)] or [np.zeros(0, np.int64)])


def _join_rows(table, **kinds):
    """All values of binary columns, one row after the other."""
    out = []
    for name, kind in kinds.items():
        col = table.column(name).cast(pa.binary())
        full = [c for c in col.chunks if len(c)]
        parts = [np.frombuffer(c.buffers()[2], np.uint8, int(e[-1] - e[0]), int(e[0])) for c, e in zip(full, _ends(col)) if e[-1] > e[0]]
        out.append(np.concatenate(parts).view(kind) if parts else np.zeros(0, kind))
    return out


def _marks(u: np.ndarray) -> np.ndarray:
    """A table by upper bits that tells most keys which aren't in u."""
    out = np.zeros(1 << max(10, min(24, len(u).bit_length() + 3)), bool)
    out[u >> np.uint64(65 - len(out).bit_length())] = True
    return out


def _marked(marks: np.ndarray, key: np.ndarray) -> np.ndarray:
    return marks[key >> np.uint64(65 - len(marks).bit_length())]


def _ask_anchors(length, k, buckets):
    def run(table):
        u = distinct(_gather(table, length, k)[0])[0]
        return _rows(table.column("g")[0].as_py(), _bucket_of(u, buckets), {"a": u})

    return run


def _answer_anchors(table):
    """How many groups hold each anchor, for those that two or more do."""
    (names,) = _join_rows(table, a=np.uint64)
    order = np.argsort(names, kind="stable")
    cut = _cuts(names[order])
    count = np.empty(len(names), np.uint32)
    count[order] = np.repeat(np.diff(cut), np.diff(cut))
    keep = count > 1
    ends = np.r_[0, np.cumsum(keep)][np.r_[0, np.cumsum(_sizes(table.column("a")) // 8)]]
    return pa.table({"g": table.column("g"), "a": _binary(names[keep], ends), "n": _binary(count[keep], ends)})


def _lookup(u: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in sorted u, found)"""
    if not len(u):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    i = np.minimum(np.searchsorted(u, key), len(u) - 1)
    return i, u[i] == key


def _ask_blocks(length, k, buckets):
    def run(left, right):
        if not left.num_rows:
            return _rows(0, np.zeros(0, np.int64), {c: np.zeros(0, np.uint64) for c in ("a", "h", "h2", "doc", "salts", "kin")})
        g = left.column("g")[0].as_py()
        held, n = _join_rows(right, a=np.uint64, n=np.uint32)
        order = np.argsort(held)
        held, n = held[order], n[order]
        every = []
        for _, doc, b, _ in _table_blocks(left, length, k):
            kin = b.kin(np.arange(len(b.a)), k)
            b.prefix = None  # as large as all else together
            every.append((doc, b, kin))
        own = _repeated(np.concatenate([b.a for _, b, _ in every] or [np.zeros(0, np.uint64)]))
        marks = _marks(held) if len(held) else np.zeros(1 << 10, bool)
        mine = _marks(own)
        got = []
        for doc, b, kin in every:
            take = np.flatnonzero(_marked(marks, b.a) | _marked(mine, b.a))
            at, found = _lookup(held, b.a[take])
            keep = found | _lookup(own, b.a[take])[1]
            take, at, found = take[keep], at[keep], found[keep]
            salts = np.where(found, -(-(n[at] if len(n) else np.ones(len(at), np.uint32)).astype(np.int64) // PER_SALT), 1).astype(np.uint64)
            got.append((b.a[take], b.h[take], b.digests(take), doc[b.row[take]], salts, kin[take]))
        a, h, h2, doc, salts, kin = [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, np.uint64)] * 6
        order = np.lexsort((doc, h2, h))
        first = _first_of(h[order], h2[order])
        docs, place = doc[order], np.cumsum(first) - 1
        twice = np.bincount(place, docs > docs[first][place], minlength=int(first.sum())) > 0  # in documents of this group
        order = order[first]
        a, h, h2, doc, salts, kin = a[order], h[order], h2[order], doc[order], salts[order], kin[order]
        bucket = _bucket_of(a + h % np.maximum(salts, np.uint64(1)), buckets)
        return _rows(g, bucket, {"a": a.astype(np.uint32), "h": h, "h2": h2, "doc": doc, "salts": salts | (twice.astype(np.uint64) << _TWICE), "kin": kin.astype(np.uint32)})

    return run


def _answer_blocks(table):
    """For each asked block: the least document that holds it, and whether other blocks may share a string with it."""
    a, h, h2, doc, salts, kin = _join_rows(table, a=np.uint32, h=np.uint64, h2=np.uint64, doc=np.int64, salts=np.uint64, kin=np.uint32)
    twice, salts = salts >> _TWICE > 0, salts & ((np.uint64(1) << _TWICE) - np.uint64(1))
    order = np.lexsort((h2, h))
    first = _first_of(h[order], h2[order])
    block = np.empty(len(h), np.int64)
    block[order] = np.cumsum(first) - 1
    least = np.full(int(first.sum()), _LAST)
    np.minimum.at(least, block, doc)
    one = order[first]  # of each different block
    other = np.zeros(len(one), bool)
    for i in range(3):  # equal anchors and hashes beside them; half an anchor's hash tells enough
        name = a[one].astype(np.uint64) << np.uint64(10) | (kin[one] >> np.uint32(10 * i) & np.uint32(1023)).astype(np.uint64)
        by = np.argsort(name)
        cut = _cuts(name[by])
        other[by] |= np.repeat(np.diff(cut) > 1, np.diff(cut))
    many = other[block] | (salts > 1)
    mine = least[block]
    send = many | twice | (mine < doc)
    ends = np.r_[0, np.cumsum(send)][np.r_[0, np.cumsum(_sizes(table.column("h")) // 8)]]
    cols = {"h": h, "h2": h2, "least": mine, "more": np.where(many, salts, 0).astype(np.uint64)}
    return pa.table({"g": table.column("g"), "kind": pa.array(np.zeros(len(ends) - 1, np.int32))} | {c: _binary(x[send], ends) for c, x in cols.items()})


def _known(right, kind: int, only_open: bool = False):
    """(h, h2, least, more) of one kind of answer, sorted by h, and marks of h."""
    part = right.filter(pa.array(np.asarray(right.column("kind")) == kind)) if right.num_rows else right
    cols = _join_rows(part, h=np.uint64, h2=np.uint64, least=np.int64, more=np.uint64)
    if only_open:
        cols = [c[cols[3] > 0] for c in cols]
    order = np.argsort(cols[0], kind="stable")
    return [*(c[order] for c in cols), _marks(cols[0])]


def _match(known, b, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``known``, found) for blocks i of a chunk, by both hashes."""
    h, h2 = known[0], known[1]
    at, found = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
    go = np.flatnonzero(_marked(known[4], b.h[i]))
    at[go], found[go] = _lookup(h, b.h[i[go]])
    go = go[found[go]]
    mine = b.digests(i[go])
    while len(go):  # past blocks whose first hash collides
        other = h2[at[go]] != mine
        go, mine = go[other], mine[other]
        at[go] += 1
        past = (at[go] >= len(h)) | (h[np.minimum(at[go], len(h) - 1)] != b.h[i[go]])
        found[go[past]] = False
        at[go[past]] = 0
        go, mine = go[~past], mine[~past]
    return at, found


def _open_blocks(doc_of, b, known, match):
    """Of a chunk's blocks: (index, salts) of those that are the least document's own and must be compared."""
    at, found = match
    if not len(known[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.flatnonzero(found & (known[3][at] > 0) & (known[2][at] == doc_of))
    return i, known[3][at[i]].astype(np.int64)


def _each_string(b, i, length):
    """(block index, start, hash) of every string of blocks i."""
    n = b.hi[i] - b.lo[i] + 1
    block = np.repeat(i, n)
    start = b.lo[block] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    h = span_hashes(b.prefix, start, start + length) if len(start) else np.zeros(0, np.uint64)
    return block, start, mix(h ^ np.uint64(0x5851F42D4C957F2D))


def _ask_bytes(length, k, buckets):
    """Each open block's bytes, once in a group; strings of salted anchors one by one."""

    def run(left, right):
        g = left.column("g")[0].as_py() if left.num_rows else 0
        known, got, data = _known(right, 0, True), [], []
        for _, doc, b, _ in _table_blocks(left, length, k):
            i, salts = _open_blocks(doc[b.row], b, known, _match(known, b, np.arange(len(b.h))))
            plain = i[salts == 1]
            block, start, names = _each_string(b, i[salts > 1], length)
            zero = np.zeros(len(start), np.uint64)
            cols = [
                (b.a[plain], names),
                (b.h[plain], names),
                (b.digests(plain), zero),
                (doc[b.row[plain]], doc[b.row[block]]),
                (b.p[plain] - b.lo[plain], zero.astype(np.int64) - 1),
                (b.hi[plain] - b.lo[plain] + 1, zero.astype(np.int64) + 1),
            ]
            cols = [np.concatenate(x) for x in cols]
            own = np.sort(_once(cols))
            cols = [x[own] for x in cols]
            got.append(cols)
            data.append(b.buf[_ranges(np.r_[b.lo[plain], start][own], cols[5] + length - 1)])
        a, h, h2, doc, shift, n = cols = [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        data = np.concatenate(data) if data else np.zeros(0, np.uint8)
        size = n + length - 1
        own = _once(cols)
        own = own[np.argsort(_bucket_of(a[own], buckets), kind="stable")]
        bucket = _bucket_of(a[own], buckets)
        cut = _cuts(bucket)
        out = {"g": pa.array(np.full(len(cut) - 1, g, np.int64)), "bucket": pa.array(bucket[cut[:-1]].astype(np.int32))}
        out |= {c: _binary(x[own], cut) for c, x in zip(("a", "h", "h2", "doc", "shift", "n"), cols)}
        out["data"] = _binary(data[_ranges((np.cumsum(size) - size)[own], size[own])], np.r_[0, np.cumsum(size[own])][cut])
        return pa.table(out)

    return run


def _once(cols) -> np.ndarray:
    """One index of each different (h, h2, doc, single string or not)."""
    _, h, h2, doc, shift, _ = cols
    order = np.lexsort((doc, shift < 0, h2, h))
    return order[_first_of(h[order], h2[order], shift[order] < 0, doc[order])]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, and so on."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def common_extension(p: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Length up to ``most`` of the longest common prefix of the suffixes at x and y, by binary search on hashes."""
    out = np.full(len(x), most, np.int64)
    go = np.flatnonzero(span_hashes(p, x, x + most) != span_hashes(p, y, y + most))
    x, y, lo, hi = x[go], y[go], np.zeros(len(go), np.int64), np.full(len(go), most - 1, np.int64)
    for _ in range(int(most - 1).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = span_hashes(p, x, x + mid) == span_hashes(p, y, y + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
    out[go] = lo
    return out


def suffix_order(buf: np.ndarray, p: np.ndarray, at: np.ndarray, segment: np.ndarray, most: int) -> np.ndarray:
    """A stable order of the suffixes ``at`` within each segment (equal values stand together), to depth ``most``.

    A mergesort whose runs double: all merges of a level run side by side, and each suffix finds its place among
    the neighbour run's by binary search, with suffixes compared by ``common_extension``."""
    n = len(at)
    order = np.arange(n)
    if not n:
        return order
    begin = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    size = np.diff(np.r_[begin, n])
    seg = np.repeat(np.arange(len(begin)), size)
    width = 1
    # the first 8 bytes settle most comparisons; the rest go by their common extension
    head = np.r_[buf, np.zeros(8, np.uint8)]
    head = sum(head[at + j].astype(np.uint64) << np.uint64(56 - 8 * j) for j in range(min(8, most)))
    ext = np.r_[buf, np.zeros(1, np.uint8)]
    while width < size.max():
        idx = np.flatnonzero(size[seg] > width)  # segments that this level changes
        inside = idx - begin[seg[idx]]
        run = inside // width
        right = run % 2 == 1
        other = begin[seg[idx]] + np.where(right, run - 1, run + 1) * width
        end = np.minimum(other + width, begin[seg[idx]] + size[seg[idx]])
        lo, hi = np.minimum(other, end), end
        mine = at[order[idx]]
        while True:
            go = np.flatnonzero(lo < hi)
            if not len(go):
                break
            mid = (lo[go] + hi[go]) >> 1
            i, j = order[mid], order[idx[go]]
            less = head[i] < head[j]
            tie = np.flatnonzero(head[i] == head[j])
            if len(tie):
                x, y = at[i[tie]], mine[go[tie]]
                c = common_extension(p, x, y, most)
                # elements of the left run come first among equals
                less[tie] = np.where(c == most, right[go[tie]], ext[np.minimum(x + c, len(buf))] < ext[np.minimum(y + c, len(buf))])
            lo[go[less]] = mid[less] + 1
            hi[go[~less]] = mid[~less]
        base = begin[seg[idx]] + (run - run % 2) * width
        place = base + (inside - run * width) + (lo - np.minimum(other, end))
        new = order.copy()
        new[place] = order[idx]
        order = new
        width *= 2
    return order


def least_holder(buf: np.ndarray, at: np.ndarray, segment: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes at ``at``: the least document among equal strings of its segment."""
    p = prefix_hashes(buf)
    order = suffix_order(buf, p, at, segment, length)
    x, s, d = at[order], segment[order], doc[order]
    out = np.empty(len(at), np.int64)
    if not len(at):
        return out
    same = s[1:] == s[:-1]
    near = np.flatnonzero(same)  # neighbours whose common extension reaches the length
    same[near] = span_hashes(p, x[near], x[near] + length) == span_hashes(p, x[near + 1], x[near + 1] + length)
    i = np.flatnonzero(same)
    bad = set()
    for j in range(0, len(i), 100_000):  # byte by byte
        part = i[j : j + 100_000]
        span = np.arange(length)
        wrong = (buf[x[part][:, None] + span] != buf[x[part + 1][:, None] + span]).any(1)
        bad.update(s[part[wrong]].tolist())
    group = np.cumsum(np.r_[True, ~same]) - 1
    least = np.full(group[-1] + 1, _LAST)
    np.minimum.at(least, group, d)
    out[order] = least[group]
    for z in bad:  # a collision: this segment by its bytes
        own, best = np.flatnonzero(segment == z), {}
        for j in own:
            b = buf[at[j] : at[j] + length].tobytes()
            best[b] = min(best.get(b, _LAST), int(doc[j]))
        for j in own:
            out[j] = best[buf[at[j] : at[j] + length].tobytes()]
    return out


def _answer_bytes(length):
    def run(table):
        a, h, h2, doc, shift, n = _join_rows(table, a=np.uint64, h=np.uint64, h2=np.uint64, doc=np.int64, shift=np.int64, n=np.int64)
        (buf,) = _join_rows(table, data=np.uint8)
        begin = np.cumsum(n + length - 1) - (n + length - 1)
        block = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        j = np.arange(int(n.sum())) - first[block]
        at = begin[block] + j
        best = doc[block]
        # a string whose hash no other has is equal to none
        name = mix(span_hashes(prefix_hashes(buf), at, at + length))
        order = np.argsort(name)
        cut = _cuts(name[order])
        i = np.sort(order[np.repeat(np.diff(cut) > 1, np.diff(cut))])
        # only strings with the same anchor at the same offset can be equal
        segment = mix(a[block[i]] + np.where(shift[block[i]] < 0, 0, shift[block[i]] - j[i] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(segment, kind="stable")
        i, segment = i[order], segment[order]
        best[i] = least_holder(buf, at[i], segment, doc[block[i]], length)
        earlier = i[best[i] < doc[block[i]]]
        bits = np.zeros(len(n), np.uint64)
        np.bitwise_or.at(bits, block[earlier], np.uint64(1) << j[earlier].astype(np.uint64))
        single = shift < 0
        least = np.where(single, best[first], doc)
        send = (bits > 0) | single
        ends = np.r_[0, np.cumsum(send)][np.r_[0, np.cumsum(_sizes(table.column("h")) // 8)]]
        cols = {"h": h, "h2": h2, "least": least, "more": bits}
        return pa.table({"g": table.column("g"), "kind": pa.array(np.ones(len(ends) - 1, np.int32))} | {c: _binary(x[send], ends) for c, x in cols.items()})

    return run


def _remove(length, k, key, key_type):
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(left, right):
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        # the answers to whole blocks hold the least documents of all groups, this one's too
        whole, part = _known(right, 0), _known(right, 1)
        # strings of salted anchors: the least document among the group's own and the answered ones
        strings, least = part[0], part[2]
        cols = [[] for _ in names]
        for rows, d, b, offs in _table_blocks(left, length, k):
            n = len(b.buf)
            step = np.zeros(n + 1, np.int32)
            if len(b.h):
                mine = d[b.row]
                at, found = match = _match(whole, b, np.arange(len(b.h)))
                done = found & (whole[2][at] < mine) if len(whole[0]) else found
                step[b.lo[done]] += 1  # no two blocks begin or end together
                step[b.hi[done] + length] -= 1
                lo = []
                i, salts = _open_blocks(mine, b, whole, match)
                plain = i[salts == 1]
                at, found = _match(part, b, plain)
                if found.any():
                    block, j = np.nonzero(part[3][at[found]][:, None] >> np.arange(length - k + 1, dtype=np.uint64) & np.uint64(1))
                    lo.append(b.lo[plain[found]][block] + j)
                block, start, names_ = _each_string(b, i[salts > 1], length)
                at, found = _lookup(strings, names_)
                if found.any():
                    hit = found & (least[at] < mine[block])
                    lo.append(start[hit])
                if lo:
                    np.add.at(step, np.concatenate(lo), 1)
                    np.add.at(step, np.concatenate(lo) + length, -1)
            gone = np.cumsum(step[:n]) > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            cut = offs[(offs > 0) & (offs < n)]
            edge[cut] = gone[cut]
            sums = lambda x: np.diff(np.r_[0, np.cumsum(x)][offs])
            removed = sums(gone)
            kept, end = b.buf[~gone].tobytes(), np.cumsum(np.diff(offs) - removed)
            shas = [hashlib.sha256(kept[e - m : e]).hexdigest() for e, m in zip(end.tolist(), (np.diff(offs) - removed).tolist())]
            got = [rows.column(rows.schema.names.index("k")), np.diff(offs), removed, sums(edge), shas]
            for c, x, t in zip(cols, got, kinds):
                c.append(x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t))
        return pa.table({n: pa.chunked_array(c, t) for n, c, t in zip(names, cols, kinds)})

    return run


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Each byte of a string of ``length`` bytes that also starts in a row with a smaller key is removed, judged on the
    input. Null and empty texts, and those shorter than ``length``, lose nothing. Rows with equal keys don't take
    from each other; rows with a null key come after all others and don't take from each other. Other columns
    aren't read."""
    k = max(4, length * 2 // 5)
    if not max(k, 7) < length <= k + 63:
        raise ValueError("length must be 8 to 105")
    src = docs.select(docs[key].cast("bigint").alias("k"), docs[text].alias("t"))
    size = src.agg(F.coalesce(F.sum(F.octet_length("t") + F.lit(2)), F.count(F.lit(1)))).first()[0] or 1
    groups = max(1, -(-size // GROUP_BYTES))
    buckets = max(1, -(-size * 2 // (length - k + 2) // BUCKET_KEYS))
    src = src.select(F.pmod(F.xxhash64("k", "t"), F.lit(groups)).alias("g"), "k", "t")
    texts = packed(src, {"k": pa.int64()}).groupBy("g")
    anchors = texts.applyInArrow(_ask_anchors(length, k, buckets), "g bigint, bucket int, a binary")
    anchors = anchors.groupBy("bucket").applyInArrow(_answer_anchors, "g bigint, a binary, n binary")
    blocks = texts.cogroup(anchors.groupBy("g")).applyInArrow(_ask_blocks(length, k, buckets), "g bigint, bucket int, a binary, h binary, h2 binary, doc binary, salts binary, kin binary")
    answer = "g bigint, kind int, h binary, h2 binary, least binary, more binary"
    blocks = blocks.groupBy("bucket").applyInArrow(_answer_blocks, answer)
    pieces = texts.cogroup(blocks.groupBy("g")).applyInArrow(_ask_bytes(length, k, buckets), "g bigint, bucket int, a binary, h binary, h2 binary, doc binary, shift binary, n binary, data binary")
    pieces = pieces.groupBy("bucket").applyInArrow(_answer_bytes(length), answer)
    return texts.cogroup(blocks.unionByName(pieces).groupBy("g")).applyInArrow(_remove(length, k, key, pa.int64()), f"{key} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


#: The same rows in DuckDB, for the table of documents: strings of 50 bytes are compared themselves, as hexadecimal text.
SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS s FROM docs WHERE length(x) >= 100),
strings AS (SELECT doc_id, s, substr(x, 2 * s + 1, 100) AS w FROM starts),
first AS (SELECT w, min(doc_id) AS least FROM strings GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT strings.doc_id, strings.s FROM strings JOIN first ON strings.w = first.w WHERE first.least < strings.doc_id),
marked AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS fresh FROM gone),
spanned AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked),
spans AS (SELECT doc_id, span, min(s) AS a, max(s) + 50 AS e FROM spanned GROUP BY doc_id, span),
gaps AS (SELECT doc_id, span, a, e, lead(a) OVER (PARTITION BY doc_id ORDER BY span) AS next_a FROM spans),
parts AS (SELECT gaps.doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, min(a) AS a0,
    string_agg(substr(x, 2 * e + 1, 2 * (coalesce(next_a, length(x) // 2) - e)), '' ORDER BY span) AS kept FROM gaps JOIN docs ON gaps.doc_id = docs.doc_id GROUP BY gaps.doc_id)
SELECT docs.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE substr(x, 1, 2 * a0) || kept END)) AS kept_sha256
FROM docs LEFT JOIN parts ON docs.doc_id = parts.doc_id
"""

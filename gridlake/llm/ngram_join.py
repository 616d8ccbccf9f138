"""Similarity join on sets of word n-grams: rare-first prefixes, length, positional and suffix filters, one verification.

Two texts link when their sets' Jaccard similarity is at least ``num/100``.

1. Texts are packed into compressed parts of bounded size, a table in the shared folder; equal sets (by 128 bits) are
   one node from here on.
2. Parts ask buckets of n-gram hashes how many sets hold each of their n-grams, so prefixes are rare-first by counts
   over the whole corpus. The counted hashes are wide enough that few n-grams share one; where some do, their count
   is that of both, which is as good an order.
3. Each node sends its prefix: as many of its rarest n-grams as any partner must share one of. An n-gram that no
   other set holds isn't sent.
4. Pairs that meet are verified once, by their whole sets.

An n-gram that more than ``hot`` sets hold is hot. Two linked texts share an n-gram that isn't hot, and then the rarest
one of these is in both prefixes; or they share hot n-grams only, and then nothing but their sets of hot n-grams and
their sizes decide. So hot n-grams are sent by classes, one for all nodes with the same hot n-grams and size. A class
whose hot n-grams reach the needed intersection with another class, or with itself, is one component with all its
members; else its members link through rarer n-grams only. A passage in a third of all texts is one class for each
size, and its holders never pair for its sake.

Nodes or classes that share a prefix n-gram of at most ``SMALL`` holders pair directly. Where more hold it, every one
pairs with the smallest; once those pairs are verified and components known, only pairs across components are left to
verify, so a group of k copies costs k pairs and no link between components is lost. A hot n-gram that very many
classes hold is salted; its salts meet block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.components import IN_TASK, components
from gridlake.llm.shared import chunks, distinct, from_planes, give_back, grams, materialise, mix, planes, word_hashes, words

WORDS = 5
HOT = 32  # sets that hold an n-gram up to which it isn't hot
PART = 8 << 20  # bytes of text in a part
PER_SALT = 50_000  # classes that one bucket of a hot n-gram may gather
SMALL = 4  # holders of a prefix n-gram up to which all of them pair
LONG = 200  # holders of an n-gram beyond which components are probed first
PROBE_ROUNDS = 1
PER_BUCKET = 300_000  # prefix entries of a bucket
PER_COUNT = 1_500_000  # n-grams that a counting bucket gathers
HASH_BITS = np.uint64(58)
_ENTRY = np.dtype([("token", "<u8"), ("fp", "<u8"), ("n", "<u4"), ("h", "<u4"), ("pos", "<u4"), ("salts", "<u4"), ("salt", "<u4")])

def sorted_sets(buf: np.ndarray, offs: np.ndarray, k: int, order=None):
    """(keys, hashes, first, count): each row's distinct n-grams, sorted by ``order(hashes)``, row after row."""
    low, s, e, rows = words(buf, offs)
    h, r = grams(word_hashes(low, s, e), rows, k)
    n = len(offs) - 1
    key = h if order is None else order(h)
    if len(key):
        cuts = np.flatnonzero(np.diff(r)) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(key)].tolist()):
            key[a:b].sort()
        keep = np.empty(len(key), bool)
        keep[0] = True
        keep[1:] = (key[1:] != key[:-1]) | (r[1:] != r[:-1])
        key, r = key[keep], r[keep]
    count = np.bincount(r, minlength=n).astype(np.int64)
    return key, np.r_[0, np.cumsum(count)][:-1], count


def fingerprints(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each row's set, in any order: sums of mixed hashes, mixed with the size."""
    out = []
    full = count > 0
    first = np.r_[0, np.cumsum(count)][:-1]
    for turn in (0, 0x5851F42D4C957F2D):
        f = np.zeros(len(count), np.uint64)
        if full.any():
            f[full] = np.add.reduceat(mix(key ^ np.uint64(turn)), first[full])
        out.append(mix(f + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out[0], out[1]


def needed(a, b, num: int):
    """The least intersection of sets of sizes a and b that link: 100 i >= num (a + b - i)."""
    return -((-num * (a + b)) // (100 + num))


def prefix_length(n, num: int):
    """So many of a set's first n-grams in any fixed order that every partner's prefix shares one."""
    return n + (-num * n) // 100 + 1


_PART = "part bigint, k array<bigint>, f1 array<bigint>, f2 array<bigint>, n array<bigint>, bytes array<bigint>, z binary"


def _pack_pass(k: int, most: int):
    """Parts of the texts: keys, fingerprints, set sizes, lengths, and all bytes compressed. A part's number is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            keys = pa.concat_arrays([h[0] for h in held])
            cols = [np.concatenate([h[c] for h in held]) for c in range(1, 5)]
            one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            ints = [one(pa.array(c.view(np.int64))) for c in cols]
            z = pa.compress(b"".join(h[5] for h in held), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([serial]), one(keys), *ints, pa.array([z], pa.binary())], ["part", "k", "f1", "f2", "n", "bytes", "z"])

        for rows, buf, offs in chunks(batches, "t"):
            key, _, count = sorted_sets(buf, offs, k)
            f1, f2 = fingerprints(key, count)
            held.append((rows.column(0), f1, f2, count, np.diff(offs), buf.tobytes()))
            size += len(buf) + 64 * len(count)
            if size >= most:
                yield flush()
                serial, held, size = serial + 1, [], 0
        if held:
            yield flush()

    return run


def _unpack(z: bytes, sizes: np.ndarray, most: int = 2 << 20):
    """(first row, bytes, offsets) of a part's texts, in pieces of bounded size."""
    whole = np.frombuffer(pa.decompress(z, int(sizes.sum()), codec="zstd", asbytes=True), np.uint8)
    offs = np.r_[0, np.cumsum(sizes)]
    i = 0
    while i < len(sizes):
        j = min(max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1), len(sizes))
        yield i, whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    give_back()


def _asked(z: bytes, sizes: np.ndarray, f1: np.ndarray, k: int, bits: int):
    """(sorted distinct n-gram hashes of a part, ``bits`` wide; how many of its different sets hold each)."""
    fresh = np.zeros(len(f1), bool)
    fresh[np.unique(f1, return_index=True)[1]] = True
    got = []
    for i, buf, offs in _unpack(z, sizes):
        key, _, count = sorted_sets(buf, offs, k)
        got.append(key[np.repeat(fresh[i : i + len(count)], count)] >> np.uint64(64 - bits))
    return distinct(np.concatenate(got))


def _ask_pass(k: int, bits: int, step: int):
    """For each part and bucket of hashes: the hashes as differences, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, f1, sizes, z in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                u, c = _asked(z.as_py(), sizes.values.to_numpy(), f1.values.to_numpy(), k, bits)
                bucket = (u // np.uint64(step)).astype(np.int64)
                at = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(u)] if len(u) else [0]
                rows = list(zip(at[:-1], at[1:]))
                hashes = [planes(np.diff(u[x:y], prepend=np.uint64(0)), 8) for x, y in rows]
                counts = [planes(c[x:y], 4) for x, y in rows]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[x]) for x, _ in rows], pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "part", "u", "c"])

    return run


def rarity(count: np.ndarray) -> np.ndarray:
    """The rank of an n-gram that so many sets hold, 1 to 63: up to 32 the count itself, beyond by doublings."""
    return np.where(count <= 32, count, np.minimum(63, 32 + np.ceil(np.log2(np.maximum(count, 33) / 32)))).astype(np.uint8)


def _count_pass(_, table):
    """For each asking part: the ranks of its n-grams by how many sets of all parts hold them, in its order."""
    u = [np.cumsum(from_planes(b.as_py(), 8)) for b in table.column("u")]
    c = np.concatenate([from_planes(b.as_py(), 4) for b in table.column("c")])
    every, inverse = np.unique(np.concatenate(u), return_inverse=True)
    rank = rarity(np.bincount(inverse, weights=c, minlength=len(every)).astype(np.int64))[inverse]
    ends = np.cumsum([len(x) for x in u])
    blobs = [rank[e - len(x) : e].tobytes() for e, x in zip(ends, u)]
    none = pa.nulls(len(u), pa.int64())
    return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "ranks": pa.array(blobs, pa.binary()), "pos": none, "id": none})


_LIVE = "m bigint, e binary, id bigint, n bigint, size bigint, z binary, cid bigint, fh bigint, hn bigint, grams binary, hot bigint"


def _prefix_pass(k: int, num: int, hot: int, bits: int, per_salt: int):
    """Per part: prefix entries of its nodes and hot classes; texts of nodes that have entries; classes and members."""
    edge = int(rarity(np.array([hot]))[0])

    def run(left, right):
        out = {c: [] for c in ("e", "node", "class", "member")}
        if left.num_rows and right.num_rows:
            sizes, f1, z = (left.column(c)[0] for c in ("bytes", "f1", "z"))
            sizes, f1, z = sizes.values.to_numpy(), f1.values.to_numpy(), z.as_py()
            pos_, ids_, buckets = (right.column(c).to_numpy() for c in ("pos", "id", "bucket"))
            ids, rep = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
            named = right.column("id").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            where = right.column("pos").combine_chunks().filter(pa.array(named)).to_numpy().astype(np.int64)
            ids[where] = right.column("id").combine_chunks().filter(pa.array(named)).to_numpy()
            rep[where] = True
            blobs = right.column("ranks").to_pylist()
            order = np.flatnonzero(~named)[np.argsort(buckets[~named], kind="stable")]
            u, _ = _asked(z, sizes, f1, k, bits)
            ranks = np.concatenate([np.frombuffer(blobs[i], np.uint8) for i in order]) if len(order) else np.zeros(0, np.uint8)
            for i, buf, offs in _unpack(z, sizes):
                _part_entries(i, buf, offs, ids, rep, u, ranks, out)
        e = np.concatenate(out["e"]) if out["e"] else np.zeros(0, _ENTRY)
        rows = [{"m": len(e), "e": e.tobytes()}] if len(e) else []
        rows += out["node"] + list({r["cid"]: r for r in out["class"]}.values()) + out["member"]
        kinds = dict(m=pa.int64(), e=pa.binary(), id=pa.int64(), n=pa.int64(), size=pa.int64(), z=pa.binary(), cid=pa.int64(), fh=pa.int64(), hn=pa.int64(), grams=pa.binary(), hot=pa.int64())
        return pa.table({c: pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()})

    def _part_entries(i, buf, offs, ids, rep, u, ranks, out):
        key, first, count = sorted_sets(buf, offs, k)
        if not len(key):
            return
        rank = ranks[np.searchsorted(u, key >> np.uint64(64 - bits))]
        row = np.repeat(np.arange(len(count)), count)
        token = (rank.astype(np.uint64) << HASH_BITS) | (key >> np.uint64(6))
        by = np.lexsort((token, row))
        token, rank, key = token[by], rank[by], key[by]
        at = np.arange(len(key)) - first[row]
        mine, own = rep[i : i + len(count)], ids[i : i + len(count)]
        long = prefix_length(count, num)
        cold = np.bincount(row[rank <= edge], minlength=len(count))
        take = (at < long[row]) & mine[row] & (rank > 1)

        def entries(j, name, salts, before=0):
            """Entries of n-grams j; of a class, only the n-grams behind the first ``before`` can be shared."""
            e = np.empty(len(j), _ENTRY)
            e["token"], e["fp"], e["n"], e["salts"] = token[j], name, count[row[j]], salts
            e["h"], e["pos"] = count[row[j]] - before, at[j] - before
            e["salt"] = e["fp"] % e["salts"].astype(np.uint64)
            return e

        j = np.flatnonzero(take & (rank <= edge))
        out["e"].append(entries(j, own[row[j]].view(np.uint64), 1))
        for r in np.unique(row[j]).tolist():
            text = buf[offs[r] : offs[r + 1]].tobytes()
            out["node"].append({"id": int(own[r]), "n": int(count[r]), "size": len(text), "z": pa.compress(text, codec="zstd", asbytes=True)})
        for r in np.flatnonzero(mine & (cold < long) & (count > 0)).tolist():
            h = np.sort(key[first[r] + cold[r] : first[r] + count[r]])
            if not len(h):
                continue
            fh = int(fingerprints(h, np.array([len(h)]))[0][0])
            cid = int(mix(np.array([fh], np.uint64) + count[r : r + 1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0])
            signed = lambda v: int(np.array([v], np.uint64).view(np.int64)[0])
            j = np.arange(first[r] + cold[r], first[r] + long[r])
            seen = 1 << np.maximum(rank[j].astype(np.int64) - 27, 0)  # 32 doublings of the rank, rounded up
            out["e"].append(entries(j, np.uint64(cid), np.maximum(1, -(-seen // per_salt)), int(cold[r])))
            out["class"].append({"cid": signed(cid), "fh": signed(fh), "hn": len(h), "n": int(count[r]), "grams": h.tobytes()})
            out["member"].append({"id": int(own[r]), "cid": signed(cid), "hot": int(long[r] - cold[r])})

    return run


def _deal_pass(buckets: int):
    """Prefix entries by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_py(), _ENTRY) for x in batch.column(0)]
            if not held:
                continue
            e = np.concatenate(held)
            b = (mix(e["token"] + e["salt"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            e, b = e[by], b[by]
            at = np.r_[0, np.flatnonzero(np.diff(b)) + 1, len(b)]
            # column by column, so that equal bytes stand together
            blobs = [b"".join(np.ascontiguousarray(e[f][x:y]).tobytes() for f in _ENTRY.names) for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(b[at[:-1]]), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _bucket_pass(num: int):
    def run(_, table):
        parts = []
        for b in table.column("blob"):
            raw = b.as_py()
            m, at = len(raw) // _ENTRY.itemsize, 0
            e = np.empty(m, _ENTRY)
            for f in _ENTRY.names:
                w = m * _ENTRY[f].itemsize
                e[f] = np.frombuffer(raw[at : at + w], _ENTRY[f])
                at += w
            parts.append(e)
        e = np.concatenate(parts)
        e = e[np.lexsort((e["fp"], e["n"], e["salt"], e["token"]))]
        same = (e["token"][1:] == e["token"][:-1]) & (e["salt"][1:] == e["salt"][:-1])
        e = e[np.r_[True, ~(same & (e["fp"][1:] == e["fp"][:-1]))]]
        start = np.flatnonzero(np.r_[True, (e["token"][1:] != e["token"][:-1]) | (e["salt"][1:] != e["salt"][:-1])])
        length = np.diff(np.r_[start, len(e)])
        run_of = np.repeat(np.arange(len(start)), length)
        small = (length <= SMALL) & (e["salts"][start] == 1)
        left, right = [], []
        for d in range(1, SMALL):
            i = np.flatnonzero(small[run_of[: len(e) - d]] & (run_of[d:] == run_of[: len(e) - d])) if len(e) > d else np.zeros(0, np.int64)
            left.append(i)
            right.append(i + d)
        j = np.flatnonzero(~small[run_of])
        left.append(start[run_of[j]])  # the smallest set of the run
        right.append(j)
        x, y = e[np.concatenate(left)], e[np.concatenate(right)]
        one = np.r_[np.ones(sum(map(len, left[:-1])), bool), np.zeros(len(j), bool)]
        n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
        ok = (x["fp"] != y["fp"]) & (100 * n >= num * m)
        behind = np.minimum(x["h"].astype(np.int64) - x["pos"], y["h"].astype(np.int64) - y["pos"])
        ok &= behind + np.minimum(x["pos"], y["pos"]) >= needed(n, m, num)
        x, y, one, n, m = x[ok], y[ok], one[ok], n[ok], m[ok]
        swap = x["fp"] > y["fp"]
        quad = np.stack([np.where(swap, y["fp"], x["fp"]), np.where(swap, x["fp"], y["fp"]), np.where(swap, m, n).astype(np.uint64), np.where(swap, n, m).astype(np.uint64)], 1)
        pairs, inverse = np.unique(quad, axis=0, return_inverse=True) if len(quad) else (quad, np.zeros(0, np.int64))
        shared = np.bincount(inverse.ravel(), weights=one, minlength=len(pairs)).astype(np.int64)
        members, often = np.unique(e["fp"][j], return_counts=True)
        # the other runs are kept for the second round; equal runs once
        big = np.flatnonzero(~small)
        total = np.add.reduceat(mix(e["fp"].copy()), start)
        gid = mix(total + length.astype(np.uint64))
        salted = e["salts"][start] > 1
        gid[salted] = mix(e["token"][start[salted]].copy())
        _, once, times = np.unique(np.stack([gid[big], e["salt"][start[big]].astype(np.uint64)], 1), axis=0, return_index=True, return_counts=True) if len(big) else (None, [], [])
        rows = [(int(gid[i].view(np.int64)), int(e["salts"][start[i]]), int(e["salt"][start[i]]), e["fp"][start[i] : start[i] + length[i]].view(np.int64), e["n"][start[i] : start[i] + length[i]].astype(np.int64), e["h"][start[i] : start[i] + length[i]].astype(np.int64)) for i in (big[j] for j in once)]
        p, g, q = len(pairs), len(rows), len(members)
        long = pa.int64()
        many = pa.list_(long)

        def column(kind, of_pairs=None, of_groups=None, of_members=None):
            parts = [pa.nulls(c, kind) if v is None else pa.array(v, kind) for c, v in ((p, of_pairs), (g, of_groups), (q, of_members))]
            return pa.concat_arrays(parts)

        signed = lambda v: np.ascontiguousarray(v).view(np.int64)
        return pa.table(
            {
                "a": column(long, signed(pairs[:, 0])),
                "b": column(long, signed(pairs[:, 1])),
                "na": column(long, signed(pairs[:, 2])),
                "nb": column(long, signed(pairs[:, 3])),
                "shared": column(long, shared),
                "gid": column(long, None, [r[0] for r in rows]),
                "salts": column(long, None, [r[1] for r in rows]),
                "salt": column(long, None, [r[2] for r in rows]),
                "times": column(long, None, times),
                "fps": column(many, None, [r[3] for r in rows]),
                "ns": column(many, None, [r[4] for r in rows]),
                "hs": column(many, None, [r[5] for r in rows]),
                "member": column(long, None, None, signed(members)),
                "often": column(long, None, None, often),
            }
        )

    return run


_MET = "a bigint, b bigint, na bigint, nb bigint, shared bigint, gid bigint, salts bigint, salt bigint, times bigint, fps array<bigint>, ns array<bigint>, hs array<bigint>, member bigint, often bigint"


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray | None]:
    """Rows of (fp, n, root, h) of a column of lists, sorted by n; None for null."""
    out = []
    for x in batch.column(batch.schema.names.index(name)):
        if not x.is_valid:
            out.append(None)
            continue
        v = x.values
        m = np.stack([v.field(c).to_numpy(zero_copy_only=False) for c in ("fp", "n", "root", "h")], 1)
        out.append(m[np.lexsort((m[:, 0], m[:, 1]))])
    return out


def _partners(x: np.ndarray, y: np.ndarray, num: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the range of y's rows, sorted by n, whose sizes allow a link with what x can share."""
    lo = np.searchsorted(y[:, 1], -(-num * x[:, 1] // 100), "left")
    hi = np.searchsorted(y[:, 1], np.minimum(x[:, 1] * 100 // num, x[:, 3] * (100 + num) // num - x[:, 1]), "right")
    return lo, np.maximum(lo, hi)


def _pair_batch(got: list[np.ndarray], times: int) -> pa.RecordBatch:
    """(a, b, na, nb, shared) from rows of (fp, fp, n, n), in unsigned order as the buckets give them."""
    g = np.concatenate(got).view(np.uint64)
    swap = g[:, 0] > g[:, 1]
    g[swap] = g[swap][:, [1, 0, 3, 2]]
    g = np.unique(g, axis=0).view(np.int64)
    return pa.RecordBatch.from_arrays([*(pa.array(g[:, c].copy()) for c in range(4)), pa.array(np.full(len(g), times))], ["a", "b", "na", "nb", "shared"])


def _cross_pairs(num: int):
    """Pairs across components inside one list, or between two lists, by the length filter; in blocks of rows.

    Inside a list, members of its largest component are only paired with those outside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = batch.column(batch.schema.names.index("times")).to_pylist()
            for x, y, t in zip(_lists(batch, "x"), _lists(batch, "y"), times):
                if y is None:
                    roots, count = np.unique(x[:, 2], return_counts=True)
                    x, y = x[x[:, 2] != roots[count.argmax()]], x
                lo, hi = _partners(x, y, num)
                for i in range(0, len(x), 256):
                    got = []
                    for j in range(i, min(i + 256, len(x))):
                        z = y[lo[j] : hi[j]]
                        z = z[(z[:, 2] != x[j, 2]) & (z[:, 0] != x[j, 0]) & (z[:, 3] >= needed(z[:, 1], x[j, 1], num))]
                        if len(z):
                            got.append(np.stack([np.full(len(z), x[j, 0]), z[:, 0], np.full(len(z), x[j, 1]), z[:, 1]], 1))
                    if got:
                        yield _pair_batch(got, t)

    return run


def _probe_pairs(num: int, probes: int = 4):
    """For each component of a list but its largest: the member that can share most of itself, with a few of the
    largest's, spread over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _lists(batch, "x"):
                roots, count = np.unique(x[:, 2], return_counts=True)
                most = roots[count.argmax()]
                y = x[x[:, 2] == most]
                by = x[np.lexsort((x[:, 3] / x[:, 1], x[:, 2]))]
                one = by[np.cumsum(count) - 1][roots != most]
                lo, hi = _partners(one, y, num)
                size = hi - lo
                got = []
                for p in range(probes):
                    h = mix(one[:, 0].copy().view(np.uint64) + np.uint64(p * len(x)))
                    ok = np.flatnonzero(size > 0)
                    z = y[lo[ok] + (h[ok] % size[ok].astype(np.uint64)).astype(np.int64)]
                    fit = z[:, 3] >= needed(z[:, 1], one[ok, 1], num)
                    z, ok = z[fit], ok[fit]
                    if len(z):
                        got.append(np.stack([one[ok, 0], z[:, 0], one[ok, 1], z[:, 1]], 1))
                if got:
                    yield _pair_batch(got, 0)

    return run


def suffix_filter(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """False if the sizes of the parts between y's quartiles alone forbid an intersection of ``least``."""
    at = y[[len(y) // 4, len(y) // 2, 3 * len(y) // 4]]
    cx, cy = np.diff(np.r_[0, np.searchsorted(x, at), len(x)]), np.diff(np.r_[0, np.searchsorted(y, at), len(y)])
    return int(np.minimum(cx, cy).sum()) >= least


def _verify(num: int, k: int):
    """The pairs that link, from rows of (a, b, set sizes, text sizes or null, compressed text or n-grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = b.to_pydict()
            sets: dict[int, np.ndarray] = {}
            texts = {}
            for side, n, x in (("a", "sa", "x"), ("b", "sb", "y")):
                for name, size, blob in zip(got[side], got[n], got[x]):
                    if size is None:
                        sets[name] = np.frombuffer(blob, np.uint64)
                    else:
                        texts[name] = (size, blob)
            names, i = list(texts), 0
            while i < len(names):
                j, size = i, 0
                while j < len(names) and (j == i or size + texts[names[j]][0] <= 2 << 20):
                    size += texts[names[j]][0]
                    j += 1
                raw = [pa.decompress(texts[x][1], texts[x][0], codec="zstd", asbytes=True) for x in names[i:j]]
                key, first, count = sorted_sets(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])], k)
                for x, f, c in zip(names[i:j], first.tolist(), count.tolist()):
                    sets[x] = key[f : f + c]
                i = j
            keep = []
            for i, (a, c, na, nb) in enumerate(zip(got["a"], got["b"], got["na"], got["nb"])):
                x, y, least = sets[a], sets[c], int(needed(na, nb, num))
                if min(len(x), len(y)) >= least and suffix_filter(x, y, least):
                    z = np.concatenate([x, y])
                    z.sort(kind="stable")
                    if int((z[1:] == z[:-1]).sum()) >= least:
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([got[c][i] for i in keep], pa.int64()) for c in ("a", "b")], ["a", "b"])

    return run


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, num: int = 80, hot: int = HOT) -> DataFrame:
    """(key, n_shingles, component_id) per row of ``docs``.

    Words are runs of bytes other than white space, A-Z lower-cased. A text of fewer than ``k`` words has its whole
    sequence as its only n-gram; a null, empty or blank text has none, is linked with nothing and its component is
    its own key. Repeated rows stay rows of one node. ``component_id`` is the least key reachable by links, null if all
    of them are null. Other columns aren't read, so their names don't matter. Sets are equal where two 64-bit sums over
    their n-grams' hashes are, and an intersection counts equal 64-bit hashes of n-grams within one pair. ``hot``, 1 to
    32, changes the work alone and no result."""
    spark = docs.sparkSession
    src = docs.select(docs[key].cast("bigint").alias("k"), docs[text].alias("t"))
    parts = materialise(src.mapInArrow(_pack_pass(k, PART), _PART))
    zipped = F.posexplode(F.arrays_zip("k", "f1", "f2", "n"))
    nodes = parts.select("part", zipped.alias("pos", "r")).select("part", F.col("pos").cast("bigint").alias("pos"), "r.*")
    least_of = nodes.where("n > 0").groupBy("f1", "f2").agg(F.min("k").alias("least"), F.max("n").alias("n"), F.min(F.struct("part", "pos")).alias("at"))
    # the first sum names a node; sets that share it, which chance hardly makes, are named by both
    twice = least_of.groupBy("f1").agg(F.count(F.lit(1)).alias("names"))
    least_of = least_of.join(twice, "f1").withColumn("id", F.when(F.col("names") > 1, F.xxhash64("f1", "f2")).otherwise(F.col("f1")))
    least_of = materialise(least_of.select("f1", "f2", "id", "least", "at"))
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(56, max(40, int(total).bit_length() + 8))
    step = -(-(1 << bits) // max(1, -(-total // PER_COUNT)))
    asked = parts.select("part", "f1", "bytes", "z").mapInArrow(_ask_pass(k, bits, step), "bucket bigint, part bigint, u binary, c binary")
    ranks = asked.groupBy("bucket").applyInArrow(_count_pass, "part bigint, bucket bigint, ranks binary, pos bigint, id bigint")
    firsts = least_of.select(F.col("at.part").alias("part"), F.lit(None).cast("bigint").alias("bucket"), F.lit(None).cast("binary").alias("ranks"), F.col("at.pos").alias("pos"), "id")
    known = ranks.unionByName(firsts).groupBy("part")
    sent = parts.select("part", "f1", "bytes", "z").groupBy("part").cogroup(known).applyInArrow(_prefix_pass(k, num, hot, bits, PER_SALT), _LIVE)
    sent = materialise(sent)
    classes = sent.where("grams is not null").groupBy("cid", "fh", "hn", "n").agg(F.first("grams").alias("grams"))
    members = sent.where("hot is not null").select("id", "cid", "hot")
    entries = sent.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    dealt = sent.where("m is not null").select("e").mapInArrow(_deal_pass(max(1, -(-entries // PER_BUCKET))), "bucket bigint, blob binary")
    live = materialise(dealt.groupBy("bucket").applyInArrow(_bucket_pass(num), _MET))
    groups = live.where("gid is not null")
    hubs = groups.where("salts > 1").select("gid", F.struct(F.element_at("ns", 1).alias("n"), F.element_at("fps", 1).alias("fp")).alias("hub")).distinct()
    top = hubs.groupBy("gid").agg(F.min("hub").alias("top"))
    between = hubs.join(top, "gid").where("hub.fp <> top.fp").select(F.col("hub.fp").alias("p"), F.col("hub.n").alias("np"), F.col("top.fp").alias("q"), F.col("top.n").alias("nq"))
    # in unsigned order, as the buckets give them
    low = (F.col("p") < F.col("q")) != ((F.col("p") < 0) != (F.col("q") < 0))
    ordered = [F.when(low, F.col(v)).otherwise(F.col(w)).alias(c) for c, v, w in (("a", "p", "q"), ("b", "q", "p"), ("na", "np", "nq"), ("nb", "nq", "np"))]
    between = between.select(*ordered, F.lit(0).cast("bigint").alias("shared"))
    pairs = live.where("a is not null").select("a", "b", "na", "nb", "shared").unionByName(between).groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    pairs = materialise(pairs)  # three jobs read them
    # a link shares so many prefix n-grams: those that few hold are counted, of the others the smaller number is a bound,
    # and so is that of the hot n-grams in a node's prefix
    often = live.where("member is not null").select("member", "often").unionByName(members.select(F.col("id").alias("member"), F.col("hot").alias("often")))
    often = materialise(often.groupBy("member").agg(F.sum("often").alias("often")))
    rest = F.greatest(*(F.ceil(F.col(c) * num / 100) - 1 for c in ("na", "nb")))
    least = F.greatest(F.ceil((F.col("na") + F.col("nb")) * num / F.lit(100 + num)) - rest, F.lit(1))
    most = F.col("shared") + F.least(F.coalesce("oa", F.lit(0)), F.coalesce("ob", F.lit(0)))

    def bounded(p, of):
        for side in ("a", "b"):
            p = p.join(of.toDF(side, f"o{side}"), side, "left")
        return p.where(most >= least).select("a", "b")

    first_round = materialise(bounded(pairs, often))
    once = groups.groupBy("gid", "salts", "salt").agg(F.sum("times").alias("times"), F.first("fps").alias("fps"), F.first("ns").alias("ns"), F.first("hs").alias("hs"))
    sets = sent.where("z is not null").select("id", "n", "size", "z").unionByName(classes.select(F.col("cid").alias("id"), "n", F.lit(None).cast("bigint").alias("size"), F.col("grams").alias("z")))

    def verified(p):
        for side, n, size, z in (("a", "na", "sa", "x"), ("b", "nb", "sb", "y")):
            p = p.join(sets.toDF(side, n, size, z), side)
        return materialise(p.mapInArrow(_verify(num, k), "a bigint, b bigint").distinct())

    # classes with the same hot n-grams link with the smallest of them, or with none
    small = classes.groupBy("fh").agg(F.min("n").alias("least_n"), F.min_by("cid", "n").alias("b"))
    alike = classes.join(small, "fh").where((F.col("cid") != F.col("b")) & (F.col("hn") * (100 + num) >= num * (F.col("n") + F.col("least_n"))))
    alike = materialise(alike.select(F.col("cid").alias("a"), "b"))
    itself = classes.where(F.col("hn") * (100 + num) >= 2 * num * F.col("n")).select("cid")

    def grouped(links, more=None, roots=None):
        """Components of nodes and classes; a class that links holds its members together. With ``more`` links beside
        those that made ``roots``, only links between the components of ``roots`` are looked at."""
        linked = links.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(itself).distinct()
        edges = members.join(linked, "cid", "left_semi").select(F.col("id").alias("a"), F.col("cid").alias("b"))
        edges = edges.unionByName(links if more is None else more)
        if roots is None:
            return components(edges, in_task=IN_TASK)
        for side in ("a", "b"):
            edges = edges.join(roots.toDF(side, f"r{side}"), side, "left")
        edges = edges.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct()
        up = components(edges, in_task=IN_TASK)
        moved = roots.join(up.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        return materialise(moved.unionByName(up.join(roots, "node", "left_anti")))

    links = verified(first_round).unionByName(alike)
    roots = grouped(links)
    each = once.select("gid", "salts", "salt", "times", F.explode(F.arrays_zip("fps", "ns", "hs")).alias("m"))
    each = each.select("gid", "salts", "salt", "times", F.col("m.fps").alias("fp"), F.col("m.ns").alias("n"), F.col("m.hs").alias("h"))
    few = pairs.select("a", "b", F.col("shared").alias("few"))

    def open_lists(each):
        """Of the lists with these members, those that hold several components."""
        named = each.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        split = named.groupBy("gid").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("gid")
        return materialise(named.join(split, "gid").groupBy("gid", "salts", "salt", "times").agg(F.collect_list(F.struct("fp", "n", "root", "h")).alias("x")))

    lists = open_lists(each)
    # where many hold an n-gram, a few probes from each component join most of them before all pairs are looked at
    for _ in range(PROBE_ROUNDS):
        if not lists.where(F.size("x") > LONG).limit(1).count():
            break
        probes = lists.where(F.size("x") > LONG).select("x").mapInArrow(_probe_pairs(num), "a bigint, b bigint, na bigint, nb bigint, shared bigint").distinct()
        probes = probes.join(few, ["a", "b"], "left").withColumn("shared", F.coalesce("few", F.lit(0)))
        more = verified(materialise(bounded(probes, often)))
        if not more.limit(1).count():
            break
        links = links.unionByName(more)
        roots = grouped(links, more, roots)
        # lists never open again
        lists = open_lists(lists.select("gid", "salts", "salt", "times", F.explode("x").alias("m")).select("gid", "salts", "salt", "times", "m.fp", "m.n", "m.h"))
    if lists.limit(1).count():
        other = lists.where("salts > 1").select("gid", F.col("salt").alias("salt2"), F.col("x").alias("y"))
        blocks = lists.where("salts > 1").join(other, "gid").where("salt < salt2").select("x", "y", "times")
        within = lists.select("x", F.lit(None).cast(lists.schema["x"].dataType).alias("y"), "times")
        # here each n-gram that many hold counts for just those pairs that share it
        crossed = within.unionByName(blocks).mapInArrow(_cross_pairs(num), "a bigint, b bigint, na bigint, nb bigint, shared bigint")
        crossed = crossed.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
        crossed = crossed.join(few, ["a", "b"], "left").withColumn("shared", F.col("shared") + F.coalesce("few", F.lit(0)))
        crossed = bounded(crossed, members.select("id", "hot"))
        more = verified(materialise(crossed.join(first_round, ["a", "b"], "left_anti")))
        roots = grouped(links.unionByName(more), more, roots)
    of_node = least_of.join(roots, least_of["id"] == roots["node"], "left").select("f1", "f2", "least", F.coalesce("root", "id").alias("root"))
    ends = of_node.groupBy("root").agg(F.min("least").alias("component"))
    label = of_node.join(ends, "root").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "component")
    out = nodes.join(label, (nodes["f1"] == label["g1"]) & (nodes["f2"] == label["g2"]) & (nodes["n"] > 0), "left")
    mine = F.when(F.col("n") == 0, F.col("k")).otherwise(F.col("component"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), mine.alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without those that link, directly or not, with one of a smaller key.

    Rows that share a key are one document and stay or go together. Rows with empty texts stay, and so do rows with
    a null key: nothing tells which of them is smaller."""
    gone = join(docs, key, text, **how).where(F.col("component_id") < F.col(key)).select(F.col(key).alias("__gone")).distinct()
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")


#: The same rows in DuckDB, for the table of documents: shingles are compared as texts, components by reachability.
SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM docs WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT docs.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM docs JOIN reach ON docs.doc_id = reach.doc_id LEFT JOIN sizes ON sizes.doc_id = docs.doc_id GROUP BY docs.doc_id
"""

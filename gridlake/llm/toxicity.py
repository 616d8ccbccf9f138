"""Toxicity scores: a convolutional classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the vectors of its hash and of the hashes of its first 4, 5 and 6 bytes. Vectors
stand in a hashed table whose slots keep the whole hash, so a word never borrows another's. Filters of widths 1, 2
and 3 slide over the words, the largest activation of each filter over the whole text is kept, and a logistic unit
on these, calibrated on rows kept out of training, gives the score. Thresholds are calibrated by language: they
judge scores, and no score depends on them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import chunks, distinct, fold, learn_in_task, materialise, mix, prefix_hashes, span_hashes, words

WIDTHS = (1, 2, 3)
DIM, FILTERS = 8, 8
PREFIXES = (4, 5, 6)
MOST_TOXIC, MOST_CLEAN = 1500, 3000  # rows of the training sample at most
MOST_FEATURES = 1 << 17
SHRINK = 8.0  # texts of the usual mixture that each feature is credited with
LEAST_TEXTS, LEAST_SHARE = 4, 0.004  # training texts that must hold a feature: so many and such a share, or it has no vector
SLOTS = 1 << 20
BINS = 128  # of one unit of the logit, in calibration counts
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows): for each run of letters and digits, A-Z lower-cased, its hash and those of its prefixes (0: too short)."""
    low, s, e, rows = words(buf, offs, _LETTER)
    p = prefix_hashes(low)
    out = np.zeros((len(s), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = mix(span_hashes(p, s, e) ^ np.uint64(1))
    for j, n in enumerate(PREFIXES, 1):
        long = e - s >= n
        out[long, j] = mix(span_hashes(p, s[long], s[long] + n) ^ np.uint64(n))
    return out, rows


@dataclass
class Model:
    slot: np.ndarray  # of each hash's low bits: number of the vector there, 0 for none
    tags: np.ndarray  # whole hash of each vector
    vectors: np.ndarray  # (n, DIM); the first is zero
    filters: list  # for each width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def ids(self, h: np.ndarray) -> np.ndarray:
        i = self.slot[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
        return np.where(self.tags[i] == h, i, 0)

    def activations(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(words, filters); behind a row's last word stand zero vectors."""
        v = self.vectors[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            v += self.vectors[ids[:, j]]
        out = np.empty((len(v), len(self.bias)), np.float32)
        for n, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            z = v @ f[0]
            for j in range(1, w):
                ok = (rows[j:] == rows[: len(rows) - j])[:, None]
                z[: len(z) - j] += np.where(ok, v[j:] @ f[j], 0)
            out[:, n * FILTERS : (n + 1) * FILTERS] = z
        return out + self.bias

    def pooled(self, h: np.ndarray, rows: np.ndarray, n: int, step: int = 1 << 15) -> np.ndarray:
        """(rows, filters): the largest activation over each whole text, in blocks of words; at least that of no words."""
        top = np.tile(self.bias, (n, 1)).astype(np.float32)
        tail = max(WIDTHS) - 1
        for i in range(0, len(h), step):
            a = self.activations(self.ids(h[i : i + step + tail]), rows[i : i + step + tail])[: min(step, len(h) - i)]
            r = rows[i : i + step]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            at = r[first]
            top[at] = np.maximum(top[at], np.maximum.reduceat(a, first, axis=0))
        return np.maximum(top, 0)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out[:-1] + self.out[-1]

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        h, rows = features(buf, offs)
        z = self.logit(self.pooled(h, rows, len(offs) - 1)) * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def _slots(tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the hashes in order of weight; of two in one slot the first stays."""
    at = (tags & np.uint64(SLOTS - 1)).astype(np.int64)
    _, first = np.unique(at, return_index=True)
    keep = np.sort(first)
    slot = np.zeros(SLOTS, np.int32)
    slot[at[keep]] = np.arange(1, len(keep) + 1)
    return slot, keep


def fit(texts: list[str], labels: list[int], epochs: int = 4, batch: int = 32, rate: float = 0.03, seed: int = 7) -> Model:
    """Trains on whole texts. A vector's first coordinate begins at its feature's log-odds, the rest at random.

    Without rows of both labels the model gives every text the share of label 1 (0 without any)."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    n = len(y)
    raw = [t.encode() for t in texts]
    offs = np.r_[0, np.cumsum([len(b) for b in raw])].astype(np.int64)
    h, rows = features(np.frombuffer(b"".join(raw), np.uint8), offs)
    total = len(WIDTHS) * FILTERS
    share = float(y.mean()) if n else 0.0
    flat = np.log(max(share, 1e-6) / max(1 - share, 1e-6)) if n else -60.0
    empty = Model(np.zeros(SLOTS, np.int32), np.zeros(1, np.uint64), np.zeros((1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(total, np.float32), np.zeros(total + 1, np.float32), 1.0, float(flat))
    if not n or share in (0.0, 1.0) or not len(h):
        return empty
    # texts that hold a feature, by label; a pair of row and feature counts once
    once_h, once_r, cut = [], [], np.searchsorted(rows, np.arange(0, n + 256, 256))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):  # a few texts at a time, so that no large array is sorted with its order
        part_h, part_r = h[a:b].ravel(), np.repeat(rows[a:b], h.shape[1])
        by = np.lexsort((part_h, part_r))
        part_h, part_r = part_h[by], part_r[by]
        first = part_h != 0
        first[1:] &= (part_h[1:] != part_h[:-1]) | (part_r[1:] != part_r[:-1])
        once_h.append(part_h[first])
        once_r.append(part_r[first].astype(np.int32))
    once_h, once_r = np.concatenate(once_h), np.concatenate(once_r)
    u, both = distinct(once_h.copy())
    ones = np.bincount(np.searchsorted(u, once_h), weights=y[once_r], minlength=len(u))
    del once_h, once_r
    odds = np.log((ones + SHRINK * share) / (both - ones + SHRINK * (1 - share))) - np.log(share / (1 - share))
    weight = np.abs(odds) * np.sqrt(both)
    often = np.flatnonzero(both >= max(LEAST_TEXTS, LEAST_SHARE * n))
    often = often[np.argsort(-weight[often], kind="stable")][:MOST_FEATURES]
    slot, keep = _slots(u[often])
    often = often[keep]
    tags = np.r_[np.zeros(1, np.uint64), u[often]]
    vectors = rng.normal(0, 0.05, (len(tags), DIM)).astype(np.float32)
    vectors[1:, 0] = np.clip(odds[often], -3, 3) / 3
    vectors[0] = 0
    filters = [rng.normal(0, 0.3 / w, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for g in filters:
        g[0, 0, : FILTERS // 2] = np.abs(g[0, 0, : FILTERS // 2]) + 0.5
    model = Model(slot, tags, vectors, filters, np.full(total, -0.1, np.float32), np.r_[rng.normal(0, 0.1, total), -1].astype(np.float32))
    model.out[: FILTERS // 2] = 0.5
    ids = model.ids(h)
    begin = np.searchsorted(rows, np.arange(n + 1))
    hist = [np.full(p.shape, 1e-3, np.float32) for p in (model.vectors, *model.filters, model.bias, model.out)]
    balance = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)

    def step(p, g, m, at=slice(None)):
        m[at] += g * g
        p[at] -= rate * g / np.sqrt(m[at])

    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // batch)):
            take = [np.arange(begin[d], begin[d + 1]) for d in part]
            own = np.repeat(np.arange(len(part)), [len(t) for t in take])
            x = ids[np.concatenate(take)]
            a = model.activations(x, own)
            top = np.tile(model.bias, (len(part), 1))
            arg = np.full((len(part), total), -1)
            at = np.searchsorted(own, np.arange(len(part) + 1))
            for d in range(len(part)):
                if at[d + 1] > at[d]:
                    i = a[at[d] : at[d + 1]].argmax(0)
                    best = a[at[d] + i, np.arange(total)]
                    better = best > top[d]
                    top[d] = np.where(better, best, top[d])
                    arg[d] = np.where(better, at[d] + i, -1)
            act = np.maximum(top, 0)
            z = model.logit(act)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * balance[part] / len(part)
            g_out = np.r_[act.T @ err, err.sum()].astype(np.float32)
            g_act = (err[:, None] * model.out[None, :-1] * (top > 0)).astype(np.float32)
            g_filters = [np.zeros_like(p) for p in model.filters]
            touched, grads = [], []
            for n_w, w in enumerate(WIDTHS):
                cols = slice(n_w * FILTERS, (n_w + 1) * FILTERS)
                d, k = np.nonzero((arg[:, cols] >= 0) & (g_act[:, cols] != 0))
                pos, g = arg[:, cols][d, k], g_act[:, cols][d, k]
                for j in range(w):
                    q = pos + j
                    ok = q < at[d + 1]
                    q, gj, kj = q[ok], g[ok], k[ok]
                    v = model.vectors[x[q]].sum(1)
                    np.add.at(g_filters[n_w][j].T, kj, gj[:, None] * v)
                    touched.append(x[q].ravel())
                    grads.append(np.repeat(gj[:, None] * model.filters[n_w][j][:, kj].T, x.shape[1], axis=0))
            if touched:
                t, g = np.concatenate(touched), np.concatenate(grads)
                rows_, back = np.unique(t, return_inverse=True)
                sums = np.zeros((len(rows_), DIM), np.float32)
                np.add.at(sums, back, g)
                real = rows_ > 0
                step(model.vectors, sums[real], hist[0], rows_[real])
            for p, g, m in zip(model.filters, g_filters, hist[1:]):
                step(p, g, m)
            step(model.bias, g_act.sum(0), hist[-2])
            step(model.out, g_out, hist[-1])
    return model


def calibrate(model: Model, cells: list[tuple], whole: dict, prior: float = 0.3) -> dict[str | None, float]:
    """Sets the model's scale and shift by Platt's method; returns a threshold by language.

    ``cells``: (language, label, bin of the logit, rows) of labelled rows that weren't trained on; ``whole``: labelled
    rows by language and label, trained on or not, to which the cells are weighted. Each language's threshold has the best
    F1, at the middle of the gap below it; a language with fewer than 20 rows of either label in ``cells`` takes
    ``prior``, and so does the key None."""
    got = {None: prior}
    cells = sorted(cells, key=lambda c: (c[0] is not None, c[0] or "", c[1], c[2]))
    if len({c[1] for c in cells}) < 2:
        return got
    seen: dict = {}
    for lang, label, _, n in cells:
        seen[lang, label] = seen.get((lang, label), 0) + n
    y = np.array([c[1] for c in cells], np.float64)
    bins = np.array([c[2] for c in cells])
    z = (bins + 0.5) / BINS
    n = np.array([c[3] * whole[c[0], c[1]] / seen[c[0], c[1]] for c in cells], np.float64)
    a, b = 1.0, 0.0
    ones, none = (n * y).sum(), (n * (1 - y)).sum()
    soft = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (none + 2))
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = n * np.maximum(p * (1 - p), 1e-9)
        e = n * (p - soft)
        g = np.array([(e * z).sum() + 1e-3 * (a - 1), e.sum()])
        m = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        d = np.linalg.solve(m, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
    model.scale, model.shift = float(max(a, 1e-3)), float(b)
    for lang in sorted({c[0] for c in cells if c[0] is not None}):
        if min(seen.get((lang, v), 0) for v in (0, 1)) < 20:
            continue
        mine = np.flatnonzero([c[0] == lang for c in cells])
        u, at = np.unique(-bins[mine], return_inverse=True)  # highest first
        right = np.cumsum(np.bincount(at, weights=n[mine] * y[mine]))
        k = int(np.argmax(2 * right / (np.cumsum(np.bincount(at, weights=n[mine])) + right[-1])))
        low = -u[k] / BINS
        cut = (low + (1 - u[k + 1]) / BINS) / 2 if k + 1 < len(u) else low
        got[lang] = float(1 / (1 + np.exp(-np.clip(model.scale * cut + model.shift, -60, 60))))
    return got


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2) -> tuple[Model, dict]:
    """(model, thresholds), of labelled rows whose fold isn't ``held``.

    The network trains on a bounded sample: at most ``MOST_TOXIC`` and ``MOST_CLEAN`` rows, those with the least hashes,
    of four fifths of the rows. All the others are scored and counted by language, label and bin of the logit, and
    the counts, weighted to all labelled rows, calibrate.

    Labels are joined by key; a key labelled more than once takes its largest label, null labels are left out."""
    y = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & (fold(F.col(key), folds) != held))
    y = y.groupBy(F.col(key).alias("id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    first = y.where(F.pmod(F.xxhash64(F.lit("later"), "id"), F.lit(5)) != 0).withColumn("order", F.xxhash64("id"))
    pick = first.where("y = 1").orderBy("order", "id").limit(MOST_TOXIC).unionByName(first.where("y = 0").orderBy("order", "id").limit(MOST_CLEAN))
    # at most MOST_TOXIC + MOST_CLEAN rows, so their ids can be broadcast and one task holds their texts
    pick = materialise(pick.select("id", "y"))
    src = docs.select(docs[key].alias("id"), docs[text].alias("t"), docs[lang].alias("lang"))
    rows = src.join(F.broadcast(pick), "id").select("id", "y", F.coalesce("t", F.lit("")).alias("t"))
    model = learn_in_task(rows, learn)
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = cast.value
        for part, buf, offs in chunks(batches, "t"):
            h, r = features(buf, offs)
            z = np.clip(m.logit(m.pooled(h, r, len(offs) - 1)).astype(np.float64), -60, 60)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.floor(z * BINS).astype(np.int32))], ["id", "lang", "bin"])

    # every text is scored before the join, so that the join moves no texts
    binned = src.mapInArrow(run, f"id {dict(docs.dtypes)[key]}, lang string, bin int").join(y, "id")
    binned = binned.join(F.broadcast(pick.select("id", F.lit(True).alias("trained"))), "id", "left")
    counts = binned.groupBy("lang", "y", F.when(F.col("trained").isNull(), F.col("bin")).alias("bin")).count().collect()
    whole: dict = {}
    for r in counts:
        whole[r["lang"], r["y"]] = whole.get((r["lang"], r["y"]), 0) + r["count"]
    return model, calibrate(model, [(r["lang"], r["y"], r["bin"], r["count"]) for r in counts if r["bin"] is not None], whole)


def learn(rows: list[dict]) -> Model:
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["t"]))
    return fit([r["t"] for r in rows], [r["y"] for r in rows])


def score(docs: DataFrame, model: Model, thresholds: dict, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, score, threshold, flagged) per row of ``docs``; the model, of fixed size, is broadcast.

    Null and empty texts get the score of no words. Equal texts have equal scores; other columns aren't read."""
    cast = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(docs[key].alias("k"), docs[lang].alias("l"), docs[text].alias("t"))
    kind, key_name = dict(docs.dtypes)[key], key

    def run(batches):
        m = cast.value
        for rows, buf, offs in chunks(batches, "t"):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(m.score(buf, offs))], [key_name, "lang", "score"])

    out = src.mapInArrow(run, f"{key} {kind}, lang string, score double")
    limit = F.lit(float(thresholds[None]))
    for name, value in thresholds.items():
        if name is not None:
            limit = F.when(F.col("lang") == name, value).otherwise(limit)
    return out.withColumn("threshold", limit).withColumn("flagged", F.col("score") >= F.col("threshold"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", folds: int = 4, held: int = 2, limit: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted, threshold, flagged) for every row; ``predicted`` is score >= ``limit``."""
    model, thresholds = train(docs, labels, key, folds=folds, held=held)
    s = score(docs, model, thresholds, key)
    return s.select(key, (fold(F.col(key), folds) == held).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"), "threshold", "flagged")


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows whose score reaches their language's threshold; a null language takes the general one."""
    model, thresholds = train(docs, labels, key, text, lang)
    cast = docs.sparkSession.sparkContext.broadcast((model, thresholds))

    def run(batches):
        m, limits = cast.value
        for rows, buf, offs in chunks(batches, text):
            limit = np.array([limits.get(x, limits[None]) for x in rows.column(rows.schema.names.index(lang)).to_pylist()])
            yield rows.filter(pa.array(m.score(buf, offs) < limit))

    return docs.mapInArrow(run, docs.schema)

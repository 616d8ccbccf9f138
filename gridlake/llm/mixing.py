"""Mixing to target weights with soft membership.

A multinomial classifier, trained on a labelled table, gives each document a posterior over domains. Nonnegative
rates are then fitted so that each domain's expected tokens, the sum over documents of rate * tokens * posterior,
come to its target: projected-gradient least squares in which a step needs one sum of a few numbers over all
documents, and a document's rate follows from the steps' sum, so that no rate is ever gathered anywhere.
"""

from __future__ import annotations

import logging
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import chunks, learn_in_task, materialise, word_hashes, words

_log = logging.getLogger(__name__)
DOMAINS = ("good", "low", "toxic")
#: Share of the mixture's tokens that each domain should have, and the mixture's tokens as a share of all.
TARGETS = {"good": 0.88, "low": 0.10, "toxic": 0.02}
SHARE = 0.5
SLOTS = 1 << 18
DENSE = 6
MARKED = 4  # standard errors from which a word's log-odds count
MOST_ROWS = 1500  # training rows of each domain at most
KEEP = 1e-9  # weight of staying near a rate of 1, as a share of all documents' curvature


def domain(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, y): 2 if a key is toxic, else 1 if its quality is 0, else 0. Null labels count as neither."""
    each = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max("toxic").alias("x"), F.min("quality").alias("q"))
    return each.select("id", F.when(F.col("x") > 0, 2).when(F.col("q") <= 0, 1).otherwise(0).alias("y"))


def features(buf: np.ndarray, offs: np.ndarray):
    """(slots, rows, dense, tokens): each word's hashed slot, and per row shares of repeats, signs, capitals and so on."""
    low, s, e, r = words(buf, offs)
    n = len(offs) - 1
    h = word_hashes(low, s, e)
    count = np.bincount(r, minlength=n).astype(np.float64)
    some = np.maximum(count, 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    size = np.diff(offs)
    inside = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offs]) / np.maximum(size, 1)
    upper = (buf >= 65) & (buf <= 90)
    sign = (buf > 32) & (buf < 128) & ~((buf >= 48) & (buf <= 57)) & ~upper & ~((buf >= 97) & (buf <= 122)) & (buf != 44) & (buf != 46)
    dense = np.stack([np.bincount(r, weights=again, minlength=n) / some, inside(upper), inside(sign), inside((buf >= 48) & (buf <= 57)), np.log1p(count) / 10, (size / np.maximum(1, some)) / 10], 1)
    return (h >> np.uint64(46)).astype(np.int64), r, dense.astype(np.float32), count.astype(np.int64)


class Classifier:
    """Softmax over mean word weights, dense features and, for each domain, the summed log-odds of its marked words.

    A few marked words decide about a long text, which a mean over all its words drowns."""

    def __init__(self, k: int):
        self.w, self.d, self.b = np.zeros((SLOTS, k), np.float32), np.zeros((DENSE + k, k), np.float32), np.zeros(k, np.float32)
        self.odds = np.zeros((SLOTS, k), np.float32)
        self.mean, self.std = np.zeros(DENSE + k, np.float32), np.ones(DENSE + k, np.float32)

    def mark(self, slots: np.ndarray, r: np.ndarray, y: np.ndarray) -> None:
        """Log-odds of slots by the texts that hold them; slots within ``MARKED`` standard errors of 0 aren't marked."""
        once = np.unique(r.astype(np.int64) * SLOTS + slots)
        k = self.odds.shape[1]
        held = np.bincount(once % SLOTS * k + y[once // SLOTS], minlength=SLOTS * k).reshape(SLOTS, k) + 0.5
        texts = np.bincount(y, minlength=k) + 1.0
        rest, others = held.sum(1, keepdims=True) - held, texts.sum() - texts
        odds = np.log(held / texts) - np.log(rest / others)
        error = np.sqrt(1 / held - 1 / texts + 1 / rest - 1 / others)
        self.odds = np.where(np.abs(odds) > MARKED * error, odds, 0).astype(np.float32)

    def inputs(self, slots: np.ndarray, r: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """The dense features and each domain's sum over a text's different marked words."""
        some = np.flatnonzero(self.odds.any(1)[slots])
        once = np.unique(r[some].astype(np.int64) * SLOTS + slots[some])
        sums = [np.bincount(once // SLOTS, weights=self.odds[once % SLOTS, c], minlength=len(dense)) for c in range(self.odds.shape[1])]
        return np.c_[dense, np.stack(sums, 1)].astype(np.float32)

    def posteriors(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots, r, dense, count = features(buf, offs)
        z = ((self.inputs(slots, r, dense) - self.mean) / self.std) @ self.d + self.b
        for c in range(z.shape[1]):
            z[:, c] += np.bincount(r, weights=self.w[slots, c], minlength=len(z)) / np.sqrt(np.maximum(count, 1))
        z = np.exp((z - z.max(1, keepdims=True)).astype(np.float64))
        return z / z.sum(1, keepdims=True), count


def fit(texts: list[str], y: list[int], k: int, prior: np.ndarray, epochs: int = 12, rate: float = 0.1) -> Classifier:
    """Trained by Adagrad on whole texts, one row of each domain as likely as the prior says; without rows: the prior."""
    m = Classifier(k)
    m.b = np.log(np.maximum(prior, 1e-6)).astype(np.float32)
    if not texts:
        return m
    raw = [t.encode() for t in texts]
    offs = np.r_[0, np.cumsum([len(b) for b in raw])].astype(np.int64)
    slots, r, dense, count = features(np.frombuffer(b"".join(raw), np.uint8), offs)
    y = np.array(y)
    m.mark(slots, r, y)
    x = m.inputs(slots, r, dense)
    m.mean, m.std = x.mean(0), x.std(0) + 1e-3
    x = (x - m.mean) / m.std
    have = np.bincount(y, minlength=k) / len(y)
    weight = (prior / np.maximum(have, 1e-9))[y]
    begin = np.searchsorted(r, np.arange(len(y) + 1))
    gw, gd = np.full(m.w.shape, 1e-2, np.float32), np.full(m.d.shape, 1e-2, np.float32)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in part])
            own = np.repeat(np.arange(len(part)), begin[part + 1] - begin[part])
            scale = 1 / np.sqrt(np.maximum(count[part], 1))
            z = x[part] @ m.d + m.b
            for c in range(k):
                z[:, c] += np.bincount(own, weights=m.w[slots[at], c], minlength=len(part)) * scale
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            err = p * weight[part][:, None] / len(part)
            g = x[part].T @ err + 1e-4 * m.d
            gd += g * g
            m.d -= rate * g / np.sqrt(gd)
            u, back = np.unique(slots[at], return_inverse=True)
            each = np.stack([np.bincount(back, weights=(err[:, c] * scale)[own], minlength=len(u)) for c in range(k)], 1) + 1e-5 * m.w[u]
            gw[u] += each * each
            m.w[u] -= rate * each / np.sqrt(gw[u])
            m.b -= (0.05 * err.sum(0)).astype(np.float32)
    return m


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Classifier:
    """The classifier from a bounded sample: at most ``MOST_ROWS`` labelled rows of each domain, least hashes first.

    The prior is counted over the labels of all documents."""
    src = docs.select(docs[key].alias("id"), docs[text].alias("t"))
    y = src.select("id").distinct().join(domain(labels, key), "id")
    y = materialise(y)
    count = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    prior = np.array([count.get(c, 0) + 1.0 for c in range(len(DOMAINS))])
    ranked = y.withColumn("order", F.xxhash64("id"))
    pick = None
    for c in range(len(DOMAINS)):
        part = ranked.where(F.col("y") == c).orderBy("order", "id").limit(MOST_ROWS)
        pick = part if pick is None else pick.unionByName(part)
    # at most MOST_ROWS rows a domain, so their ids can be broadcast and one task holds their texts
    rows = src.join(F.broadcast(pick.select("id", "y")), "id").select("id", "y", F.coalesce("t", F.lit("")).alias("t"))
    share = prior / prior.sum()

    def learn(got):
        got = sorted(got, key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["t"]))
        return fit([r["t"] for r in got], [r["y"] for r in got], len(DOMAINS), share)

    return learn_in_task(rows, learn)


def posteriors(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens, p): words of each text, and its posterior as an array in the order of ``DOMAINS``."""
    cast = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(docs[key].alias("k"), docs[text].alias("t"))

    def run(batches):
        m = cast.value
        for rows, buf, offs in chunks(batches, "t"):
            p, count = m.posteriors(buf, offs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(count), lists], [key, "tokens", "p"])

    return src.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, tokens bigint, p array<double>")


def _rate(pull: list[float]) -> Column:
    """A document's rate: 1 less its posterior's product with the summed steps, and 0 is the floor."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col("p")[i] * x for i, x in enumerate(pull)), F.lit(0.0)))


def rates(weighed: DataFrame, targets: list[float], most: int = 60, close: float = 1e-4) -> tuple[Column, list[float]]:
    """(rate as a column of tokens and p, the expected tokens reached) for target tokens of each domain.

    Minimises the squared distance of expected tokens from targets over rates of 0 or more, and of the rates that come
    as near takes those nearest to 1, by a term of ``KEEP``. The gradient of a document's rate is p . gap, so all steps
    together are p . pull with one number for each domain, and a rate is their sum's projection, max(0, 1 - p . pull).
    Steps are summed before the projection, so a rate at 0 can leave it, and the function whose gradient they follow,
    sum(tokens * rate^2) / 2 + pull . targets, is convex. Its curvature is summed over the documents whose rate isn't
    0. One sum over the documents tries a step at several lengths, by that curvature and by one that keeps a share of
    all documents', and takes the one of the least value. Stops when every domain is within ``close`` of the total,
    when no rates of 0 or more can come nearer by more than that (a bound by the gradient, not by what a step gains),
    or after ``most`` sums over the documents."""
    k = len(targets)
    goal = np.array(targets, float)
    enough = close * max(goal.sum(), 1.0)

    def sums(tries, gap):
        """For each try the expected tokens, curvature and squares; and the least product of a posterior with the gap."""

        def run(batches):
            total, least = np.zeros((len(tries), k + k * k + 1)), 0.0
            for b in batches:
                n = b.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
                p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                least = min(least, (p @ gap)[n > 0].min(initial=0.0))
                for x, pull in zip(total, tries):
                    r = np.maximum(0, 1 - p @ pull)
                    x[:k] += (r * n) @ p
                    x[k:-1] += ((np.where(r > 0, n, 0)[:, None] * p).T @ p).ravel()
                    x[-1] += (r * r) @ n
            yield pa.RecordBatch.from_arrays([pa.array([least]), pa.array([total.ravel().tolist()])], ["least", "total"])

        got = weighed.select("tokens", "p").mapInArrow(run, "least double, total array<double>").collect()  # a row a task
        each = np.sum([r["total"] for r in got], axis=0).reshape(len(tries), -1) if got else np.zeros((len(tries), k + k * k + 1))
        return [(x[:k], x[k:-1].reshape(k, k), x[-1]) for x in each], min([0.0, *(r["least"] for r in got)])

    pull = np.zeros(k)
    ((now, curve, squares),), _ = sums([pull], np.zeros(k))
    if not curve.any():
        return F.lit(1.0), [0.0] * k
    whole, keep = curve, KEEP * np.trace(curve)

    def value(x, sq):
        return sq / 2 + x @ goal + keep / 2 * (x @ x)

    for _ in range(most):
        gap = now - goal
        if np.abs(gap).max() < enough:
            break
        slope = gap - keep * pull
        newton = np.linalg.solve(curve + keep * np.eye(k), slope)
        wide = np.linalg.solve(curve + whole / 100 + keep * np.eye(k), slope)
        tries = [pull + newton * 2.0**-x for x in (-1, 0, 1, 2, 4, 6, 9, 12)] + [pull + wide * 2.0**-x for x in (0, 2, 4)]
        after, least = sums(tries, gap)
        # half the squared distance exceeds the best by no more than this: the best's total is bounded by today's gap
        over = gap @ now - min(least, 0.0) * (goal.sum() + np.sqrt(k) * np.linalg.norm(gap))
        if over <= enough * enough / 2:
            break
        best = min(range(len(tries)), key=lambda n: value(tries[n], after[n][2]))
        if value(tries[best], after[best][2]) >= value(pull, squares):  # beyond the sums' precision
            break
        pull, (now, curve, squares) = tries[best], after[best]
    return _rate([float(x) for x in pull]), [float(x) for x in now]


def mix(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", targets: dict = TARGETS, share: float = SHARE) -> DataFrame:
    """(key, tokens, p_<domain> ..., rate, copies) per row of ``docs``.

    ``copies`` is the rate rounded down or up so that its mean is the rate, by a hash of the key; 0 leaves a row out.
    Rows without words have tokens 0 and no part in the sums; null texts are empty. Without labels every posterior is
    the uniform prior. Repeated rows count as often as they stand. Other columns aren't read. The column ``rate`` holds
    the expected tokens as metadata, ``targets`` and ``reached`` by domain; a target missed is also logged."""
    model = train(docs, labels, key, text)
    weighed = materialise(posteriors(docs, model, key, text))
    total = weighed.agg(F.sum("tokens")).first()[0] or 0
    goal = {d: targets[d] * share * total for d in DOMAINS}
    rate, got = rates(weighed, list(goal.values()))
    reached = dict(zip(DOMAINS, got))
    missed = [f"{d}: {reached[d]:.0f} of {goal[d]:.0f} tokens" for d in DOMAINS if abs(reached[d] - goal[d]) > 1e-3 * sum(goal.values())]
    if missed:
        _log.warning("targets missed: %s", ", ".join(missed))
    out = weighed.withColumn("rate", rate)
    part = F.pmod(F.xxhash64(key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = (F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("bigint")).cast("bigint")
    return out.select(key, "tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), F.col("rate").alias("rate", metadata={"targets": goal, "reached": reached}), copies.alias("copies"))

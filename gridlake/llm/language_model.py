"""Language-model scoring: a weighted backoff automaton over n-grams counted in the whole corpus.

States are histories, arcs are n-grams seen in training, and a state without an arc for the next token takes its
failure arc to the next shorter history and pays that arc's weight. Neither counts nor automaton ever stand in one
place: texts are dealt into groups of bounded size, each group asks the count buckets for the n-grams it holds,
builds the part of the automaton that its own texts can reach, and each text goes through it once, from left to right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import distinct, fold, mix, packed, squeezed, unpacked, unsqueezed, word_hashes, words

ORDER = 3
STRENGTH = 8.0  # Dirichlet weight of the shorter history
GROUP_BYTES = 6 << 20
BUCKET_KEYS = 600_000
STRETCH = 1000  # tokens of a long text that are traversed beside its others
_BEGIN, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_KIND = np.uint64(3)  # low bits of a key: its order, 0 for the begin state


def sequences(buf: np.ndarray, offs: np.ndarray):
    """(tokens, rows): begin, the words' hashes and end, row after row."""
    low, s, e, r = words(buf, offs)
    n = len(offs) - 1
    h = word_hashes(low, s, e)
    count = np.bincount(r, minlength=n)
    size = count + 2
    first = np.cumsum(size) - size
    tok = np.empty(int(size.sum()), np.uint64)
    tok[first], tok[first + size - 1] = _BEGIN, _END
    tok[np.arange(len(h)) + 2 * r + 1] = h
    return tok, np.repeat(np.arange(n), size), first, size


def keys(tok: np.ndarray, first: np.ndarray, size: np.ndarray, order: int, bits: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: (keys of ``bits`` bits, positions of their last tokens). The begin token alone is kind 0; n-grams
    hold it only first."""
    at = np.arange(len(tok)) - np.repeat(first, size)
    h = tok.copy()
    out = []
    for n in range(1, order + 1):
        if n > 1:
            g = np.zeros_like(h)
            g[1:] = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + tok[1:]
            h = mix(g)
        pos = np.flatnonzero(at >= n - 1)
        k = (mix(h[pos] + np.uint64(n)) >> np.uint64(64 - bits)) & ~_KIND
        kind = np.full(len(pos), n, np.uint64)
        if n == 1:
            kind[tok[pos] == _BEGIN] = 0
        out.append((k | kind, pos))
    return out


def _group_keys(t: np.ndarray, order: int, bits: int):
    """(sorted unique keys of a group's texts, training counts, training tokens)."""
    seen, learnt, tokens = [], [], 0
    for rows, buf, offs in t:
        tok, _, first, size = sequences(buf, offs)
        held = np.asarray(rows.column(rows.schema.names.index("held")))
        learn = ~np.repeat(held, size)
        tokens += int((size[~held] - 1).sum())
        for k, pos in keys(tok, first, size, order, bits):
            mine = learn[pos]
            learnt.append(k[mine])
            seen.append(distinct(k[~mine])[0])
    if not seen:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    u, c = distinct(np.concatenate(learnt))
    del learnt
    every = distinct(np.concatenate([u, *seen]))[0]
    total = np.zeros(len(every), np.int64)
    total[np.searchsorted(every, u)] = c
    return every, total, tokens


def _text_chunks(table) -> Iterator:
    yield from unpacked(table, ["k", "held"], 1 << 20)


def _ask(order: int, bits: int, step: int):
    """Per group: its keys, as differences, with its own training counts, one row for each bucket that it has keys of."""

    def run(table):
        g = table.column("g")[0].as_py()
        u, c, tokens = _group_keys(_text_chunks(table), order, bits)
        bucket = (u // np.uint64(step)).astype(np.int64)
        at = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(u)]
        spans = list(zip(at[:-1], at[1:]))
        return pa.table(
            {
                "g": pa.array([g] * len(spans), pa.int64()),
                "bucket": pa.array([int(bucket[x]) for x, _ in spans], pa.int64()),
                "m": pa.array([y - x for x, y in spans], pa.int64()),
                "names": pa.array([squeezed(np.diff(u[x:y], prepend=np.uint64(0)), 8) for x, y in spans], pa.binary()),
                "counts": pa.array([squeezed(c[x:y], 4) for x, y in spans], pa.binary()),
                "tokens": pa.array([tokens] + [0] * (len(spans) - 1), pa.int64()),
            }
        )

    return run


def _answer(table):
    """Per bucket: every asking row gets what the corpus counts beyond its own counts of its keys, in its order."""
    sizes = table.column("m").to_pylist()
    names = [np.cumsum(unsqueezed(b.as_py(), m, 8)) for b, m in zip(table.column("names"), sizes)]
    own = [unsqueezed(b.as_py(), m, 4) for b, m in zip(table.column("counts"), sizes)]
    u = distinct(np.concatenate(names))[0]
    total = np.zeros(len(u), np.uint64)
    for x, c in zip(names, own):
        total[np.searchsorted(u, x)] += c
    types = int(((total > 0) & ((u & _KIND) == 1)).sum())
    back = [squeezed(total[np.searchsorted(u, x)] - c, 8) for x, c in zip(names, own)]
    n = table.num_rows
    return pa.table({"g": table.column("g"), "bucket": table.column("bucket"), "m": table.column("m"), "more": pa.array(back, pa.binary()), "tokens": table.column("tokens"), "types": pa.array([types] + [0] * (n - 1), pa.int64())})


class Automaton:
    """The part of the automaton that a group's texts can reach, over the ids of its keys.

    A key seen in training is an arc from the state of its history, ``source``, and its weight is p(w|h) = (c(hw) +
    m p(w|h')) / (c(h) + m). Keys shorter than the order are states too. The arc leads to ``target``: the state of its
    whole n-gram, or of the longest ending that is a state. ``fail`` is a state's failure arc, to the state of its
    history without the first token, and costs m / (c(h) + m), so the weights of a state sum to one. The root, id -1,
    has an arc for every token: (c + 1) / (tokens + types + 1)."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, tokens: int, types: int, strength: float, order: int):
        self.names, self.order, self.strength = names, order, strength
        n = len(names)
        self.counts = np.r_[counts, 0].astype(np.float64)
        self.kind = np.r_[np.maximum(names & _KIND, 1), 0].astype(np.int8)  # of a state: tokens in its history
        self.mass = float(tokens + types + 1)
        self.source, self.fail = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)

    def ids(self, tok, first, size, bits: int) -> np.ndarray:
        """The id of the n-gram of each order that ends at each position, -1 where the text is too short; learns which
        arcs leave which states."""
        out = np.full((self.order, len(tok)), -1, np.int32)
        for n, (k, pos) in enumerate(keys(tok, first, size, self.order, bits)):
            u, back = np.unique(k, return_inverse=True)
            out[n, pos] = np.searchsorted(self.names, u).astype(np.int32)[back]
            if n:
                self.source[out[n, pos]] = out[n - 1, pos - 1]
                self.fail[out[n, pos]] = out[n - 1, pos]
        return out

    def close(self) -> None:
        """Weights and targets, once all arcs are known."""
        c, m = self.counts, self.strength
        p = (c + 1.0) / self.mass
        for n in range(2, self.order + 1):
            g = np.flatnonzero((self.kind == n) & (c > 0))
            p[g] = (c[g] + m * p[self.fail[g]]) / (c[self.source[g]] + m)
        self.weight = np.log10(p, out=p)
        self.arc = (c > 0) | (self.kind == 1)
        del self.source
        self.cost = np.log10(m / (c + m))
        self.target = np.where(c > 0, np.where(self.kind < self.order, np.arange(len(c)), self.fail), -1).astype(np.int32)

    def traverse(self, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """log10 probability of each text. Texts go from left to right, side by side, each with its state.

        A state knows no more than ``order`` - 1 tokens, so a stretch of a long text that begins that many tokens early,
        at the root, has come to the text's own state where its tokens begin to count."""
        early = self.order - 1
        parts = np.maximum(1, -(-(size - 1) // STRETCH))
        text = np.repeat(np.arange(len(size)), parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        ahead = np.where(part > 0, early, 0)
        start = first[text] + 1 + part * STRETCH - ahead
        length = np.minimum(size[text] - 1 - part * STRETCH, STRETCH) + ahead
        by = np.argsort(-length, kind="stable")
        text, start, length, ahead = text[by], start[by], length[by], ahead[by]
        begin = self.target[ids[0, first[text]]] if self.order > 1 else np.full(len(text), -1, np.int32)
        state = np.where(ahead > 0, -1, begin).astype(np.int32)
        count = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        total, flat, width = np.zeros(len(text)), ids.ravel(), ids.shape[1]
        for t, live in enumerate(count.tolist()):  # stretches that still have a token
            if t == early:
                total[ahead > 0] = 0.0
            s = state[:live]
            at = start[:live] + t
            arc = flat[self.kind[s].astype(np.int64) * width + at]
            lost = np.flatnonzero(~self.arc[arc])
            if len(lost):
                s = s.copy()
                while len(lost):  # no arc for this token: pay the failure arc and try the shorter state
                    total[lost] += self.cost[s[lost]]
                    s[lost] = self.fail[s[lost]]
                    arc[lost] = flat[self.kind[s[lost]].astype(np.int64) * width + at[lost]]
                    lost = lost[~self.arc[arc[lost]]]
            total[:live] += self.weight[arc]
            state[:live] = self.target[arc]
        return np.bincount(text, weights=total, minlength=len(size))


def _score(order: int, bits: int, strength: float, key: str, key_type):
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [key_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(left, right):
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        by = np.argsort(np.asarray(right.column("bucket")))
        blobs, lengths = right.column("more"), right.column("m").to_pylist()
        u, own, _ = _group_keys(_text_chunks(left), order, bits)
        totals, at = own, 0
        for i in by:
            more = unsqueezed(blobs[i].as_py(), lengths[i], 8).view(np.int64)
            totals[at : at + len(more)] += more
            at += len(more)
        tokens, types = right.column("all_tokens")[0].as_py(), right.column("all_types")[0].as_py()
        model = Automaton(u, totals, tokens, types, strength, order)
        held, ids, starts, sizes, k, at = [], [], [], [], [], 0
        for rows, buf, offs in _text_chunks(left):
            tok, _, first, size = sequences(buf, offs)
            ids.append(model.ids(tok, first, size, bits))
            starts.append(first + at)
            sizes.append(size)
            k.append(rows.column(rows.schema.names.index("k")))
            held.append(rows.column(rows.schema.names.index("held")))
            at += len(tok)
        model.close()
        ids, first, size = np.concatenate(ids, 1), np.concatenate(starts), np.concatenate(sizes)
        count = model.counts[ids[0]]
        count[first] = 0
        base = np.log10((count + 1.0) / model.mass)
        base[first] = 0.0
        got = [pa.concat_arrays(k).cast(key_type), pa.concat_arrays(held), size - 1, np.add.reduceat(count > 0, first, dtype=np.int64), np.full(len(size), tokens), np.add.reduceat(base, first), model.traverse(ids, first, size)]
        return pa.table({n: x if isinstance(x, pa.Array) else pa.array(x, t) for n, x, t in zip(names, got, kinds)})

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from rows whose crc32(key as text) mod ``folds`` isn't ``held`` (a null key counts as the empty text).
    Tokens: runs other than white space, A-Z lower-cased, then one end. ``base_score``: log10 of add-one unigrams.
    ``score``: log10 of the automaton's model of ``order`` 1 to 3, in which each state's arcs and failure arc sum to
    one. A null, empty or blank text is its end token alone. Equal rows are scored alike and all stay. Other columns
    aren't read. A key of bigint, int or string keeps its type; another raises. N-grams are told apart by hashes 30
    bits wider than the number of all n-grams needs, up to 64, so one in 2^30 shares its counts with another."""
    kind = dict(docs.dtypes)[key]
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    if key_type is None:
        raise ValueError(f"the key {key} must be bigint, int or string, not {kind}")
    if not 1 <= order <= 3:
        raise ValueError("the order must be 1 to 3")
    src = docs.select(docs[key].alias("k"), (fold(docs[key], folds) == held).alias("held"), docs[text].alias("t"))
    size = src.agg(F.coalesce(F.sum(F.octet_length("t") + F.lit(2)), F.count(F.lit(1)))).first()[0] or 1
    groups = max(1, -(-size // GROUP_BYTES))
    bits = min(64, (size * order // 6).bit_length() + 30)
    step = -(-(1 << bits) // max(1, -(-size * order // 6 // BUCKET_KEYS)))
    src = src.select(F.pmod(F.xxhash64("k", "t"), F.lit(groups)).alias("g"), "k", "held", "t")
    src = packed(src, {"k": key_type, "held": pa.bool_()})
    asked = src.groupBy("g").applyInArrow(_ask(order, bits, step), "g bigint, bucket bigint, m bigint, names binary, counts binary, tokens bigint")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "g bigint, bucket bigint, m bigint, more binary, tokens bigint, types bigint")
    total = answers.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"))
    answers = answers.select("g", "bucket", "m", "more", total.select("n").scalar().alias("all_tokens"), total.select("v").scalar().alias("all_types"))
    schema = f"{key} {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return src.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_score(order, bits, strength, key, key_type), schema)


#: The same rows in DuckDB, for the table of documents, order 3 and strength 8.
SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)), CAST(4294967295 AS BIGINT)) % 7 = 2 AS held_out FROM documents),
seqs AS (SELECT doc_id, held_out, list_concat(['b'], list_transform(words, lambda x: 'w' || x), ['e']) AS t FROM docs),
tokens AS (SELECT doc_id, held_out, t, unnest(range(2, len(t) + 1)) AS i FROM seqs),
spots AS (SELECT doc_id, held_out, i, t[i] AS w, t[i - 1] AS h1, CASE WHEN i > 2 THEN t[i - 2] END AS h2 FROM tokens),
one AS (SELECT w, count(*) AS c FROM spots WHERE NOT held_out GROUP BY w),
hist1 AS (SELECT h1, count(*) AS c FROM spots WHERE NOT held_out GROUP BY h1),
two AS (SELECT h1, w, count(*) AS c FROM spots WHERE NOT held_out GROUP BY h1, w),
hist2 AS (SELECT h2, h1, count(*) AS c FROM spots WHERE NOT held_out AND h2 IS NOT NULL GROUP BY h2, h1),
three AS (SELECT h2, h1, w, count(*) AS c FROM spots WHERE NOT held_out AND h2 IS NOT NULL GROUP BY h2, h1, w),
total AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM one),
p1 AS (SELECT spots.*, coalesce(one.c, 0) AS c1, n, (coalesce(one.c, 0) + 1) / (n + v + 1) AS p FROM spots CROSS JOIN total LEFT JOIN one ON spots.w = one.w),
p2 AS (SELECT p1.* EXCLUDE (p), p AS base, CASE WHEN hist1.c > 0 THEN (coalesce(two.c, 0) + 8 * p) / (hist1.c + 8) ELSE p END AS p
    FROM p1 LEFT JOIN hist1 ON p1.h1 = hist1.h1 LEFT JOIN two ON p1.h1 = two.h1 AND p1.w = two.w),
p3 AS (SELECT p2.* EXCLUDE (p), CASE WHEN hist2.c > 0 THEN (coalesce(three.c, 0) + 8 * p) / (hist2.c + 8) ELSE p END AS p
    FROM p2 LEFT JOIN hist2 ON p2.h1 = hist2.h1 AND p2.h2 = hist2.h2 LEFT JOIN three ON p2.h1 = three.h1 AND p2.h2 = three.h2 AND p2.w = three.w)
SELECT doc_id, held_out, count(*) AS n_tokens, CAST(count(*) FILTER (c1 > 0) AS BIGINT) AS n_known, max(n) AS train_tokens, sum(log10(base)) AS base_score, sum(log10(p)) AS score
FROM p3 GROUP BY doc_id, held_out
"""

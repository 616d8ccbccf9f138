"""Secret scans, in DataFrame functions only: spans by pattern, judged by how many owners hold the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import materialise

#: Kinds in the order of the contract. The keyword's letters are in either case, spelt out so that no engine folds others.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
#: A run of 32 or more is what is left of the runs of 1 or more once the short ones are dropped.
HEX = "[0-9a-f]{32,}"
#: What the ownership statistics judge beside the base spans.
GENERIC = "[A-Za-z0-9+/_-]{20,}"

HOT_USES = 500_000  # uses of a value beyond which its rows aren't gathered by value

SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
PIECE = 256  # code points of the pieces that a text is cut into to take parts out of it


def let(value: Column, use) -> Column:
    """``use(value)``, in which ``value`` is computed once, also where ``use`` names it in the lambda of a list."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, add, neutral: int) -> Column:
    """``add`` over each value and all before it, by doubling: step k adds what stands 2^k places before."""
    wide = values.cast("array<bigint>")
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc, k):
        back = F.call_function("shiftleft", F.lit(1), k)
        ahead = F.concat(F.array_repeat(F.lit(neutral).cast("bigint"), back), F.slice(acc, F.lit(1), F.size(acc) - back))
        return F.zip_with(ahead, acc, add)

    return F.aggregate(steps, wide, step)


def spans(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` with code point offsets, as ``SPAN``.

    The pieces between matches, from split, and the matches themselves give the offsets: each match ends where the
    lengths up to it add up to. Work grows with n log n of the matches. ``value`` is the group's text."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
    sized = F.transform(steps, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), x["value"].alias("value")))

    def placed(x):
        ends = running(F.transform(x, lambda s: s["gap"] + s["hit"]), lambda a, b: a + b, 0)
        return F.zip_with(x, ends, lambda s, e: F.struct(F.lit(kind).alias("kind"), (e - s["hit"]).alias("start"), e.alias("end"), s["value"].alias("value")))

    return F.when(text.rlike(pattern), let(sized, placed)).otherwise(F.array().cast(SPAN))


def outside(spans_: Column, others: Column) -> Column:
    """Those of ``spans_`` that share no character with any of ``others``, both as ``SPAN``.

    In one list by start, a span meets another that began before it if the furthest end so far lies beyond its start,
    and one that begins after it if the nearest start to come lies before its end."""
    far = (1 << 62)

    def mark(own):
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), s["kind"].alias("kind"), s["value"].alias("value"))

    def judged(x):
        ends = running(F.transform(x, lambda s: F.when(s["own"], F.lit(-1)).otherwise(s["end"])), lambda a, b: F.greatest(a, b), -1)
        starts = F.reverse(running(F.reverse(F.transform(x, lambda s: F.when(s["own"], F.lit(far)).otherwise(s["start"]))), lambda a, b: F.least(a, b), far))
        free = F.filter(F.arrays_zip(x.alias("s"), ends.alias("e"), starts.alias("n")), lambda z: z["s"]["own"] & (z["e"] <= z["s"]["start"]) & (z["n"] >= z["s"]["end"]))
        return F.transform(free, lambda z: F.struct(z["s"]["kind"].alias("kind"), z["s"]["start"].alias("start"), z["s"]["end"].alias("end"), z["s"]["value"].alias("value")))

    merged = F.array_sort(F.concat(F.transform(spans_, mark(True)), F.transform(others, mark(False))))
    return F.when((F.size(spans_) == 0) | (F.size(others) == 0), spans_).otherwise(let(merged, judged))


def replaced(text: Column, cuts: Column, mark: str) -> Column:
    """``text`` with each of ``cuts`` (a, b), sorted and possibly overlapping, replaced; what overlaps becomes one mark.

    The text is cut once into pieces of ``PIECE`` code points, so taking out a part doesn't walk the text from its start."""

    def part(pieces, a, b):
        first = F.floor(a / PIECE).cast("int")
        held = F.array_join(F.slice(pieces, first + 1, F.floor(b / PIECE).cast("int") - first + 1), "")
        return F.substr(held, (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))

    def cut(x):
        reach = running(F.transform(x["cuts"], lambda s: s["b"]), lambda a, b: F.greatest(a, b), 0)
        before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(reach, F.lit(1), F.size(reach) - 1))
        kept = F.filter(F.zip_with(before, x["cuts"], lambda at, s: F.struct(at.alias("at"), s["a"].alias("a"))), lambda s: s["a"] >= s["at"])
        ahead = F.array_join(F.transform(kept, lambda s: F.concat(part(x["pieces"], s["at"], s["a"]), F.lit(mark))), "")
        return F.concat(ahead, part(x["pieces"], F.element_at(reach, -1), x["size"]))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(F.struct(pieces.alias("pieces"), cuts.alias("cuts"), F.length(text).cast("bigint").alias("size")), cut)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind, the failing ones dropped."""
    return {
        "assign": F.filter(spans(text, "assign", ASSIGN, 2), lambda s: F.length(s["value"]) >= 8),
        "access": F.filter(spans(text, "access", ACCESS), lambda s: F.length(s["value"]) >= 16),
        "hex": spans(text, "hex", HEX),
    }


def _joined(spans_: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    rank = lambda k: F.when(k == "assign", 0).when(k == "access", 1).when(k == "hex", 2).otherwise(3)
    keyed = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].alias("a"), rank(s["kind"]).alias("b"), s["end"].alias("c"), s["kind"].alias("d"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repos, n_uses) over (value_hash, owner, repo): distinct owners, distinct repositories
    whoever owns them, and rows. Null owners and repositories count as one of their own.

    Two sums, each partial before its shuffle, so a value that a third of all rows hold meets in no task."""
    held = F.array(F.struct(F.lit(False).alias("repo"), F.col("owner").alias("name")), F.struct(F.lit(True).alias("repo"), F.col("repo").alias("name")))
    by_name = candidates.select("value_hash", F.explode(held).alias("h")).groupBy("value_hash", "h").agg(F.count(F.lit(1)).alias("n"))
    repo = F.col("h.repo").cast("bigint")
    return by_name.groupBy("value_hash").agg(F.sum(1 - repo).alias("n_owners"), F.sum(repo).alias("n_repos"), F.sum((1 - repo) * F.col("n")).alias("n_uses"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id", copied_owners: int = 3, copied_repos: int = 12) -> DataFrame:
    """One row per row of ``docs`` with its base spans, and live spans that corpus-wide ownership adds.

    Every base span stays. A generic token (``GENERIC``, with 3 digits and a letter, outside the base spans) is added
    as kind ``live`` if one owner alone holds its value, in fewer than ``copied_repos`` repositories. A value is an
    example if ``copied_owners`` or more owners, or ``copied_repos`` or more repositories, hold it; ``n_live`` and
    ``n_example`` count the row's spans, base and added, on either side.

    Null texts are empty and have no spans; null owners and repositories count as one of their own; rows that are
    equal are kept and each counts; a null key stays null; columns beside those named are not read. The texts are
    scanned once: spans and hashes go to a table in the shared folder, and only hashes are joined."""
    t = F.coalesce(F.col("t"), F.lit(""))
    light = docs.select(docs[key].alias("k"), docs[text].alias("t"), docs[owner].cast("string").alias("owner"), docs[repo].cast("string").alias("repo"))
    base = base_spans(t)
    wanted = lambda s: s["value"].rlike("[0-9][^0-9]*[0-9][^0-9]*[0-9]") & s["value"].rlike("[A-Za-z]")
    light = light.select("k", "owner", "repo", F.xxhash64("k", "t").alias("th"), *(c.alias(n) for n, c in base.items()), F.filter(spans(t, "live", GENERIC), wanted).alias("generic"))
    light = light.withColumn("base", F.concat("assign", "access", "hex"))
    light = materialise(light.select("k", "owner", "repo", "th", *(F.size(n).cast("bigint").alias(f"n_{n}") for n in base), "base", outside(F.col("generic"), F.col("base")).alias("generic")))

    # equal rows share one identity: their spans are equal, and so are the results joined to them
    named = light.withColumn("id", F.struct(F.coalesce(F.col("k").cast("string"), F.lit("")).alias("a"), F.col("k").isNull().alias("b"), F.col("th").alias("c"), F.coalesce("owner", F.lit("")).alias("d")))
    hashed = lambda s: F.xxhash64(s["value"])
    each = named.where((F.size("base") > 0) | (F.size("generic") > 0)).select("id", "owner", "repo", F.explode(F.concat("base", "generic")).alias("s")).select("id", "owner", "repo", "s", hashed(F.col("s")).alias("value_hash"))
    stats = materialise(ownership(each.select("value_hash", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo"))))
    once = each.dropDuplicates(["id", "s"])
    # a value of very many uses meets in no task: such values are at most one in HOT_USES uses, so they are broadcast
    hot = stats.where(F.col("n_uses") > HOT_USES)
    judged = once.join(stats.where(F.col("n_uses") <= HOT_USES), "value_hash").unionByName(once.join(F.broadcast(hot), "value_hash"))
    example = (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)
    live = (F.col("s.kind") == "live") & (F.col("n_owners") == 1) & ~example
    kept = (F.col("s.kind") != "live") | live
    per = judged.where(kept).groupBy("id").agg(
        F.collect_list(F.when(live, F.col("s"))).alias("added"),
        F.sum((~example).cast("bigint")).alias("n_live"),
        F.sum(example.cast("bigint")).alias("n_example"),
    )
    out = named.join(per, "id", "left")
    none = F.array().cast(SPAN)
    return out.select(F.col("k").alias(key), F.col("th").alias("text_hash"), "n_assign", "n_access", "n_hex", F.col("base").alias("base_spans"), F.coalesce("added", none).alias("live_spans"), F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("bigint").alias("n_example"))


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The scan's rows with spans as text, and a hash of the base ones."""
    return scanned.select(key, "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base_spans", "live_spans")).alias("spans"), "n_live", "n_example")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", mark: str = "[secret]", copied_owners: int = 3) -> DataFrame:
    """``docs`` with the characters of each base and each live span replaced by ``mark``; no row goes.

    Overlapping spans become one mark. Rows without spans stay as they are, null texts too. Spans are found again by
    key and a hash of key and text, so rows that share a key but not a text keep their own. ``n_chars``, if present,
    follows the text."""
    scanned = scan(docs, key, text, owner, key, copied_owners)
    hit = scanned.where((F.size("base_spans") > 0) | (F.size("live_spans") > 0))
    cuts = F.array_sort(F.transform(F.concat("base_spans", "live_spans"), lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))))
    hit = materialise(hit.select(F.col(key).alias("__k"), F.col("text_hash").alias("__h"), cuts.alias("__s")).distinct())
    joined = docs.join(hit, docs[key].eqNullSafe(hit["__k"]) & (F.xxhash64(docs[key], docs[text]) == hit["__h"]), "left")
    t = F.coalesce(docs[text], F.lit(""))
    out = joined.withColumn("__t", F.when(F.col("__s").isNull(), docs[text]).otherwise(replaced(t, F.col("__s"), mark)))
    kinds = dict(docs.dtypes)
    changed = F.col("__s").isNotNull()
    cols = [F.col("__t").alias(c) if c == text else F.when(changed, F.length("__t").cast(kinds[c])).otherwise(docs[c]).alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    return out.select(*cols)



def _sql() -> str:
    """The digest of a scan of ``documents`` with its default parameters."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = [(0, "assign", ASSIGN, 2, 8), (1, "access", ACCESS, 0, 16), (2, "hex", HEX, 0, 32), (3, "live", GENERIC, 0, 20)]
    found = " UNION ALL ".join(
        f"SELECT doc_id, owner, {n} AS kind, '{k}' AS name, {least} AS least, generate_subscripts(regexp_extract_all(t, {quoted(p)}, 0), 1) AS pos, "
        f"unnest(string_split_regex(t, {quoted(p)})[:-2]) AS gap, unnest(regexp_extract_all(t, {quoted(p)}, 0)) AS hit, unnest(regexp_extract_all(t, {quoted(p)}, {g})) AS value FROM d"
        for n, k, p, g, least in kinds
    )
    return f"""
WITH d AS (SELECT doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
found AS ({found}),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS stop FROM found),
spans AS (
  SELECT doc_id, owner, kind, name, value, CAST(stop - length(hit) AS BIGINT) AS a, CAST(stop AS BIGINT) AS b FROM placed
  WHERE length(value) >= least AND (kind < 3 OR (regexp_matches(value, '[0-9][^0-9]*[0-9][^0-9]*[0-9]') AND regexp_matches(value, '[A-Za-z]')))),
every AS (
  SELECT * FROM spans WHERE kind < 3
  UNION ALL SELECT * FROM spans g WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = g.doc_id AND b.kind < 3 AND g.a < b.b AND b.a < g.b)),
held AS (SELECT value, count(DISTINCT coalesce(owner, chr(0))) AS owners, count(DISTINCT doc_id) AS repos FROM every GROUP BY value),
judged AS (SELECT e.*, owners >= 3 OR repos >= 12 AS example, owners FROM every e JOIN held USING (value)),
kept AS (SELECT *, name || ':' || a || ':' || b AS s FROM judged WHERE kind < 3 OR (owners = 1 AND NOT example)),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY a, kind) AS spans,
    count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN per USING (doc_id)
"""


#: Keys are those of ``documents``, one row each.
SQL = _sql()

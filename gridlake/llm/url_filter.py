"""URL filters, in DataFrame functions only: host and path rules, and a ratio of two character models for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import materialise

#: (host and path, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the models: letters, one digit, these, one for all others, begin and end. 43 at most, so there are
#: at most 43^3 = 79,507 trigrams however many URLs there are: that bounds what is broadcast.
SIGNS = "./:_?=&#%~+-@"
SYMBOLS = 26 + 1 + len(SIGNS) + 3


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for URLs without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict): the longest that fits host or one of its parents and the path's beginning; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def trigrams(url: Column) -> Column:
    """Every three symbols in a row, in time linear in the length; null and empty URLs have none."""
    text = F.translate(F.translate(url, _UPPER, _LOWER), "123456789", "000000000")
    text = F.regexp_replace(text, "[^a-z0" + SIGNS.replace("-", r"\-") + "]", "*")
    return F.when(F.length(url) > 0, F.regexp_extract_all(F.concat(F.lit("^^"), text, F.lit("$")), F.lit("(?=(...))."), F.lit(1)))


def train(urls: DataFrame, strength: float = 4.0, least: int = 8) -> DataFrame:
    """(gram, ratio): log p(c | ab) under accepted minus under rejected URLs, for each trigram that occurs anywhere.

    ``urls``: (url, label, train). Counts are of rows with ``train``; label 1 is accepted, 0 rejected. Each model
    interpolates orders 2, 1 and 0 with Dirichlet weight ``strength``; a context seen fewer than ``least`` times is
    left out for the next shorter one. A side without any training URL makes all ratios 0."""
    side = lambda v: F.sum((F.col("train") & (F.col("label") == v)).cast("bigint"))
    tri = urls.select("label", "train", F.explode(trigrams(F.col("url"))).alias("gram")).groupBy("gram").agg(F.coalesce(side(1), F.lit(0)).alias("a"), F.coalesce(side(0), F.lit(0)).alias("r"))
    tri = materialise(tri)
    part = lambda i, n: F.substring("gram", i, n)
    out = tri
    for name, key in (("pair", part(2, 2)), ("ctx2", part(1, 2)), ("one", part(3, 1)), ("ctx1", part(2, 1))):
        sums = tri.groupBy(key.alias(f"k_{name}")).agg(F.sum("a").alias(f"{name}_a"), F.sum("r").alias(f"{name}_r"))
        out = out.join(sums, key == F.col(f"k_{name}"))
    all_a, all_r = tri.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()

    def p(s: str, n: int) -> Column:
        m = F.lit(strength)
        zero = (F.col(f"one_{s}") + m / SYMBOLS) / (F.lit(float(n)) + m)
        first = F.when(F.col(f"ctx1_{s}") < least, zero).otherwise((F.col(f"pair_{s}") + m * zero) / (F.col(f"ctx1_{s}") + m))
        return F.when(F.col(f"ctx2_{s}") < least, first).otherwise((F.col(s) + m * first) / (F.col(f"ctx2_{s}") + m))

    ratio = F.log(p("a", all_a)) - F.log(p("r", all_r)) if all_a and all_r else F.lit(0.0)
    return materialise(out.select("gram", ratio.alias("ratio")))


def scores(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(url, score) for each distinct url: its mean ratio. URLs without symbols have no row."""
    each = urls.select("url").distinct().select("url", F.explode(trigrams(F.col("url"))).alias("gram"))
    return each.join(F.broadcast(model), "gram").groupBy("url").agg(F.avg("ratio").alias("score"))


def threshold(scored: DataFrame, labels: DataFrame, width: float = 1 / 64) -> float:
    """The cut between two score bins with the best balanced accuracy on labelled URLs kept out of training.

    Scores are counted in at most 2,049 bins. Ties take the least cut; without labels on either side it is 0."""
    binned = scored.join(labels, "url").select(F.least(F.greatest(F.floor(F.col("score") / width), F.lit(-1024)), F.lit(1024)).alias("bin"), "label")
    rows = binned.groupBy("bin").agg(F.sum((F.col("label") == 1).cast("bigint")).alias("a"), F.sum((F.col("label") == 0).cast("bigint")).alias("r")).orderBy("bin").collect()
    a, r = sum(x["a"] for x in rows), sum(x["r"] for x in rows)
    if not a or not r:
        return 0.0
    best, cut, below_a, below_r = 0.5, rows[0]["bin"] * width, 0, 0
    for x in rows:
        got = ((a - below_a) / a + below_r / r) / 2
        if got > best:
            best, cut = got, x["bin"] * width
        below_a, below_r = below_a + x["a"], below_r + x["r"]
    return float(cut)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, fold: int = 5) -> DataFrame:
    """(key, host, path, rule, verdict, score, cut) for every row of ``pages``.

    The rules' verdicts are the labels that the two models learn from; one URL in ``fold`` (by crc32) is kept out
    for the cut. URLs that no rule fits are allowed if their score reaches the cut. Null URLs have empty host and
    path, no rule, score 0. Equal URLs are scored once and repeated rows all stay; other columns aren't read."""
    src = pages.select(pages[key].alias("k"), pages[url].alias("url"))
    host, path = host_path(F.col("url"))
    known = src.select("k", "url", host.alias("host"), path.alias("path"))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    known = known.withColumns({"rule": name, "says": says})
    label = F.when(F.col("says") == "allow", 1).when(F.col("says") == "block", 0)
    held = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(fold)) == 0
    urls = known.where(F.length("url") > 0).select("url", label.alias("label")).distinct()
    model = train(urls.withColumn("train", F.col("label").isNotNull() & ~held))
    scored = scores(urls, model)
    scored = materialise(scored)
    cut = threshold(scored, urls.where(F.col("label").isNotNull() & held))
    out = known.join(scored.select(F.col("url").alias("u"), "score"), F.col("url") == F.col("u"), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("says", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return out.select(F.col("k").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(cut).alias("cut"))

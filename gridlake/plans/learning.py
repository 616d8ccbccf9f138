"""Queries over models. SQL can't express their rows; tests compare them with numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import learn, samples, sampling
from gridlake.sources import tables as t

QUERIES, ORACLE = {}, {}
BANDS = list(t.BANDS[:6])


def _data(spark, sf_dir):
    return t.reflectances(spark, sf_dir).select("vec_id", F.col("label").cast("double").alias("label"), *BANDS)


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _model(code):
    def run(spark, sf_dir):
        parts = sampling.split(_data(spark, sf_dir), "vec_id", "label", 0.5)
        m = learn.estimator(code, "label", BANDS).fit(parts.where("part = 'train'"))
        return learn.predict(m, parts.where("part = 'test'"), BANDS).select("vec_id", "label", "prediction")

    return run


for _code in ("rf", "dt", "bayes", "logistic"):
    QUERIES[f"classify_{_code}"] = _model(_code)


@query()
def principal_components(spark, sf_dir):
    return learn.components(_data(spark, sf_dir), BANDS, 3).select("vec_id", *(F.col("pca")[i].alias(f"c{i + 1}") for i in range(3)))


@query()
def remove_outliers(spark, sf_dir):
    return learn.without_outliers(_data(spark, sf_dir), "vec_id", "label", BANDS[:3]).select("vec_id", "label")


@query("WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE + 1) / 2) AS b FROM embeddings), p AS (SELECT vec_id, [(b[k] + 2 * b[k + 3]) / 3 for k in range(1, 4)] AS p FROM b) SELECT vec_id, (list_position(p, list_max(p)) - 1)::DOUBLE AS vote, round(list_max(p), 6) AS share FROM p")
def vote(spark, sf_dir):
    a, b = F.slice("bands", 1, 3), F.slice("bands", 4, 3)
    c, p = learn.voted([a, b], [1.0, 2.0])
    return t.reflectances(spark, sf_dir).select("vec_id", c.alias("vote"), F.round(p, 6).alias("share"))


_ORDER = "('0x' || md5('1:' || event_id)[1:15])::BIGINT, event_id"


@query(
    "WITH e AS (SELECT event_id, user_id % 20 AS clear, list_position(['click','error','purchase','signup','view'], event_type) AS c FROM events), "
    "k AS (SELECT event_id, CASE WHEN c = 1 THEN 10 WHEN c = 2 THEN 1 ELSE c END::INT AS response FROM e WHERE c <> 3 AND clear >= 5) "
    f"SELECT event_id, response, CASE WHEN row_number() OVER (PARTITION BY response ORDER BY {_ORDER}) <= floor(count(*) OVER (PARTITION BY response) * 0.4) THEN 'train' ELSE 'test' END AS part FROM k"
)
def split_samples(spark, sf_dir):
    """Samples without one class and without rows of few observations, recoded and split by class."""
    e = t.event_grid(spark, sf_dir).select((F.col("i") * 100 + F.col("j")).alias("event_id"), F.col("j").alias("X"), F.col("i").alias("Y"), F.col("value").alias("f1"), F.col("class").alias("response"))
    e = e.join(t.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("clear")), "event_id")
    got = samples.split_samples(e, key="event_id", clear="clear", least=5, remove=[3], recode={1: 10, 2: 1}, share_each=0.4)
    return got.train.withColumn("part", F.lit("train")).unionByName(got.test.withColumn("part", F.lit("test"))).select("event_id", "response", "part")


@query()
def robust_outliers(spark, sf_dir):
    return learn.without_outliers(_data(spark, sf_dir), "vec_id", "label", BANDS[:3], robust=True).select("vec_id", "label")


@query()
def calibrated_bayes(spark, sf_dir):
    parts = sampling.split(_data(spark, sf_dir), "vec_id", "label", 0.5)
    m = learn.calibrated(parts.where("part = 'train'"), "vec_id", "label", BANDS, "bayes", "sigmoid")
    return m.transform(parts.where("part = 'test'")).select("vec_id", "label", "prediction", F.array_max("probability").alias("share"))


@query()
def label_propagation(spark, sf_dir):
    """The labels of one vector in five spread to the others."""
    d = _data(spark, sf_dir).withColumn("label", F.when(F.col("vec_id") % 5 == 0, F.col("label")).otherwise(-1.0))
    return learn.propagated(d, "vec_id", "label", BANDS, rounds=10)


@query("SELECT p_partkey, p_type AS response, (p_size + p_partkey % 30)::DOUBLE AS f1, p_retailprice + p_partkey % 40 AS f2 FROM part WHERE (pow(p_partkey % 30, 2) < 300)::INT + (pow(p_partkey % 40, 2) < 300)::INT >= 2")
def compare_samples(spark, sf_dir):
    """Samples whose two features have changed little."""
    p = t.table(spark, sf_dir, "part")
    base = p.select("p_partkey", F.col("p_type").alias("response"), F.col("p_size").cast("double").alias("f1"), F.col("p_retailprice").alias("f2"))
    later = base.withColumns({"f1": F.col("f1") + F.col("p_partkey") % 30, "f2": F.col("f2") + F.col("p_partkey") % 40})
    return samples.compared(base, later, "p_partkey", ["f1", "f2"], distance=300.0, share=1.0)

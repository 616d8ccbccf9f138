import __spark_entry__
import corpus_pipeline
from gridlake.llm import secrets, toxicity
from tests.llm.common import SF
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_secrets import base


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_copies", "decontamination", "secrets", "mixing"]
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    clean = stages["toxicity"](spark, docs, SF).cache()
    flagged = {r.doc_id for r in toxicity.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.flagged}
    before = rows(docs)
    assert rows(clean) == {d: t for d, t in before.items() if d not in flagged}

    one = stages["near_copies"](spark, clean, SF).cache()
    groups = near(list(rows(clean).items()))
    assert set(rows(one)) == {d for d, (_, c) in groups.items() if c == d}

    safe = stages["decontamination"](spark, one, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(rows(safe)) == set(rows(one)) - {x[0] for x in leaks(list(rows(one).items()), items)}

    hidden = stages["secrets"](spark, safe, SF).cache()
    assert set(rows(hidden)) == set(rows(safe))
    live = {r.doc_id: r.live_spans for r in secrets.scan(safe).collect()}
    texts = rows(hidden)
    for d, t in rows(safe).items():
        cuts, at, want = sorted((a, e) for a, _, e, _ in base(t)) + [(s["start"], s["end"]) for s in live[d]], 0, ""
        for a, e in sorted(cuts):
            if a >= at:
                want += t[at:a] + "[secret]"
            at = max(at, e)
        assert texts[d] == want + t[at:]
    for df in (clean, one, safe, hidden):
        assert df.columns == docs.columns
    assert {r.doc_id for r in stages["mixing"](spark, hidden, SF).collect()} == set(rows(hidden))


def test_registered(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)

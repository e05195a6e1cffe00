"""The pipeline against the same stages by brute force on sf0.001."""

from pyspark.sql import functions as F

import corpus_pipeline
from cinelytics.llm import toxicity

from ..conftest import SF_SMALL
from .test_llm_operators import brute_components, brute_decontam, check_pieces


def brute_line_texts(rows):
    import collections

    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for d, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    return [(d, "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == d)) for d, t in rows]


def test_pipeline_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    rows = [(d, t) for d, t in rows if model.score(toxicity.term_hashes(t)) < 0.5]
    rows = brute_line_texts(rows)
    first = {d for d, _, c in brute_components(rows) if d == c}
    rows = [(d, t) for d, t in rows if d in first]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(d, t) for d, t in rows if not brute_decontam(t, items)[1]]
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in rows}
    assert check_pieces(got, dict(rows)) == 0


def test_stages_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "en"), (None, "x", None), (2, "", "de"), (2, "", "de")], "doc_id long, text string, score string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_SMALL).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontaminate", "packing"]

"""Registered queries and the pipeline on the smallest supplied tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import difference
from matchlab.llm.queries import QUERIES, TWINS, VOCABULARY
from matchlab.llm.tokens import Encoder
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, name):
    assert difference(QUERIES[name](spark, SF), TWINS[name], SF) == ""


def test_planted_passages(spark):
    docs = {r.doc_id: brute.words(r.text, lower=True) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: brute.words(r.text, lower=True) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {
        (d, i) for d, w in docs.items() for i, x in items.items()
        if any(w[k : k + len(x)] == x for k in range(len(w) - len(x) + 1))
    }
    assert whole <= {(r.doc_id, r.item_id) for r in QUERIES["op1_decontaminate"](spark, SF).collect()}


def test_pipeline(spark):
    """Stage by stage against what plain Python says of the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        kept[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = kept["quality rules"]
    judged = QUERIES["op7_quality"](spark, SF)
    assert ids(after) == ids(judged.where("kept"))
    before, after = kept["near duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == {i for i, (_, c) in brute.near(rows).items() if i == c}
    before, after = kept["decontamination"]
    assert ids(after) < ids(before)
    before, after = kept["secret scans"]
    assert ids(after) == ids(before) and after.where(F.col("text").rlike("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")).count() == 0
    before, after = kept["packing"]
    encode = Encoder(VOCABULARY).tokenizer.encode
    want = {r.doc_id: len(encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}
    got = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want
    # Where documents are cut depends on who is packed with whom; whose ids are packed does not.
    whole = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in whole} == want

"""The registered queries against their SQL, and the pipeline against plain Python."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import connect, differences, plan
from tests.llm import brute
from tidewater.llm import catalogue, toxicity
from tidewater.llm.common import held_out


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, sf, name):
    assert differences(catalogue.queries()[name](spark, sf), connect(sf), catalogue.oracle_sql()[name]) == []


def test_every_operator_has_its_query():
    assert sorted(catalogue.queries()) == sorted(
        ["pipeline", *(n for n in catalogue.queries() if n.startswith("op"))]) and len(catalogue.queries()) == 14


@pytest.mark.parametrize("name", ["op2_mixing", "op5_decontamination"])
def test_native_operators_run_no_python(spark, sf, name):
    text = plan(catalogue.queries()[name](spark, sf))
    assert not any(word in text for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_pipeline_matches_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"), usable=~held_out(F.col("doc_id")))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    rows = [r for r in rows if model.score(r[1])[0] < 0.5]
    kept = {doc_id: text for doc_id, _, _, text in brute.line_dedup([r[:2] for r in rows])}
    rows = [(doc_id, kept[doc_id], source) for doc_id, _, source in rows]
    component = brute.near_duplicates([r[:2] for r in rows], 5, 80)
    rows = [r for r in rows if component[r[0]] == r[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {doc_id for doc_id, *_ in brute.contaminated([r[:2] for r in rows], items)}
    rows = [r for r in rows if r[0] not in leaks]
    got = corpus_pipeline.run(spark, sf).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert leaks and sorted((*r[:3], round(r[3], 6), r[4]) for r in map(tuple, got)) == sorted(
        (*r[:3], round(r[3], 6), r[4]) for r in brute.mix(rows))

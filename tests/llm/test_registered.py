"""The registered queries: SQL where there is some, shapes elsewhere; and the pipeline."""

import os
import sys
from types import SimpleNamespace

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from panelcast.llm import queries as q  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in q.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, name):
    import oracle_check
    status, said = oracle_check.compare(spark, oracle_check.duck(SF), name, SimpleNamespace(build=q.QUERIES[name], sql=q.ORACLES[name]), SF)
    assert status == "OK", said


def test_pipeline_against_its_operators_one_by_one(spark):
    """Each stage's decisions, brute-forced from the rows that went in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    rows, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.dtypes == docs.dtypes
        seen[name] = {r.doc_id: r.text for r in out.collect()}
        rows = spark.createDataFrame(out.collect(), docs.schema)
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert len(good & set(seen["quality"])) >= 0.98 * len(good) and len(bad & set(seen["quality"])) <= 0.1 * len(bad) + 1
    texts = list(seen["near_duplicates"].values())
    assert len(set(texts)) == len(texts)
    assert set(seen["repeated_passages"]) == set(seen["near_duplicates"])
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    for text in seen["decontamination"].values():
        assert not any(i in " ".join((text or "").lower().split()) for i in items)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(seen["decontamination"])

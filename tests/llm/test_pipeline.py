import os

import pytest

import corpus_pipeline as cp
from clade.llm import jaccard, mixing, pieces, quality, substring

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = [docs]
    for _, stage in cp.STAGES:
        seen.append(cp.stored(stage(spark, seen[-1], DIR), "stage"))
    assert all(d.columns == docs.columns for d in seen[1:-1])
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    good = {r.doc_id for r in quality.scored(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in seen[1].collect()} == good
    comp = {r.component_id for r in jaccard.near_duplicates(seen[1], 5, 80).collect()}
    assert {r.doc_id for r in seen[2].collect()} == comp
    assert seen[3].count() == seen[2].count() and substring.repeated_passages(seen[3]).count() == 0
    copies = {r.doc_id: r.copies for r in mixing.mixed(seen[3]).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in seen[4].groupBy("doc_id").count().collect()} == copies
    assert seen[5].count() == seen[4].count()
    one = seen[4].select("doc_id", "text").first()
    with open(pieces.default_model(), "rb") as f:
        ids = pieces.ChunkTable(f.read()).processor.encode(one.text or "")
    assert list(seen[5].where(f"doc_id = {one.doc_id}").first().ids) == ids


def test_an_empty_table_goes_through(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, DIR), "stage")
    assert docs.count() == 0

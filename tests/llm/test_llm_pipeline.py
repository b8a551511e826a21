"""The pipeline: each stage on what the one before it kept."""

from __future__ import annotations

import weakref

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressroom.llm import common
from pressroom.llm.common import settle

NAMES = [name for name, _ in corpus_pipeline.STAGES]


def test_stages_on_the_small_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit(1)).withColumn("result", F.lit("x"))
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, folder), name)
        sizes.append(docs.count())
        if name != NAMES[-1]:
            assert docs.columns == columns
            assert docs.select("doc_id").distinct().count() == docs.count()
        if name == "personal_data":
            assert docs.where("text RLIKE '@mail[0-9]'").count() == 0 and docs.where("n_chars <> length(text)").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert docs.where("not round_trip").count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, tmp_path, name, stage):
    item = " ".join(f"word{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = "a quiet text about nothing in particular that stays as it is"
    rows = [(1, clean), (2, clean), (2, clean), (3, None), (4, ""), (None, clean), (5, "idiot moron"), (6, f"x {item} y"), (7, "mail a@b.co")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS features", "2 AS spans_found")
    kept = stage(spark, docs, str(tmp_path))
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").select("doc_id").collect())
    want = {
        "toxicity": [1, 2, 2, 3, 4, 6, 7], "minhash_near_dedup": [1, 3, 4, 5, 6, 7], "benchmark_decontamination": [1, 2, 2, 3, 4, 5, 7],
    }
    assert ids == want.get(name, [1, 2, 2, 3, 4, 5, 6, 7])
    assert kept.where("doc_id is null").count() == 1
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if name == "personal_data":
        assert kept.where("doc_id = 7").first().text == "mail <EMAIL>"


class _Values(list):
    """A list that a weak reference can point to."""


def test_a_slice_is_let_go_before_the_next():
    """Texts of 12 MB in one batch pass in slices of 4 MB at most, and a kernel never runs beside its last result."""
    batch = pa.record_batch([pa.array(range(12)), pa.array(["x" * (1 << 20)] * 12)], ["doc_id", "text"])
    kind, seen = pa.struct([("n", pa.int64())]), []

    def kernel(texts):
        assert not [1 for _, last in seen if last() is not None]
        values = _Values(map(len, texts.to_pylist()))
        seen.append((texts.nbytes, weakref.ref(values)))
        return {"n": values}

    rows = []
    for part in common._attached(iter([batch]), kernel, 1, ["doc_id", "found"], kind, common.SLICE_BYTES):
        rows += part.to_pylist()
    assert rows == [{"doc_id": i, "found": {"n": 1 << 20}} for i in range(12)]
    assert len(seen) == 3 and max(size for size, _ in seen) < (4 << 20) + 100


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_read_small_batches(spark, name, stage):
    """A session built elsewhere has batches of 10,000 rows, which both sides of a worker's socket hold."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "10000")
    try:
        stage(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0), "/root/testdata/sf0.001")
        assert spark.conf.get(setting) == "1000"
    finally:
        spark.conf.set(setting, before)

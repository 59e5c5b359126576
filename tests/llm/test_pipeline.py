"""The pipeline's stages keep the columns of documents, and their decisions take effect."""

import os

import corpus_pipeline
from pyspark.sql import functions as F
from themeloom.llm import common, decontaminate, near_dedup
from themeloom.session import end_stages, materialise, scratch_folder


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, folder), f"test-{name}", staged=False)
        if name == "sharding":
            assert docs.columns == [*columns, "shard", "slot"] and docs.count() == before.count()
            continue
        assert docs.columns == columns
        if name == "near_dedup":
            classes = near_dedup.near_classes(before)
            assert docs.count() == classes.select("class_id").distinct().count()
        if name == "decontamination":
            found = decontaminate.find_leaks(before, spark.read.parquet(f"{folder}/benchmark.parquet"))
            assert docs.count() == before.count() - found.select("doc_id").distinct().count()
        if name == "mixing":
            assert docs.groupBy("doc_id").count().filter("count > 2").count() == 0
    end_stages(spark)


def test_run_leaves_only_its_result(spark, folder):
    before = set(os.listdir(scratch_folder(spark)))
    rows = corpus_pipeline.run(spark, folder)
    left = set(os.listdir(scratch_folder(spark))) - before
    assert rows.count() > 0 and [name.rpartition("-")[0].split("-")[0] for name in left] == ["pipeline"]
    assert len(rows.inputFiles()) > 0 and all(left.copy().pop() in f for f in rows.inputFiles())


def test_row_ids(spark, tmp_path):
    """Of a stored table its own places, the same for every reading; of others numbers that are stored."""
    frame = spark.range(1000).repartition(3).withColumn("_file", F.lit("x")).withColumn("text", F.lit(None).cast("string"))
    frame.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for docs in (stored, stored.limit(500), stored.limit(0), frame.selectExpr("*", "1 as _metadata")):
        ids = common.with_row_ids(docs, "rid")
        assert ids.columns == [*docs.columns, "rid"]
        rows = {r["rid"]: r["id"] for r in ids.select("id", "rid").collect()}
        assert len(rows) == docs.count() == len(set(rows.values()))
        assert {r["rid"]: r["id"] for r in ids.filter("id % 2 = 0").select("rid", "id").collect()} == {a: b for a, b in rows.items() if b % 2 == 0}

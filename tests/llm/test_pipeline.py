"""Each stage against what its operator says, and the pipeline as a whole."""

from __future__ import annotations

import corpus_pipeline as P
from pyspark.sql import functions as F

from spindle.llm.decontaminate import contamination
from spindle.llm.near_dedup import near_duplicates
from spindle.llm.toxicity import classify, score, train


def test_stages(spark, sf, tmp_path):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        if name == "token_output":
            assert out.count() == docs.count()
            break
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        ids = lambda d: {r.doc_id for r in d.collect()}
        if name == "toxicity":
            assert ids(docs) - ids(after) == ids(classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1"))
        elif name == "near_dedup":
            assert ids(after) == ids(near_duplicates(docs).where("kept"))
        elif name == "decontamination":
            assert ids(docs) - ids(after) == ids(contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated"))
        docs = after


def test_run_gives_rows(spark, sf):
    assert P.run(spark, sf).agg(F.sum("n_tokens")).first()[0] > 0


def test_empty_and_odd_input(spark, sf):
    odd = spark.createDataFrame([(1, None, None, None, 0), (2, "", "en", "a", 0), (None, "some words", "en", "a", 10)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in P.STAGES:
            stage(spark, docs, sf).collect()


def test_rows_without_ids_and_of_one_id(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = F.when(F.col("doc_id") % 3 == 1, F.lit(None)).when(F.col("doc_id") % 3 == 2, F.lit(7)).otherwise(F.col("doc_id"))
    plain, odd = docs, docs.withColumn("doc_id", ids.cast(docs.schema["doc_id"].dataType))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in P.STAGES[:3]:
        if name == "toxicity":
            gone = {r.doc_id for r in score(docs.select("doc_id", "text"), train(odd, labels)).where("predicted = 1").collect()}
            want = [r.text for r in docs.collect() if r.doc_id not in gone]
        else:
            want = [r.text for r in stage(spark, plain, sf).collect()]
        got = [r.text for r in stage(spark, odd, sf).collect()]
        assert len(got) == len(want) < docs.count() or name == "toxicity" and len(got) == len(want)
        if name != "near_dedup":  # there, another copy may stay
            assert sorted(map(str, got)) == sorted(map(str, want))
    P.mixing(spark, odd, sf).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    size = lambda d: d.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(size(mixed) - size(docs)) < 0.01 * size(docs)
    out = P.token_ids(spark, mixed, sf)
    assert out.count() == mixed.count() and out.where("doc_id is null").count() == mixed.where("doc_id is null").count() > 0


def test_columns_of_any_name_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("row", "at", "passes", "spans", "_row", "_pass", "piece", "key", "taken", "a.b"):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}:"), F.col("doc_id").cast("string")))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.where("`a.b` <> concat('a.b:', doc_id) or passes <> concat('passes:', doc_id) or at <> concat('at:', doc_id) or _row <> concat('_row:', doc_id)").count() == 0 < out.count()

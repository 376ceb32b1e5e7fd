"""From raw documents to token shards: five stages, each an operator of spindle.llm."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import anti_join, checkpointed, shared_folder, table
from spindle.llm.decontaminate import contamination
from spindle.llm.mixing import mix_documents
from spindle.llm.near_dedup import near_duplicates
from spindle.llm.token_output import token_output
from spindle.llm.toxicity import score, train


def _keyed(docs: DataFrame) -> DataFrame:
    """row, a struct of the columns of docs, and at, a number of its own for each row, written once, so that retries agree."""
    return checkpointed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")))


def _by_row(keyed: DataFrame) -> DataFrame:
    """What operators judge, with the row's number for doc_id: rows with no doc_id or with one doc_id are judged each."""
    return keyed.select(F.col("at").alias("doc_id"), "row.text")


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The columns of the rows of keyed whose numbers aren't the doc_ids of gone."""
    return anti_join(keyed, gone.select(F.col("doc_id").alias("at")), "at").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes as toxic go."""
    keyed = _keyed(docs)
    return _without(keyed, score(_by_row(keyed), train(keyed.select("row.doc_id", "row.text"), table(spark, sf_dir, "labels"))).where("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by five words and a similarity of 0.8, one row of the smallest doc_id stays."""
    keyed = _keyed(docs)
    judged = near_duplicates(_by_row(keyed)).select(F.col("doc_id").alias("at"), "component_id")
    copies = checkpointed(judged.join(judged.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1"), "component_id"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "at")
    first = copies.join(keyed.select("at", "row.doc_id"), "at").groupBy("component_id").agg(F.min(place).alias("first"))
    return _without(keyed, anti_join(copies, first.select("first.at"), "at").select(F.col("at").alias("doc_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    keyed = _keyed(docs)
    return _without(keyed, contamination(_by_row(keyed), table(spark, sf_dir, "benchmark")).where("contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: repeated, in part, or not at all."""
    return mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, and what reading them back gives for each document; rows without doc_id come last."""
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_ids)]

#: Classifier, components and token ids are beyond SQL; each stage is tested against what its operator says, and operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again by the next."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

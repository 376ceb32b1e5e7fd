"""Keyed tables: latest rows, snapshots, incremental differences."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by order, which must end in something unique."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def index_actions(new: DataFrame, prior: DataFrame) -> DataFrame:
    """chunk_id and action of every chunk of either side: skipped, inserted, updated or deleted.

    new, prior: (chunk_id, hash, version). Of several new rows with one id any may decide, so ids
    should be distinct. One shuffle, on the id.
    """
    a = new.select("chunk_id", F.col("hash").alias("new_hash"), F.col("version").alias("new_version"), F.lit(True).alias("in_new"))
    b = prior.select("chunk_id", "hash", "version", F.lit(True).alias("in_prior"))
    action = F.when(F.col("in_new").isNull(), "deleted").when(F.col("in_prior").isNull(), "inserted").when((F.col("hash") == F.col("new_hash")) & (F.col("version") == F.col("new_version")), "skipped").otherwise("updated")
    return a.join(b, "chunk_id", "full_outer").select("chunk_id", action.alias("action"))


def upserted(prior: DataFrame, changed: DataFrame, removed: DataFrame, key: str = "chunk_id") -> DataFrame:
    """prior without the removed and changed keys, and changed. Written elsewhere it is the next snapshot."""
    gone = changed.select(key).union(removed.select(key)).distinct()
    return prior.join(gone, key, "left_anti").unionByName(changed)


def write_snapshot(table: DataFrame, root: str) -> str:
    """Writes table to a new folder below root, never over one that may be being read, and returns its path."""
    path = f"{root}/snapshot-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return path

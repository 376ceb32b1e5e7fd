"""Approximate nearest vectors: a stored index of inverted lists, probed in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query rows that are gathered and broadcast at once, about; more of them are searched in blocks.
QUERY_BLOCK = 1000
#: Vectors that centroids are fitted on, at most; all vectors are indexed.
SAMPLE = 20_000
ROUNDS = 12


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows; those that are null, of another size or without finite values are zeros."""
    out = np.zeros((len(column), size))
    lengths = np.asarray(pc.list_value_length(column).fill_null(-1))
    fit = np.flatnonzero(lengths == size)
    if len(fit) and size:
        own = column.take(pa.array(fit)).flatten().cast(pa.float64()).fill_null(np.nan)
        rows = np.asarray(own).reshape(len(fit), size)
        out[fit] = np.where(np.isfinite(rows).all(axis=1, keepdims=True), rows, 0.0)
    return out


def centroids(rows: DataFrame, lists: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors that stand for lists, by spherical k-means over at most sample vectors (vec_id, embedding), chosen by the hash of their id."""
    fit = rows.where("size(embedding) > 0").select("embedding", F.xxhash64("vec_id").alias("h"))
    own = [r.embedding for r in fit.orderBy("h", "embedding").limit(sample).select("embedding").collect()]
    if not own:
        return np.zeros((1, 0))
    size = max({len(x) for x in own}, key=[len(x) for x in own].count)
    held = _unit(np.array([x for x in own if len(x) == size and None not in x], dtype=np.float64).reshape(-1, size))
    at = held[np.linspace(0, len(held) - 1, min(lists, len(held))).astype(int)]
    for _ in range(ROUNDS):
        near = np.argmax(held @ at.T, axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, held)
        at = np.where(np.bincount(near, minlength=len(at))[:, None] > 0, _unit(sums), at)
    return at


def build_index(rows: DataFrame, path: str, *, lists: int = 32, sample: int = SAMPLE) -> None:
    """Writes an index of rows (vec_id, embedding) below path: centroids, and every row in the folder of its nearest one's list.

    Vectors that are null, empty or of another size than most go to list 0; they are found with score 0.
    """
    spark, at = rows.sparkSession, centroids(rows, lists, sample)
    shared = spark.sparkContext.broadcast(at)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value
        for batch in batches:
            vectors = _matrix(batch["embedding"], near.shape[1])
            best = np.argmax(vectors @ near.T, axis=1) if near.shape[1] else np.zeros(len(vectors), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32))], [*batch.schema.names, "list"])

    schema = rows.select("vec_id", "embedding").schema
    listed = rows.select("vec_id", "embedding").mapInArrow(assign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", list int")
    listed.write.mode("errorifexists").partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(at)], "list int, centroid array<double>").coalesce(1).write.mode("errorifexists").parquet(f"{path}/centroids")


def _best(k: int, shared):
    """The k nearest rows of a task for each query that probes their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, probes = shared.value
        kept = [(np.zeros(0), np.zeros(0, np.int64))] * len(asked)
        for batch in batches:
            vectors, ids, lists = _unit(_matrix(batch["embedding"], asked.shape[1])), np.asarray(batch["vec_id"]), np.asarray(batch["list"])
            for own in np.unique(lists).tolist():
                at, wanted = np.flatnonzero(lists == own), probes.get(own, [])
                scores = np.clip(asked[wanted] @ vectors[at].T, 0.0, 1.0)
                for q, row in zip(wanted, scores, strict=True):
                    s, i = np.concatenate([kept[q][0], row]), np.concatenate([kept[q][1], ids[at]])
                    order = np.lexsort((i, -s))[:k]
                    kept[q] = s[order], i[order]
        place = np.concatenate([np.full(len(s), q) for q, (s, _) in enumerate(kept)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.concatenate([i for _, i in kept])), pa.array(np.concatenate([s for s, _ in kept]))], ["place", "vec_id", "score"])

    return run


def probe(spark: SparkSession, path: str, queries: DataFrame, k: int, *, probes: int = 8, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, score and rank of the k nearest rows among the lists of each query's probes nearest centroids.

    queries: (query_id, query), one row each. About block of them are gathered and broadcast at a time; a block
    reads the folders of its lists alone, and each task keeps its k best of a query before the one
    shuffle. Scores are exact cosines; equal ones go by vec_id. With as many probes as lists, results are exact.
    """
    at = np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])  # as many rows as lists
    rows = spark.read.parquet(f"{path}/lists")
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "query").toArrow()
        asked = _unit(_matrix(own["query"].combine_chunks(), at.shape[1]))
        near = np.argsort(-(asked @ at.T), axis=1, kind="stable")[:, : max(1, probes)]
        wanted: dict[int, list[int]] = {}
        for q, lists in enumerate(near.tolist()):
            for x in lists:
                wanted.setdefault(x, []).append(q)
        shared = spark.sparkContext.broadcast((asked, wanted))
        found = rows.where(F.col("list").isin(sorted(wanted))).mapInArrow(_best(max(1, k), shared), "place long, vec_id long, score double")
        names = spark.createDataFrame(list(enumerate(own["query_id"].to_pylist())), f"place long, query_id {queries.schema['query_id'].dataType.simpleString()}")
        found = found.join(F.broadcast(names), "place").drop("place")  # a row a query of the block
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= max(1, k)).select("query_id", "vec_id", "score", "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's pairs (query_id, vec_id) that found has."""
    both = exact.join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]

"""Stored collections: keyed rows in versions below a folder, written once for each token.

A commit writes all rows of the new version to a folder of its own and then one row to the manifest,
which readers start from. A token that the manifest has is not written again, so a retried batch or
stream epoch changes nothing. One writer a collection at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.operators.storage import index_actions
from spindle.operators.vectors import predicate

PREFIX = "repo_"
FETCHED = 500  #: rows of a fetch, if not told otherwise
_MANIFEST = "version long, token string, folder string, n_rows long"
_DEPENDENCY = "array<struct<name:string,module:string,is_external:boolean>>"


def collection_path(root: str, repository_id: str, prefix: str = PREFIX) -> str:
    """The folder of a repository's own collection."""
    return f"{root.rstrip('/')}/{prefix}{repository_id}"


def embedding_text(path: Column, symbol: Column, kind: Column, content: Column) -> Column:
    """What an embedder gets for a chunk: a line that says where it is, then its content if it has any."""
    head = F.concat(path, F.lit(" :: "), symbol, F.lit(" ("), kind, F.lit(")"))
    return F.when(F.coalesce(content, F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\n"), content))


def stored_rows(chunks: DataFrame, used: DataFrame, version: str) -> DataFrame:
    """chunks (of symbol_chunks) as a collection keeps them: metadata, document and its text for an embedder.

    used: (chunk_id, name, module, is_external) of the imported names that chunks use. dependencies is
    compact JSON in order of name and module; dependency_modules their sorted distinct modules. Chunks without
    any have an empty list.
    """
    entry = F.struct("name", "module", "is_external")
    own = used.distinct().groupBy("chunk_id").agg(F.array_sort(F.collect_list(entry)).alias("deps"))
    out = chunks.join(own, "chunk_id", "left").withColumn("deps", F.coalesce("deps", F.array().cast(_DEPENDENCY)))
    modules = F.array_join(F.array_sort(F.array_distinct(F.transform("deps", lambda d: d["module"]))), ",")
    return out.select(
        "repository", "chunk_id", F.col("kind").alias("chunk_type"), "symbol", F.coalesce("parent", F.lit("")).alias("parent_symbol"), "language", "path", "start_line", "end_line", "visibility",
        F.to_json("deps").alias("dependencies"), modules.alias("dependency_modules"), "hash", F.lit(version).alias("version"), F.col("content").alias("document"),
        embedding_text(F.col("path"), F.col("symbol"), F.col("kind"), F.col("content")).alias("embedding_text"),
    )


def decoded_dependencies(text: Column) -> Column:
    """The entries of a JSON list that are objects with a name; none for text that is no such list. Missing members are '' and false."""
    entries = F.filter(F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & F.trim(x).startswith("{"))
    told = F.transform(entries, lambda x: F.from_json(x, "name string, module string, is_external boolean"))
    named = F.filter(told, lambda d: F.coalesce(d["name"], F.lit("")) != "")
    return F.transform(named, lambda d: F.struct(d["name"].alias("name"), F.coalesce(d["module"], F.lit("")).alias("module"), F.coalesce(d["is_external"], F.lit(False)).alias("is_external")))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, token, folder and n_rows of the commits of a collection; none if there is no collection."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], _MANIFEST)


def _last(spark: SparkSession, path: str):
    return versions(spark, path).orderBy(F.desc("version")).limit(1).first()


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """Rows of the last version, or of the one told; None if there is none."""
    known = versions(spark, path)
    row = (known if version is None else known.where(F.col("version") == version)).orderBy(F.desc("version")).limit(1).first()
    return None if row is None else spark.read.parquet(row.folder)


def commit(spark: SparkSession, path: str, token: str, make: Callable[[DataFrame | None], DataFrame]) -> int:
    """Makes the next version of what make returns for the current rows, and returns its number; for a known token, that one's."""
    known = versions(spark, path).where(F.col("token") == token).limit(1).first()
    if known is not None:
        return known.version
    last = _last(spark, path)
    folder = f"{path}/data/{uuid.uuid4().hex}"
    make(None if last is None else spark.read.parquet(last.folder)).write.parquet(folder)
    number = 1 if last is None else last.version + 1
    entry = spark.createDataFrame([(number, token, folder, spark.read.parquet(folder).count())], _MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return number


def _one_each(rows: DataFrame, keys: list[str], order: list[Column] | None) -> DataFrame:
    """The last row of each key by order, else any one of them."""
    if order is None:
        return rows.dropDuplicates(keys)
    names = [c for c in rows.columns if c not in keys]
    ranked = rows.select(F.struct(*rows.columns).alias("row"), F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])).alias("place"))
    return ranked.where("place = 1").select(*[F.col("row")[c].alias(c) for c in [*keys, *names]]).select(*rows.columns)


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], token: str, order: list[Column] | None = None) -> int:
    """Rows take the place of those with their keys, others stay; of rows with one key the last by order counts. Null keys are keys too."""
    own = _one_each(rows, keys, order)

    def make(held: DataFrame | None) -> DataFrame:
        if held is None:
            return own
        new = own.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)])
        same = [held[k].eqNullSafe(new[f"key{i}"]) for i, k in enumerate(keys)]
        return held.join(new, same, "left_anti").unionByName(own)

    return commit(spark, path, token, make)


def append(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], token: str) -> int:
    """Adds rows whose keys aren't there yet; those that are stay as they are."""
    own = _one_each(rows, keys, None)

    def make(held: DataFrame | None) -> DataFrame:
        if held is None:
            return own
        there = held.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)])
        return held.unionByName(own.join(there, [own[k].eqNullSafe(there[f"key{i}"]) for i, k in enumerate(keys)], "left_anti"))

    return commit(spark, path, token, make)


def delete(spark: SparkSession, path: str, where: Column, token: str) -> int:
    """Removes the rows that where holds for; those for which it is null stay."""
    return commit(spark, path, token, lambda held: held.where(~F.coalesce(where, F.lit(False))) if held is not None else spark.range(0))


def stream_into(rows: DataFrame, path: str, keys: list[str], name: str, checkpoint: str):
    """A started stream that upserts each micro-batch of rows; an epoch that is run again writes nothing new."""
    return rows.writeStream.foreachBatch(lambda batch, epoch: upsert(batch.sparkSession, path, batch, keys, f"{name}-{epoch}") and None).option("checkpointLocation", checkpoint).start()


def count(spark: SparkSession, path: str) -> int:
    """Rows of the last version, from the manifest alone."""
    last = _last(spark, path)
    return 0 if last is None else last.n_rows


def fetch(spark: SparkSession, path: str, clause: dict | None = None, limit: int = FETCHED) -> DataFrame:
    """At most limit rows that a clause holds for, in order of chunk_id, with score 0.0 and no vector.

    The predicate and the columns reach the scan of the stored files.
    """
    rows = current(spark, path)
    if rows is None:
        return spark.createDataFrame([], "chunk_id string, score double")
    kept = rows.where(predicate(clause, dict(rows.dtypes))).drop("embedding", "embedding_text")
    return kept.orderBy("chunk_id").limit(limit).withColumn("score", F.lit(0.0))


def differences(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """What the next version would do to each chunk of new (chunk_id, hash, version) or of the stored index."""
    held = current(spark, path)
    prior = new.limit(0) if held is None else held
    return index_actions(new, prior.select("chunk_id", "hash", "version"))


def index_chunks(spark: SparkSession, path: str, rows: DataFrame, token: str) -> DataFrame:
    """Brings a collection to rows (of stored_rows): writes what is new or changed, keeps what isn't, removes the rest.

    Returns the number of chunks by action, as they were before the commit. Unchanged rows are not computed anew: they are those stored.
    """
    from spindle.session import stored

    actions = stored(differences(spark, path, rows.select("chunk_id", "hash", "version")))

    def make(held: DataFrame | None) -> DataFrame:
        changed = rows.join(actions.where("action in ('inserted', 'updated')"), "chunk_id", "left_semi")
        return changed if held is None else held.join(actions.where("action = 'skipped'"), "chunk_id", "left_semi").unionByName(changed.select(held.columns))

    commit(spark, path, token, make)
    return actions.groupBy("action").agg(F.count("*").alias("chunks"))

"""Expansion of search hits along dependency edges, and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import vocabulary as V
from spindle.session import stored


def rounded(score: Column) -> Column:
    """Six decimals; the nudge settles values halfway between two, which engines round differently."""
    return F.round(score + 1e-10, 6)


def expand(hits: DataFrame, edges: DataFrame, *, depth: int = 1, frontier: int = 50, fetched: int = 50, most: int = 50) -> DataFrame:
    """hits and what they depend on, level by level: query_id, node, score, depth, ordinal.

    hits: (query_id, node, score, rank). edges: (src, dst, pos, external); external ones aren't
    followed. Of the nodes that a level's rows point to and that weren't seen, the first frontier ones
    in order of discovery are looked up, at most fetched in order of node, and taken until a query has
    most rows. A row's score is the best of its sources' times the decay; nodes beyond the frontier
    are dropped. A node stands for its own symbol. Each level is written before the next reads it, so
    the plan of a level doesn't grow with its depth.
    """
    level = stored(hits.select("query_id", "node", "score", F.lit(0).alias("depth"), F.col("rank").cast("long").alias("ordinal")))
    kept, looked_at = level, level.select("query_id", "node")
    own = edges.where("not external").select(F.col("src").alias("node"), "dst", "pos")
    query = Window.partitionBy("query_id")
    for d in range(1, depth + 1):
        found = level.join(own, "node").select("query_id", F.col("dst").alias("node"), (F.col("score") * V.DEPTH_DECAY).alias("s"), "ordinal", "pos")
        ahead = found.groupBy("query_id", "node").agg(F.max("s").alias("s"), F.min(F.struct("ordinal", "pos")).alias("seen")).join(looked_at, ["query_id", "node"], "left_anti")
        first = stored(ahead.withColumn("place", F.row_number().over(query.orderBy("seen", "node"))).where(F.col("place") <= frontier))
        looked_at = looked_at.union(first.select("query_id", "node"))
        held = kept.groupBy("query_id").agg(F.count("*").alias("held"), F.max("ordinal").alias("last"))
        rows = first.withColumn("row", F.row_number().over(query.orderBy("node"))).where(F.col("row") <= fetched)
        rows = rows.join(held, "query_id").where(F.col("held") + F.col("row") <= most)
        level = stored(rows.select("query_id", "node", rounded(F.col("s")).alias("score"), F.lit(d).alias("depth"), (F.col("last") + F.col("row")).alias("ordinal")))
        kept = kept.unionByName(level)
    return kept


def expand_symbols(hits: DataFrame, chunks: DataFrame, edges: DataFrame, *, depth: int = 1, frontier: int = 50, fetched: int = 50, most: int = 50) -> DataFrame:
    """hits with the chunks of the symbols they name or belong to: query_id, chunk_id, symbol, score, depth, ordinal.

    hits: (query_id, chunk_id, score, rank); chunks: (chunk_id, symbol, parent), where many may share a
    symbol; edges: (chunk_id, pos, name, external). Two things are remembered for a query: the symbols
    that were looked up or hit, and the chunks that were found. A level takes, in order of
    discovery, the first frontier new names that its chunks depend on, external ones left out, or have for parent,
    a chunk's parent after its names; looks up the chunks of these symbols, fetched at most in order of chunk_id; and keeps
    new ones until a query has most, at least one on the first level. Score: the best of those that name the symbol, times the decay.
    Nulls and empty names lead nowhere. Levels are written one by one and the loop ends with an empty one.
    """
    names = edges.where("not external").select("chunk_id", F.col("pos").cast("long").alias("pos"), "name")
    targets = names.unionByName(chunks.select("chunk_id", F.lit(1 << 40).alias("pos"), F.col("parent").alias("name"))).where("name <> ''")
    level = stored(hits.join(chunks.select("chunk_id", "symbol"), "chunk_id").select("query_id", "chunk_id", "symbol", "score", F.lit(0).alias("depth"), F.col("rank").cast("long").alias("ordinal")))
    kept, seen = level, level.select("query_id", F.col("symbol").alias("name"))
    # of a name's chunks only the first fetched ones can be among a query's first fetched ones, however many share it
    of_name = F.row_number().over(Window.partitionBy("name").orderBy("chunk_id"))
    named = stored(chunks.select("chunk_id", F.col("symbol").alias("name")).where("name is not null").withColumn("_r", of_name).where(F.col("_r") <= fetched).drop("_r"))
    query = Window.partitionBy("query_id")
    for d in range(1, depth + 1):
        found = level.join(targets, "chunk_id").select("query_id", "name", (F.col("score") * V.DEPTH_DECAY).alias("s"), F.struct("ordinal", "pos").alias("at"))
        ahead = found.groupBy("query_id", "name").agg(F.max("s").alias("s"), F.min("at").alias("at")).join(seen, ["query_id", "name"], "left_anti")
        first = stored(ahead.withColumn("place", F.row_number().over(query.orderBy("at", "name"))).where(F.col("place") <= frontier).select("query_id", "name", "s"))
        seen = seen.unionByName(first.select("query_id", "name"))
        matches = first.join(named, "name").withColumn("row", F.row_number().over(query.orderBy("chunk_id"))).where(F.col("row") <= fetched)
        new = matches.join(kept.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("row", F.row_number().over(query.orderBy("chunk_id")))
        held = kept.groupBy("query_id").agg(F.count("*").alias("held"), F.max("ordinal").alias("last"))
        fits = (F.col("held") + F.col("row") <= most) | (F.lit(d == 1) & (F.col("row") == 1))
        rows = new.join(held, "query_id").where(fits)
        level = stored(rows.select("query_id", "chunk_id", F.col("name").alias("symbol"), rounded(F.col("s")).alias("score"), F.lit(d).alias("depth"), (F.col("last") + F.col("row")).alias("ordinal")))
        if level.isEmpty():
            break
        kept = kept.unionByName(level)
    return kept


def statistics(found: DataFrame, final: int = 50) -> DataFrame:
    """query_id, direct, expanded and final counts of found (query_id, depth, ...), lookups (one for the search and one a level that found something), and the mean score."""
    own = found.groupBy("query_id").agg(
        F.count_if(F.col("depth") == 0).alias("direct"), F.count_if(F.col("depth") > 0).alias("expanded"), F.least(F.count("*"), F.lit(final)).cast("long").alias("final"),
        (F.max("depth") + 1).cast("long").alias("lookups"), rounded(F.max("score")).alias("top_score"),
    )
    return own


def rank_score(score: Column, kind: Column, depth: Column) -> Column:
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in V.TYPE_WEIGHTS.items() for x in kv]), kind), F.lit(1.0))
    base = F.when(depth > 0, F.greatest(score, F.lit(V.EXPANDED_FLOOR))).otherwise(score)
    return rounded(base * weight * F.pow(F.lit(V.DEPTH_DECAY), depth))


def reranked(hits: DataFrame, most: int = 50) -> DataFrame:
    """hits (query_id, node, score, depth, ordinal, kind) with rank_score and their place: direct ones first, then by rank score and score."""
    scored = hits.withColumn("rank_score", rank_score(F.col("score"), F.col("kind"), F.col("depth")))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("depth") == 0, 0).otherwise(1), F.desc("rank_score"), F.desc("score"), "ordinal")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def related(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of hits with the hit they lead to, null where it isn't among the query's hits; of hits with one symbol the last counts.

    hits: (query_id, chunk, symbol, ordinal); edges: (chunk, relation, symbol).
    """
    targets = hits.groupBy("query_id", "symbol").agg(F.max_by("chunk", "ordinal").alias("target"))
    return hits.select("query_id", "chunk").join(edges, "chunk").join(targets, ["query_id", "symbol"], "left").select("query_id", "chunk", "relation", "symbol", "target")

"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Only DataFrame functions are used. Sources get whole numbers of blocks by highest quotients, then
each source's shards do. Inside a shard, documents stand in a seeded order as one run of words, cut
into blocks; a seeded permutation of the blocks decides which ones are taken once more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.llm.common import anti_join, checkpointed, semi_join

BLOCK = 16
SHARD_WORDS = 1 << 14
MAX_SHARDS = 4096
SEED = "mix-1"
_STRIDE = 2654435761  # a prime above any number of blocks in a shard
_WORD = r"[^\x20\x09-\x0D]+"


def seeded(*parts: Column) -> Column:
    """A whole number below 2**32 from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size, place, target for sizes (source, size).

    Sources in code point order, null last, weigh weights in turn. A target is a share of all words
    by weight, at most cap times the source's words; what is above goes to the others by weight. One
    row a source takes part in the window without partitions.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = totals.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    order = Window.orderBy(cap * F.col("source_size") / F.col("weight"), "place")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    full = F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("level", (F.sum("source_size").over(every) - full) / open_weight)
    fits = F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), F.col("level"))
    level = level.withColumn("line", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.least(F.coalesce(F.col("line") * F.col("weight"), cap * F.col("source_size")), cap * F.col("source_size"))
    return level.select("source", "source_size", "place", share.cast("double").alias("target"))


def apportion(votes: DataFrame, group: list[str], key: str) -> DataFrame:
    """votes (group, key, votes, house) with seats: the house highest quotients votes / (2 * seat + 1) of each group.

    With n keys, the common divisor that the method amounts to is off house / sum(votes) by n / 2
    seats at most. So each key surely gets its quota less its share of those, and only the quotients
    around its quota are compared. Equal quotients go by key.
    """
    all_ = Window.partitionBy(*group)
    known = votes.withColumns({"total": F.sum("votes").over(all_), "keys": F.count("*").over(all_)})
    quota = F.col("house") * F.col("votes") / F.col("total")
    off = F.floor(F.col("votes") / F.col("total") * F.col("keys") / 2) + 2
    known = known.where("total > 0").withColumns({"base": F.greatest(F.floor(quota) - off, F.lit(0)), "top": F.floor(quota) + off})
    known = known.withColumn("left", F.col("house") - F.sum("base").over(all_))
    tried = known.select(*group, key, "votes", "left", F.explode(F.sequence("base", "top")).alias("seat"))
    rank = F.row_number().over(all_.orderBy(F.desc(F.col("votes") / (2 * F.col("seat") + 1)), key, "seat"))
    won = tried.withColumn("rank", rank).where("rank <= left").groupBy(*group, key).agg(F.count("*").alias("won"))
    return known.join(won, [*group, key], "left").select(*group, key, (F.col("base") + F.coalesce("won", F.lit(0))).alias("seats"))


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int = BLOCK, shard_words: int = SHARD_WORDS, max_shards: int = MAX_SHARDS, key: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, passes, spans.

    passes: how often the mix takes the whole document; spans: runs of words [from, to) that it takes
    once more, as the block selection gives them. taken is the words of both. A null text has size 0
    and nothing is taken of it; null sources are one source, the last; rows without doc_id take part.
    Rows that agree in doc_id and size may exchange their places. Reruns agree. key: a column with a
    value of its own for each row, which the result carries; rows without doc_id, and those of one
    doc_id, then go to shards by it.
    """
    carried = [] if key is None else [key]
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")
    sized = checkpointed(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), *carried))
    targets = source_targets(sized.select("source", "size"), weights, cap)
    house = F.round(F.sum("source_size").over(Window.partitionBy()) / block).cast("long")
    shards = F.least(F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)), F.lit(max_shards)).cast("long")
    sources = targets.withColumns({"house": house, "shards": shards, "all": F.lit(1)})
    seats = apportion(sources.select("all", "place", F.col("target").alias("votes"), "house"), ["all"], "place")
    sources = checkpointed(sources.join(seats.select("place", "seats"), "place", "left").withColumn("seats", F.coalesce("seats", F.lit(0))))

    named = sources.select(F.col("source").alias("name"), "place", "source_size", "target", "shards", "seats")
    dealt = sized.join(named, F.col("source").eqNullSafe(F.col("name")))  # a row a source
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    if key is not None:
        own = F.concat_ws(":", id_, F.col(key).cast("string"))
        many = checkpointed(sized.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
        once = anti_join(dealt, many, "doc_id").withColumn("_id", F.when(F.col("doc_id").isNull(), own).otherwise(id_))
        dealt, id_ = once.unionByName(semi_join(dealt, many, "doc_id").withColumn("_id", own)), F.col("_id")
    dealt = dealt.withColumn("turn", F.md5(F.concat_ws(":", F.lit(SEED), id_).cast("binary")))
    dealt = dealt.withColumn("shard", seeded(F.lit("shard"), id_) % F.col("shards"))
    held = dealt.groupBy("place", "shard").agg(F.sum("size").alias("votes"), F.first("seats").alias("house"))
    quotas = apportion(held, ["place"], "shard").join(held.select("place", "shard", F.ceil(F.col("votes") / block).alias("blocks")), ["place", "shard"])
    quota = F.least("seats", cap * F.col("blocks"))
    quotas = quotas.select("place", "shard", "blocks", F.floor(quota / F.col("blocks")).alias("passes"), (quota % F.col("blocks")).alias("extra"))

    laid = Window.partitionBy("place", "shard").orderBy("turn", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(laid)).join(quotas, ["place", "shard"], "left")
    placed = placed.withColumns({"begin": F.col("end") - F.col("size"), "turned": seeded(F.lit("block"), F.col("place").cast("string"), F.col("shard").cast("string"))})
    numbers = F.when((F.col("size") > 0) & (F.col("extra") > 0), F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)))
    chosen = F.filter(F.coalesce(numbers, F.array().cast("array<bigint>")), lambda b: (b * F.lit(_STRIDE) + F.col("turned")) % F.col("blocks") < F.col("extra"))
    span = lambda b: F.struct((F.greatest(b * block, F.col("begin")) - F.col("begin")).alias("from"), (F.least((b + 1) * block, F.col("end")) - F.col("begin")).alias("to"))
    out = placed.select(*carried, "doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("passes", F.lit(0))).otherwise(0).alias("passes"), F.transform(chosen, span).alias("spans"))
    more = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return out.withColumn("taken", F.col("passes") * F.col("size") + more)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them, with their own columns: whole texts repeated, then the text of the spans.

    Pieces keep the white space that follows each word. A column n_chars is counted anew for pieces.
    Each row takes its own parts, whether others have its doc_id or it has none.
    """
    keyed = checkpointed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")))  # own columns stay in the struct, whatever their names
    plan = mixed(keyed.select("row.doc_id", "row.text", "row.source", "at"), key="at", **options).where("taken > 0").select("at", "passes", "spans")
    joined = keyed.join(plan, "at")
    whole = joined.where("passes > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))).alias("pass")).select("row")
    units = F.regexp_extract_all("row.text", F.lit(_WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.transform(F.array(units), lambda u: F.array_join(F.transform("spans", lambda s: F.array_join(F.slice(u, s["from"].cast("int") + 1, (s["to"] - s["from"]).cast("int")), "")), ""))[0]
    part = joined.where(F.size("spans") > 0).select("row", cut.alias("piece"))
    row = F.col("row").withField("text", F.col("piece").cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("piece").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(part.select(row.alias("row"))).select("row.*")

"""Similar sets: candidates from colliding keys, exact Jaccard, connected components.

All steps are joins and aggregates over pairs of longs; nothing about single sets reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import checkpointed, gathered


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (u, v): comp is the smallest node reachable.

    Alternates two steps until the edges no longer change: every node's larger neighbours, then its
    smaller ones, are hung on its smallest neighbour. The number of rounds grows with the logarithm
    of the longest chain; neighbour lists are never gathered, so a node may have any number of them.
    """
    edges = gathered(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = hung.where("u <> v").distinct()
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        pairs = hung.join(least, "u")
        hung = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = gathered(hung.distinct())
        before, now = now, state(edges)
        if before == now:
            break
    stars = edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def verified(pairs: DataFrame, sets: DataFrame, percent: int, most: int = 500) -> DataFrame:
    """Pairs (u, v) whose sets have 100 * intersection >= percent * union. sets: (node, items).

    The pairs of one u are dealt to parts of about most pairs each, so that no task has all of a hub's.
    """
    degrees = pairs.groupBy("u").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = pairs.join(degrees, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))
    left = sets.select(F.col("node").alias("u"), F.col("items").alias("a")).join(degrees, "u")
    left = left.select("u", "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = sets.select(F.col("node").alias("v"), F.col("items").alias("b"))
    both = dealt.join(left, ["u", "part"]).join(right, "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("u", "v")


def link(items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, tries: int = 4) -> DataFrame:
    """(node, comp) for the nodes that are linked with another one.

    items: (node, n, copies, keys): set size, exact copies, and the table keys of its minhashes.
    sets_of(nodes) gives (node, items) for distinct nodes. The members of each bucket, that is of each
    key, are compared with one of them: of those that meet most others in all their buckets, to an
    eighth, the one with most exact copies, as the original of many copies is. Components follow. Members outside their bucket's largest component are then
    compared with others of its well-met members, tries different ones for all keys together. So far a bucket of
    any size makes a few pairs a member. Then the rest, exactly: where a bucket still holds several
    components, a link may be left between a member outside its largest one and a member of another
    component. Such members and all others of these buckets are compared if they share an item of
    their prefixes and if the item's places allow the overlap, both bounds that no linked pair fails.
    A copy that differs too much from its original has more items of its own than its prefix is long,
    so the items that a whole group shares make no pairs.
    """
    traits = ["node", "n"]
    keyed = items.select(*traits, "copies", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = gathered(keyed.join(buckets, "key"))
    weights = members.groupBy("node").agg(F.floor(F.log(F.sum("members")) / np.log(1.125)).alias("weight"))
    members = members.join(weights, "node").select("key", *traits, "copies", "weight")

    def near(other: str):
        """Another node, of a size that allows the similarity."""
        return (100 * F.least("n", f"{other}.n") >= percent * F.greatest("n", f"{other}.n")) & (F.col("node") != F.col(f"{other}.node"))

    def against(rows: DataFrame, chosen: DataFrame) -> DataFrame:
        """Pairs of rows with the member that chosen (key, hub) names for their key."""
        pairs = rows.join(chosen, "key").where(near("hub"))
        return pairs.select(F.col("hub.node").alias("u"), F.col("node").alias("v")).distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        return gathered(verified(pairs, sets_of(nodes), percent))

    def mixed(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their components, and the buckets of several with the largest of these."""
        labelled = gathered(members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min("n").alias("n"))
        largest = F.max_by("comp", F.struct("c", "comp")).alias("major")
        return labelled, sizes.groupBy("key").agg(largest, F.count("*").alias("comps"), F.min("n").alias("least")).where("comps > 1")

    heaviest = members.groupBy("key").agg(F.max_by(F.struct(*traits), F.struct("weight", "copies", "node")).alias("hub"))
    pairs = gathered(against(members, heaviest))
    edges = confirmed(pairs)
    labels = components(edges)

    labelled, several = mixed(labels)
    inside = labelled.join(several.select("key", "major"), "key")
    turn = F.xxhash64("node", F.pmod(F.xxhash64("key"), F.lit(tries)))
    chosen = inside.where("comp = major").groupBy("key").agg(F.max_by(F.struct(*traits), F.struct("weight", turn)).alias("hub"))
    again = against(inside.where("comp <> major").select("key", *traits), chosen)
    again = gathered(again.join(pairs, ["u", "v"], "left_anti"))
    if not again.isEmpty():
        edges, pairs = gathered(edges.union(confirmed(again))), pairs.union(again)
        labels = components(edges)
        labelled, several = mixed(labels)

    inside = labelled.join(several.select("key", "major", "least"), "key")
    left = inside.groupBy("node").agg(F.first("comp").alias("comp"), F.max((F.col("comp") != F.col("major")).cast("int")).alias("minor"), *[F.first(c).alias(c) for c in traits[1:]], F.min("least").alias("least"))
    left = gathered(left)
    if left.isEmpty():
        return labels
    prefixes = gathered(_prefixes(left, sets_of(left.select("node")), percent))
    minor = prefixes.where("minor = 1").select("item", F.struct(*traits, "comp", "place").alias("x"))
    # items up to the shared ones may differ, those after them may all agree
    most = 1 + F.least(F.col("n") - F.col("place"), F.col("x.n") - F.col("x.place"))
    rest = minor.join(prefixes, "item").where("comp <> x.comp").where(near("x")).where((100 + percent) * most >= percent * (F.col("n") + F.col("x.n")))
    rest = rest.select(F.least("x.node", "node").alias("u"), F.greatest("x.node", "node").alias("v")).distinct()
    tried = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    rest = gathered(rest.join(tried, ["u", "v"], "left_anti"))
    if rest.isEmpty():
        return labels
    return components(edges.union(confirmed(rest)))


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """nodes with each item of their prefixes and its place: two sets of the similarity, at least, share one of these.

    nodes: (node, comp, minor, n, least); least bounds the partners' sizes from below. Items are taken
    in the order of their number of sets. A set's overlap with a partner is percent / (100 + percent)
    of both sizes at least, so one common item is among the first n - overlap + 1. Items of one set
    alone fill places there but join with nothing.
    """
    single = checkpointed(sets.select("node", F.explode("items").alias("item")))
    often = single.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    ordered = single.join(often, "item").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("shared"))
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    overlap = F.ceil((F.col("n") + partner) * percent / (100 + percent))
    alone = F.col("n") - F.size("shared")
    first = nodes.join(ordered, "node").withColumns({"alone": alone, "places": (F.col("n") - overlap + 1 - alone).cast("int")}).where("places > 0")
    first = first.select(*nodes.columns, "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("places"))).alias("at", "s"))
    return first.select(*nodes.columns, (F.col("alone") + F.col("at") + 1).alias("place"), F.col("s.item").alias("item"))

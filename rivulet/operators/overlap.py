"""Sets of cells that overlap: similarity joins by prefixes, and corridors merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save
from .components import connected_components

#: Jaccard similarity from which two corridors are one; a fixed value.
CORRIDOR_JACCARD = 0.35


def similar_sets(members: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (key, item) -> (classes, pairs): (key, class) for equal sets, and (a, b, jaccard) of classes at ``least`` or more.

    Equal sets are one class, named by the least key, before anything else is done.
    Items stand in the order of their frequency, the rarest first, and a set of n
    items is indexed by its first n - ceil(least * n) + 1 only: sets that are similar
    enough share one of those. So an item that most sets have is hardly ever met. Sets
    that meet are checked exactly if what follows their item in both can still suffice.
    """
    sets = members.where("item IS NOT NULL").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = save(sets.groupBy("items").agg(F.min("key").alias("class"), F.collect_list("key").alias("keys")), "sets")
    classes = named.select(F.explode("keys").alias("key"), "class")
    each = named.select("class", F.explode("items").alias("item"))
    placed = each.join(each.groupBy("item").agg(F.count("*").alias("n")), "item").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("places"))
    held = save(placed.select("class", F.col("places.item").alias("items")), "members")
    size = F.size("items")
    first = held.select("class", size.alias("n"), F.posexplode(F.slice("items", F.lit(1), (size - F.ceil(least * size - 1e-9) + 1).cast("int"))).alias("at", "item"))
    # at the first item that two similar sets share, the rest of either holds all that they have in common
    enough = f"least(x.n - x.at, z.n - z.at) >= {least / (1 + least)!r} * (x.n + z.n) - 1e-9"
    met = first.alias("x").join(first.alias("z"), F.col("x.item") == F.col("z.item")).where("x.class < z.class").where(enough).select(F.col("x.class").alias("a"), F.col("z.class").alias("b"))
    near = met.repartition("a").distinct()
    whole = lambda c: held.select(F.col("class").alias(c), F.col("items").alias(f"p{c}"))
    common = F.size(F.array_intersect("pa", "pb"))
    checked = near.join(whole("a"), "a").join(whole("b"), "b").select("a", "b", (common / (F.size("pa") + F.size("pb") - common)).alias("jaccard"))
    return classes, checked.where(F.col("jaccard") >= least)


def merged_corridors(cells: DataFrame, corridors: DataFrame, least: float = CORRIDOR_JACCARD) -> DataFrame:
    """(corridor, kept, members): corridors (corridor, length_m) whose cells (corridor, cell) overlap become one.

    Overlap is transitive; of a cluster the longest corridor is kept, of equally long
    ones the one with the greatest sha256 of its id. A corridor without cells stands
    alone. One row for each corridor, with the one that is kept for it.
    """
    classes, pairs = similar_sets(cells.select(F.col("corridor").alias("key"), F.col("cell").alias("item")), least)
    pairs = save(pairs, "pairs")
    named = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    cluster = classes.join(named, F.col("class") == F.col("node"), "left").select(F.col("key").alias("corridor"), F.coalesce("component", "class").alias("cluster"))
    whole = save(corridors.join(cluster, "corridor", "left").select("corridor", "length_m", F.coalesce("cluster", "corridor").alias("cluster"), F.col("cluster").isNull().alias("alone")), "clusters")
    best = whole.groupBy("cluster", "alone").agg(F.max_by("corridor", F.struct(F.round("length_m", 6), F.sha2(F.col("corridor").cast("string"), 256))).alias("kept"), F.count("*").alias("members"))
    return whole.join(best, ["cluster", "alone"]).select("corridor", "kept", "members")

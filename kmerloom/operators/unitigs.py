"""Maximal unbranched paths by pointer doubling: every oriented k-mer learns its path's head in log2(longest path) joins."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import masks
from kmerloom.functions.sequence import reverse_complement
from kmerloom.operators.graph import oriented
from kmerloom.plans.runtime import cut


def merged_colors(graph: DataFrame, colors: list[int]) -> DataFrame:
    return graph.where(F.col("color").isin(*colors) & (F.col("cov") > 0)).groupBy("ck").agg(F.sum("cov").alias("cov"), F.bit_or("in_mask").alias("in_mask"), F.bit_or("out_mask").alias("out_mask")).withColumn("color", F.lit(0))


def sole_edges(graph: DataFrame) -> DataFrame:
    """(km, prev): edges that are the only way out of prev and the only way into km, both ends in the graph."""
    both = oriented(graph).select("km", "in_mask", "out_mask")
    one = both.where(masks.degree(F.col("in_mask")) == 1).select("km", F.concat(F.element_at(masks.bases(F.col("in_mask")), 1), F.expr("substr(km, 1, length(km) - 1)")).alias("prev"))
    return one.join(both.where(masks.degree(F.col("out_mask")) == 1).select(F.col("km").alias("prev")), "prev", "left_semi")


def unitig_positions(graph: DataFrame) -> DataFrame:
    """(km, head, at, circular) for both directions of every k-mer of a one-colour graph.

    head is the path's first k-mer and at the steps from it; a circular path has its least k-mer as head and no steps. Rounds
    double the distance a pointer spans; a pointer still on its way after log2(rows) rounds runs in a circle.
    """
    nodes = oriented(graph).select("km")
    state = cut(nodes.join(sole_edges(graph), "km", "left").select("km", F.col("prev").alias("ptr"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("at"), F.coalesce("prev", "km").alias("head"), F.least("km", F.coalesce("prev", "km")).alias("low")), "pointers")
    rows, done = state.count(), cut(state.where("ptr is null"), "ends")
    state = cut(state.where("ptr is not null"), "pointers")
    for _ in range(math.ceil(math.log2(max(rows, 2))) + 1):
        if state.isEmpty():
            break
        ahead = done.union(state).select(F.col("km").alias("_k"), F.col("ptr").alias("_p"), F.col("at").alias("_a"), F.col("head").alias("_h"), F.col("low").alias("_l"))
        moved = cut(state.join(ahead, F.col("ptr") == F.col("_k")).select("km", F.col("_p").alias("ptr"), (F.col("at") + F.col("_a")).alias("at"), F.col("_h").alias("head"), F.least("low", "_l").alias("low")), "pointers")

        done = done.union(moved.where("ptr is null"))
        state = moved.where("ptr is not null")
    state = done.union(state)
    ring = F.col("ptr").isNotNull()
    return state.select("km", F.when(ring, F.col("low")).otherwise(F.col("head")).alias("head"), F.when(~ring, F.col("at")).alias("at"), ring.alias("circular"))


def unitigs(graph: DataFrame) -> DataFrame:
    """(seq, kmers): each unbranched path once, in its lesser direction; circular ones are left to unitig_positions."""
    at = unitig_positions(graph).where("not circular")
    paths = at.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("at", F.right("km", F.lit(1)).alias("b")))).alias("p"))
    seq = F.concat("head", F.array_join(F.transform(F.expr("slice(p, 2, size(p))"), lambda x: x["b"]), ""))
    paths = paths.select(seq.alias("seq"), F.size("p").alias("kmers"))
    return paths.where(F.col("seq") <= reverse_complement("seq"))

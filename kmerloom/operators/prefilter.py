"""Prefilters that follow walks: tips, contamination, unanchored and orphaned novel k-mers.

A walk without links goes on while a k-mer has one k-mer after it, so every k-mer has at most one step in either direction and
walks are chains of pointers. Facts of a walk (does it end dead, does it meet an anchor) are gathered by pointer doubling: each
round joins pointers with themselves and doubles the steps that they span, so no walk is ever held in one place. A k-mer is
judged by its own walk; walks that run into a circle have no end.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import masks
from kmerloom.functions.sequence import reverse_complement
from kmerloom.operators.graph import next_kmers, oriented
from kmerloom.operators.kmers import kmerize
from kmerloom.plans.components import components
from kmerloom.plans.runtime import cut, release


def walk_facts(graph: DataFrame, marks: DataFrame, flags: list[str]) -> DataFrame:
    """(ck, dead_end, *flags) for each k-mer of a one-colour graph: whether its walk ends, on either side, at a k-mer that has no
    edge there and whose first flag is set, and whether any k-mer of the walk has each flag of `marks` (ck, *flags)."""
    none = F.lit(False)
    rows = graph.select("ck", "in_mask", "out_mask").join(marks, "ck", "left").select("ck", "in_mask", "out_mask", *[F.coalesce(f, none).alias(f) for f in flags])
    back = rows.select(reverse_complement("ck").alias("km"), masks.mirror(F.col("in_mask")).alias("o"), *flags)
    both = rows.select(F.col("ck").alias("km"), F.col("out_mask").alias("o"), *flags).union(back)
    one = masks.degree(F.col("o")) == 1
    ahead = F.when(one, F.concat(F.expr("substr(km, 2)"), F.element_at(masks.bases(F.col("o")), 1)))
    state = cut(both.select("km", ahead.alias("ptr"), ((F.col("o") == 0) & F.col(flags[0])).alias("dead_end"), *flags), "walks")
    count, done = state.count(), [state.where("ptr is null")]
    cuts, state = [state], state.where("ptr is not null")
    for _ in range(math.ceil(math.log2(max(count, 2))) + 1):
        if state.isEmpty():
            break
        reached = state
        for x in done:
            reached = reached.union(x)
        reached = reached.select(F.col("km").alias("_k"), F.col("ptr").alias("_p"), F.col("dead_end").alias("_d"), *[F.col(f).alias(f"_{f}") for f in flags])
        moved = state.join(reached, F.col("ptr") == F.col("_k"), "left")
        lost = F.col("_k").isNull()  # the next k-mer is not in the graph: the walk ends before it
        moved = cut(moved.select("km", F.col("_p").alias("ptr"), F.when(lost, none).otherwise(F.col("_d")).alias("dead_end"), *[(F.col(f) | F.coalesce(f"_{f}", none)).alias(f) for f in flags]), "walks")
        cuts.append(moved)
        done.append(moved.where("ptr is null"))
        state = moved.where("ptr is not null")
    out = state.withColumn("dead_end", none)
    for x in done:
        out = out.union(x)
    own = F.least("km", reverse_complement("km"))
    facts = cut(out.groupBy(own.alias("ck")).agg(F.max("dead_end").alias("dead_end"), *[F.max(f).alias(f) for f in flags]), "facts")
    release(*cuts)
    return facts


def tips(graph: DataFrame, rois: DataFrame) -> DataFrame:
    """Novel k-mers whose walk in the child's graph ends at a novel k-mer with nothing beyond it, on either side."""
    found = walk_facts(graph, rois.select("ck", F.lit(True).alias("novel")), ["novel"])
    return rois.join(found.where("dead_end").select("ck"), "ck", "left_semi")


def anchors(references: DataFrame, k: int) -> DataFrame:
    """(ck): k-mers that stand exactly once in one of the references (background, contig, seq)."""
    found = kmerize(references, k, "seq", ("background",), ("ck",)).groupBy("background", "ck").agg(F.count("*").alias("n"))
    return found.where("n = 1").select("ck").distinct()


def _anchored(graph: DataFrame, rois: DataFrame, anchored: DataFrame, more: DataFrame) -> DataFrame:
    marks = rois.select("ck", F.lit(True).alias("novel")).join(anchored.withColumn("anchor", F.lit(True)), "ck", "full").join(more.withColumn("contam", F.lit(True)), "ck", "full")
    marks = marks.select("ck", "novel", (F.col("anchor") & F.col("novel").isNull()).alias("anchor"), (F.col("contam") & F.col("novel")).alias("contam"))
    return walk_facts(graph, marks, ["novel", "anchor", "contam"])


def contamination(graph: DataFrame, rois: DataFrame, contaminants: DataFrame, anchored: DataFrame) -> DataFrame:
    """Novel k-mers whose walk meets a novel contaminant (ck) and no inherited k-mer that is anchored (ck, of `anchors`)."""
    found = _anchored(graph, rois, anchored, contaminants.select("ck").distinct())
    return rois.join(found.where("contam and not anchor").select("ck"), "ck", "left_semi")


def unanchored(graph: DataFrame, rois: DataFrame, anchored: DataFrame) -> DataFrame:
    """Novel k-mers whose walk meets no inherited k-mer that is anchored."""
    found = _anchored(graph, rois, anchored, rois.select("ck").where("false"))
    return rois.join(found.where("not anchor").select("ck"), "ck", "left_semi")


def orphans(graph: DataFrame, rois: DataFrame) -> DataFrame:
    """Novel k-mers of components of the child's graph that hold novel k-mers only and end somewhere: all ways from a dead end
    lead to dead ends and to nothing inherited. Nodes are 64-bit hashes of k-mers."""
    node = lambda x: F.xxhash64(F.least(x, reverse_complement(x)))
    edges = next_kmers(graph).select(node("km").alias("u"), node("next").alias("v"))
    at = components(edges).withColumnRenamed("node", "_node")
    rows = graph.select("ck", "in_mask", "out_mask", F.xxhash64("ck").alias("_node")).join(at, "_node", "left")
    rows = rows.withColumn("component", F.coalesce("component", "_node")).join(rois.select("ck", F.lit(1).alias("_novel")), "ck", "left")
    held = rows.groupBy("component").agg(F.count("*").alias("n"), F.count("_novel").alias("novel"), F.max((F.col("in_mask") == 0) | (F.col("out_mask") == 0)).alias("dead"))
    own = rows.join(held.where("n = novel and dead").select("component"), "component", "left_semi").select("ck")
    return rois.join(own, "ck", "left_semi")


def prefiltered(graph: DataFrame, rois: DataFrame, low: int = 10, complexity: float = 0.70) -> DataFrame:
    """Novel k-mers that no prefilter marks, in the order of the workflow: orphans, tips, dust, low coverage, low complexity.

    graph is the child's colour. Each filter reads the same novel k-mers, so what one marks does not depend on another."""
    from kmerloom.operators import filters

    marked = None
    for found in (orphans(graph, rois), tips(graph, rois), filters.dust(rois), filters.low_coverage(rois, low), filters.low_complexity(rois, complexity)):
        marked = found.select("ck") if marked is None else marked.union(found.select("ck"))
    return rois.join(marked.distinct(), "ck", "left_anti")

"""Graph cleaning on unitigs: short dead ends, thinly covered paths, bubbles; edges to k-mers that went go as well."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions import masks
from kmerloom.functions.sequence import canonical, reverse_complement
from kmerloom.operators.graph import oriented, overlaps
from kmerloom.operators.unitigs import unitig_positions
from kmerloom.plans.runtime import cut


def paths(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, paths) of a one-colour graph: paths (head, n, cov, last, ins, outs) in both directions, circles left out.

    Sums are made by head, so a long path costs one row a partition.
    """
    at = cut(unitig_positions(graph).where("not circular").select("km", "head", "at"), "positions")
    rows = at.join(oriented(graph).select("km", "cov", "in_mask", "out_mask"), "km")
    edge = F.struct("at", "km", "in_mask", "out_mask")
    found = rows.groupBy("head").agg(F.count("*").alias("n"), F.avg("cov").alias("cov"), F.min(edge).alias("a"), F.max(edge).alias("z"))
    return at, found.select("head", "n", "cov", F.col("z.km").alias("last"), F.col("a.in_mask").alias("ins"), F.col("z.out_mask").alias("outs"))


def dead_ends(found: DataFrame, most: int) -> DataFrame:
    """Paths of at most `most` k-mers with neighbours on one side only."""
    return found.where((F.col("n") <= most) & ((F.col("ins") == 0) != (F.col("outs") == 0)))


def thin(found: DataFrame, least: float) -> DataFrame:
    """Paths of mean coverage under `least`."""
    return found.where(F.col("cov") < least)


def bubbles(found: DataFrame) -> DataFrame:
    """Paths that share both neighbours with a path of more coverage (in a tie, of lower text). At most 4 paths share them."""
    one = found.where((masks.degree(F.col("ins")) == 1) & (masks.degree(F.col("outs")) == 1))
    before = F.concat(F.element_at(masks.bases(F.col("ins")), 1), F.expr("substr(head, 1, length(head) - 1)"))
    after = F.concat(F.expr("substr(last, 2)"), F.element_at(masks.bases(F.col("outs")), 1))
    tie = F.least(F.col("head"), reverse_complement("last"))
    rank = F.row_number().over(Window.partitionBy("_b", "_a").orderBy(F.desc("cov"), F.desc("n"), "_t"))
    return one.withColumns({"_b": before, "_a": after, "_t": tie}).withColumn("_r", rank).where("_r > 1").drop("_a", "_b", "_t", "_r")


def without(graph: DataFrame, at: DataFrame, drop: DataFrame) -> DataFrame:
    """The graph without the k-mers of the dropped paths and without edges to them."""
    gone = at.join(drop.select("head"), "head", "left_semi").select(canonical("km").alias("ck")).distinct()
    kept = graph.join(gone, "ck", "left_anti")
    return consistent(kept)


def consistent(graph: DataFrame) -> DataFrame:
    """The graph with only those edges whose other end it has in the same colour."""
    kept = lambda own, there: F.col(own).bitwiseAND(F.col(there)).alias(own)
    return overlaps(graph).select("ck", "color", "cov", kept("in_mask", "ins"), kept("out_mask", "outs"))


def cleaned(graph: DataFrame, tip: int, least: float = 0.0, pop: bool = True) -> DataFrame:
    """Dead ends of at most `tip` k-mers off, then paths under `least` coverage, then bubbles: each on the graph as it is then."""
    for rule in ([lambda f: dead_ends(f, tip)] if tip else []) + ([lambda f: thin(f, least)] if least else []) + ([bubbles] if pop else []):
        at, found = paths(graph)
        graph = cut(without(graph, at, rule(found)), "cleaned")
    return graph

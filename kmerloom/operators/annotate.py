"""Calls against features and truth: regions, genes, repeats, partitions, positional matches, quality thresholds, k-mer features."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.operators import contigs, intervals


def _first_label(points: DataFrame, features: DataFrame, key: str, out: str) -> DataFrame:
    """(key, out): the least id of the features (chr, start, stop, id) over a point (chr, pos)."""
    asked = points.select(F.col("chr"), F.col(key).alias("_key"), F.col("pos").alias("start"), F.col("pos").alias("stop"))
    return intervals.overlaps(asked, features.select("chr", "start", "stop", "id")).groupBy(F.col("_key").alias(key)).agg(F.min("b_id").alias(out))


def annotate(calls: DataFrame, key: str, regions: DataFrame, genes: DataFrame, repeats: DataFrame, within: int = 100_000) -> DataFrame:
    """calls (chr, pos, key unique) with region (`core` where none), gene, genic, closest_gene (by start, at most `within` off) and
    repeat. Null positions match nothing."""
    points = calls.select(*dict.fromkeys(["chr", "pos", key]))
    rows = calls.join(_first_label(points, regions, key, "region"), key, "left").join(_first_label(points, genes, key, "gene"), key, "left")
    rows = rows.join(_first_label(points, repeats, key, "repeat"), key, "left")
    near = intervals.nearest(points, genes, key, within).select(key, F.col("id").alias("closest_gene"))
    rows = rows.join(near, key, "left").withColumn("genic", F.col("gene").isNotNull())
    return rows.withColumn("region", F.coalesce(F.col("region").cast("string"), F.lit("core")))


def positional_match(called: DataFrame, truth: DataFrame, key: str, allowed: dict[str, int], default: int = 500) -> DataFrame:
    """(key, truth_id, distance): the nearest truth variant (chr, pos, type, id) of the same type, within the type's distance.

    Ties go to the least id. Pairs meet in bins as wide as the largest distance.
    """
    limit = F.coalesce(*[F.when(F.col("type") == t, F.lit(d)) for t, d in allowed.items()], F.lit(default))
    asked = called.select("chr", F.col(key).alias("_key"), "type", limit.alias("_limit"), F.col("pos").alias("start"), F.col("pos").alias("stop"))
    most = max([default, *allowed.values()])
    spans = truth.select("chr", (F.col("pos") - most).alias("start"), (F.col("pos") + most).alias("stop"), F.col("pos").alias("at"), "type", "id")
    pairs = intervals.overlaps(asked, spans, max(most, 1)).where("type = b_type").withColumn("d", F.abs(F.col("start") - F.col("b_at"))).where("d < _limit")
    return pairs.groupBy(F.col("_key").alias(key)).agg(F.min(F.struct("d", "b_id")).alias("m")).select(key, F.col("m.b_id").alias("truth_id"), F.col("m.d").alias("distance"))


def quality_filter(variants: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """Variants whose numbers reach every lower bound and stay within every upper one; a missing number passes."""
    test: Column = F.lit(True)
    for name, bound in least.items():
        test &= F.coalesce(F.col(name) >= bound, F.lit(True))
    for name, bound in most.items():
        test &= F.coalesce(F.col(name) <= bound, F.lit(True))
    return variants.where(test)


def feature_table(rois: DataFrame, kmers: DataFrame, lengths: DataFrame, name: str, k: int, flags: dict[str, DataFrame]) -> DataFrame:
    """One row a novel k-mer: coverage, the contig with most novel k-mers that holds it (least name in a tie), that contig's
    length and novel k-mers, the k-mer's least distance from its ends, and 0 or 1 for each named set of k-mers."""
    novel = contigs.novel_counts(kmers, rois, name).select(name, "distinct_novel")
    at = kmers.select(name, "ck", "pos").join(rois.select("ck"), "ck", "left_semi").join(lengths, name)
    ends = at.groupBy("ck", name).agg(F.min(F.least(F.col("pos"), F.col("len") - k - F.col("pos"))).alias("distance"), F.max("len").alias("length"))
    rank = F.struct("distinct_novel", (-F.col(name)).alias("n"), "length", "distance")
    best = ends.join(novel, name).groupBy("ck").agg(F.max(rank).alias("m"))
    rows = rois.select("ck", "cov").join(best, "ck", "left").select("ck", "cov", (-F.col("m.n")).alias("contig"), F.col("m.distinct_novel").alias("novels"), F.col("m.length").alias("length"), F.col("m.distance").alias("distance"))
    for flag, keys in flags.items():
        rows = rows.join(keys.select("ck").distinct().withColumn(flag, F.lit(1)), "ck", "left").withColumn(flag, F.coalesce(flag, F.lit(0)))
    return rows


"""Interval joins: rows meet in bins of fixed width by equality, then by the exact condition, each pair in one bin only."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _binned(rows: DataFrame, start: str, stop: str, size: int) -> DataFrame:
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(stop) / size))))


def overlaps(a: DataFrame, b: DataFrame, size: int = 1000) -> DataFrame:
    """Pairs of (chr, start, stop, *) and (chr, start, stop, *) closed intervals that share a position; b's columns get `b_`."""
    b = b.withColumnsRenamed({c: f"b_{c}" for c in b.columns})
    left, right = _binned(a, "start", "stop", size), _binned(b, "b_start", "b_stop", size).withColumnRenamed("_bin", "_bin2")
    first = F.floor(F.greatest("start", "b_start") / size)
    return left.join(right, (F.col("chr") == F.col("b_chr")) & (F.col("_bin") == F.col("_bin2")) & (F.col("start") <= F.col("b_stop")) & (F.col("stop") >= F.col("b_start")) & (F.col("_bin") == first)).drop("_bin", "_bin2")


def contained(a: DataFrame, b: DataFrame, size: int = 1000) -> DataFrame:
    """Pairs where b lies inside a."""
    return overlaps(a, b, size).where("b_start >= start and b_stop <= stop")


def nearest(points: DataFrame, features: DataFrame, key: str, within: int, size: int = 1000) -> DataFrame:
    """Each point (chr, pos, key) with the feature (chr, start, id) of least |start - pos| <= within, the least id in a tie.

    Only the last start up to a place and the first one from it on can be nearest. They are found among the distinct places
    of a bin and, where the bin has none, by running ends over the bins, so work does not grow with `within`.
    """
    bin_of = lambda x: F.floor(F.col(x) / size).alias("_bin")
    starts = features.where("start is not null").groupBy("chr", "start").agg(F.min("id").alias("id")).select("chr", F.col("start").alias("_at"), F.struct("start", "id").alias("_f"))
    places = points.where("pos is not null").select("chr", F.col("pos").alias("_at")).distinct()
    rows = places.withColumn("_f", F.lit(None).cast(starts.schema["_f"].dataType)).unionByName(starts).select("chr", "_at", "_f", bin_of("_at"))
    order = Window.partitionBy("chr", "_bin").orderBy("_at")
    rows = rows.withColumn("_a", F.last("_f", True).over(order.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_z", F.first("_f", True).over(order.rangeBetween(0, Window.unboundedFollowing)))
    bins = rows.groupBy("chr", "_bin").agg(F.max("_f").alias("_hi"), F.min("_f").alias("_lo"))
    order = Window.partitionBy("chr").orderBy("_bin")
    bins = bins.select("chr", "_bin", F.last("_hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_b"), F.first("_lo", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_y"))
    asked = rows.where("_f is null").join(bins, ["chr", "_bin"]).select("chr", "_at", F.explode(F.array(F.coalesce("_a", "_b"), F.coalesce("_z", "_y"))).alias("f")).where("f is not null")
    found = asked.select("chr", "_at", F.struct(F.abs(F.col("f.start") - F.col("_at")).alias("distance"), F.col("f.id").alias("id")).alias("m")).where(F.col("m.distance") <= within)
    found = found.groupBy("chr", "_at").agg(F.min("m").alias("m"))
    best = points.select("chr", F.col("pos").alias("_at"), F.col(key).alias("_key")).join(found, ["chr", "_at"]).groupBy("_key").agg(F.min("m").alias("m"))
    return best.select(F.col("_key").alias(key), F.col("m.id").alias("id"), F.col("m.distance").alias("distance"))


def none_within(points: DataFrame, others: DataFrame, key: str, window: int) -> DataFrame:
    """Points without another point (chr, pos) within `window`."""
    asked = points.select("chr", F.col(key).alias("_key"), F.col("pos").alias("start"), F.col("pos").alias("stop"))
    spans = others.select("chr", (F.col("pos") - window).alias("start"), (F.col("pos") + window).alias("stop")).distinct()
    near = overlaps(asked, spans, max(window, 1)).select(F.col("_key").alias(key)).distinct()
    return points.join(near, key, "left_anti")


def merged(rows: DataFrame, by: list[str], size: int = 100_000) -> DataFrame:
    """Unions of overlapping closed intervals (start, stop) of each group.

    Rows are sorted within bins of their starts only. What crosses bins (how far earlier intervals reach, and how many unions
    begin before) goes through running ends of one row a bin, so no task sorts a whole group.
    """
    keys = [*by, "_bin"]
    rows = rows.where("start is not null and stop is not null").select(*by, "start", "stop", F.floor(F.col("start") / size).alias("_bin"))
    earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*keys).agg(F.max("stop").alias("_to")).withColumn("_reach", F.max("_to").over(earlier)).drop("_to")
    order = Window.partitionBy(*keys).orderBy("start", "stop")
    before = F.greatest("_reach", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    rows = rows.alias("r").join(reach.alias("b"), same).select(*[f"r.{c}" for c in keys], "start", "stop", "_reach")
    rows = rows.withColumn("_f", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("_g", F.sum("_f").over(order))
    parts = rows.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("_f").alias("_new"))
    begun = parts.groupBy(*keys).agg(F.sum("_new").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    parts = parts.alias("r").join(begun.alias("b"), same).select(*[f"r.{c}" for c in by], "start", "stop", (F.col("_before") + F.col("_g")).alias("_g"))
    return parts.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def longest(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n longest intervals of each group, ties by start."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col("stop") - F.col("start")), "start"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)

"""Contigs against k-mer sets: counts, positions, runs, sections, trimming, lengths. Contig k-mers come from graph.kmerize."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.sequence import reverse_complement
from kmerloom.operators.graph import next_kmers


def membership(kmers: DataFrame, rois: DataFrame) -> DataFrame:
    """Contig k-mers with a flag `novel`."""
    return kmers.join(rois.select("ck", F.lit(True).alias("_n")), "ck", "left").withColumn("novel", F.coalesce("_n", F.lit(False))).drop("_n")


def novel_counts(kmers: DataFrame, rois: DataFrame, name: str) -> DataFrame:
    """Contigs with novel k-mers: occurrences and distinct ones. Distinct pairs are made first, so a hot contig is shared out."""
    pairs = kmers.join(rois.select("ck"), "ck", "left_semi").groupBy(name, "ck").agg(F.count("*").alias("n"))
    return pairs.groupBy(name).agg(F.sum("n").alias("occurrences"), F.count("*").alias("distinct_novel"))


def filter_partitions(kmers: DataFrame, rois: DataFrame, name: str, more_than: int = 5) -> DataFrame:
    """Contigs with over `more_than` distinct novel k-mers and none at either end."""
    marked = membership(kmers, rois)
    pairs = marked.groupBy(name, "ck", "novel").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    rows = pairs.groupBy(name).agg(F.sum(F.col("novel").cast("int")).alias("n"), F.min(F.struct("lo", "novel")).alias("a"), F.max(F.struct("hi", "novel")).alias("z"))
    return rows.where((F.col("n") > more_than) & ~F.col("a.novel") & ~F.col("z.novel")).select(name, F.col("n").cast("long").alias("distinct_novel"))


def filtered(parts: DataFrame, name: str, more_than: int = 5) -> DataFrame:
    """filter_partitions of partial rows (name, n, lo, lo_novel, hi, hi_novel) of disjoint sets of k-mers."""
    rows = parts.groupBy(name).agg(F.sum("n").alias("n"), F.min(F.struct("lo", "lo_novel")).alias("a"), F.max(F.struct("hi", "hi_novel")).alias("z"))
    return rows.where((F.col("n") > more_than) & ~F.col("a.lo_novel") & ~F.col("z.hi_novel")).select(name, F.col("n").alias("distinct_novel"))


def distance_to_end(kmers: DataFrame, lengths: DataFrame, name: str, k: int) -> DataFrame:
    rows = kmers.join(lengths, name)
    return rows.select(name, "pos", "ck", F.least(F.col("pos"), F.col("len") - k - F.col("pos")).alias("distance"))


def copy_index(kmers: DataFrame, name: str) -> DataFrame:
    """Which repeat of its k-mer within the contig each one is, from 0."""
    nth = F.row_number().over(Window.partitionBy(name, "km").orderBy("pos")) - 1
    return kmers.withColumn("copy", nth)


def islands(rows: DataFrame, name: str, pos: str = "pos", gap: int = 1) -> DataFrame:
    """(name, start, stop, n) of runs of positions at most `gap` apart."""
    order = Window.partitionBy(name).orderBy(pos)
    first = F.when(F.col(pos) - F.lag(pos).over(order) <= gap, 0).otherwise(1)
    marked = rows.withColumn("_f", first).withColumn("_g", F.sum("_f").over(order))
    return marked.groupBy(name, "_g").agg(F.min(pos).alias("start"), F.max(pos).alias("stop"), F.count("*").alias("n")).drop("_g")


def novelty_regions(kmers: DataFrame, rois: DataFrame, name: str) -> DataFrame:
    return islands(kmers.join(rois.select("ck"), "ck", "left_semi").select(name, "pos").distinct(), name)


def sections(regions: DataFrame, lengths: DataFrame | None, name: str, split: int = 2000, pad: int = 200) -> DataFrame:
    """Regions at most `split` apart as one section, padded and held inside the contig (in k-mer positions of 0..n-1). n is in lengths,
    or without these a column of regions."""
    order = Window.partitionBy(name).orderBy("start", "stop")
    far = F.when(F.col("start") - F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= split, 0).otherwise(1)
    rows = regions.withColumn("_f", far).withColumn("_g", F.sum("_f").over(order)).groupBy(name, "_g").agg(F.min("start").alias("a"), F.max("stop").alias("z"), *([F.max("n").alias("n")] if lengths is None else []))
    rows = rows if lengths is None else rows.join(lengths, name)
    return rows.select(name, F.greatest(F.col("a") - pad, F.lit(0)).alias("start"), F.least(F.col("z") + pad, F.col("n") - 1).alias("stop"))


def trim(kmers: DataFrame, rois: DataFrame, seqs: DataFrame, name: str, k: int, margin: int = 500) -> DataFrame:
    """Contigs cut to their novel k-mers and `margin` k-mers on each side."""
    ends = kmers.join(rois.select("ck"), "ck", "left_semi").groupBy(name).agg(F.min("pos").alias("a"), F.max("pos").alias("z"))
    rows = ends.join(seqs.select(name, "seq"), name)
    a = F.greatest(F.col("a") - margin, F.lit(0))
    z = F.least(F.col("z") + margin, F.length("seq") - k)
    return rows.select(name, F.substr("seq", a + 1, z - a + k).alias("seq"))


def case_runs(seqs: DataFrame, name: str, seq: str = "seq") -> DataFrame:
    """(name, start, stop, upper) of runs of one letter case, 0-based and half open."""
    rows = seqs.select(name, F.posexplode(F.split(seq, "")).alias("pos", "c")).where("c <> ''").withColumn("up", F.col("c") == F.upper("c"))
    order = Window.partitionBy(name).orderBy("pos")
    rows = rows.withColumn("_f", F.when(F.col("up") == F.lag("up").over(order), 0).otherwise(1)).withColumn("_g", F.sum("_f").over(order))
    return rows.groupBy(name, "_g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.min("up").alias("upper")).drop("_g")


def smooth(sites: DataFrame, by: str, pos: str, value: str) -> DataFrame:
    """Values that differ from both neighbours, where these agree, take their value."""
    order = Window.partitionBy(by).orderBy(pos)
    a, b = F.lag(value).over(order), F.lead(value).over(order)
    return sites.withColumn("smoothed", F.when((a == b) & (a != F.col(value)), a).otherwise(F.col(value)))


def change_points(sites: DataFrame, by: str, pos: str, value: str) -> DataFrame:
    """The first site of every run of a value, and the last site."""
    order = Window.partitionBy(by).orderBy(pos)
    changed = F.lag(value).over(order).isNull() | (F.lag(value).over(order) != F.col(value)) | F.lead(pos).over(order).isNull()
    return sites.withColumn("_c", changed).where("_c").drop("_c")


def half_length(lengths: DataFrame, length: str, total: Column | None = None) -> DataFrame:
    """N50 (or NG50 with a given total): the length at which contigs from the longest down reach half of all letters.

    Equal lengths are summed first, so the window runs over distinct lengths.
    """
    rows = lengths.groupBy(F.col(length).alias("_l")).agg(F.sum(length).alias("_s"))
    order = Window.orderBy(F.desc("_l"))
    rows = rows.withColumn("_to", F.sum("_s").over(order)).withColumn("_all", total if total is not None else F.sum("_s").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.where(F.col("_to") >= F.col("_all") / 2).agg(F.max("_l").alias("half_length"))


def length_stats(lengths: DataFrame, length: str) -> DataFrame:
    x = F.col(length)
    return lengths.agg(F.count(x).alias("n"), F.min(x).alias("shortest"), F.max(x).alias("longest"), F.avg(x).alias("mean"))


def moments(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, sample variance and deviation; 0 for fewer than two values."""
    x = F.col(value)
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.when(F.count(x) > 1, F.var_samp(x)).otherwise(0.0).alias("variance"), F.when(F.count(x) > 1, F.stddev_samp(x)).otherwise(0.0).alias("deviation"))


def coverage_along(kmers: DataFrame, graph: DataFrame, name: str, color: int) -> DataFrame:
    """Mean coverage of a contig's k-mers in a colour, absent ones as 0, cut to whole numbers."""
    pairs = kmers.groupBy(name, "ck").agg(F.count("*").alias("n")).join(graph.where(F.col("color") == color).select("ck", "cov"), "ck", "left")
    return pairs.groupBy(name).agg(F.floor(F.sum(F.col("n") * F.coalesce("cov", F.lit(0))) / F.sum("n")).cast("long").alias("coverage"))


def best_overlap(left: DataFrame, right: DataFrame, rois: DataFrame, a: str, b: str) -> DataFrame:
    """For each left contig the right one with most shared novel k-mers, the least name in a tie.

    k-mers in very many contigs meet only through distinct (contig, k-mer) rows.
    """
    x = left.join(rois.select("ck"), "ck", "left_semi").select(F.col(a).alias("a"), "ck").distinct()
    y = right.join(rois.select("ck"), "ck", "left_semi").select(F.col(b).alias("b"), "ck").distinct()
    return best_of(x.join(y, "ck").groupBy("a", "b").agg(F.count("*").alias("shared")))


def best_of(n: DataFrame) -> DataFrame:
    """Of (a, b, shared) for each a the b that shares most, the least name in a tie."""
    return n.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("nb"))).alias("m")).select("a", (-F.col("m.nb")).alias("b"), F.col("m.shared").alias("shared"))


def extents(kmers: DataFrame, contig_kmers: DataFrame, read: str, name: str) -> DataFrame:
    """For each read and contig the first and last contig position of a shared k-mer."""
    return kmers.select(read, "ck").distinct().join(contig_kmers.select(name, "ck", "pos"), "ck").groupBy(read, name).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def end_links(seqs: DataFrame, graph: DataFrame, name: str, k: int) -> DataFrame:
    """(a, a_strand, b, b_strand): contigs whose last k-mer has an edge, in the one-colour graph, to the first k-mer of another or of
    the same, each contig in both directions."""
    whole = seqs.where(F.length("seq") >= k)
    both = whole.select(name, F.lit("+").alias("strand"), "seq").union(whole.select(name, F.lit("-").alias("strand"), reverse_complement("seq").alias("seq")))
    first = both.select(F.col(name).alias("b"), F.col("strand").alias("b_strand"), F.left("seq", F.lit(k)).alias("next"))
    last = both.select(F.col(name).alias("a"), F.col("strand").alias("a_strand"), F.right("seq", F.lit(k)).alias("km"))
    return last.join(next_kmers(graph).select("km", "next"), "km").join(first, "next").select("a", "a_strand", "b", "b_strand")

"""Coloured k-mer graphs in long form: (ck, color, cov, in_mask, out_mask), one row a canonical k-mer and colour."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions import masks
from kmerloom.functions.sequence import canonical, complement, reverse_complement
from kmerloom.operators.kmers import counted, kmerize
from kmerloom.plans.runtime import cut


def build(kmers: DataFrame, color: str = "color") -> DataFrame:
    """Count k-mers and unite their edges by canonical k-mer and colour; partial sums are made before the one shuffle."""
    flip = F.col("ck") != F.col("km")
    ins = F.when(flip, masks.bit(complement("nb"))).otherwise(masks.bit(F.col("pb")))
    outs = F.when(flip, masks.bit(complement("pb"))).otherwise(masks.bit(F.col("nb")))
    return kmers.groupBy("ck", F.col(color).alias("color")).agg(F.count("*").alias("cov"), F.bit_or(ins).alias("in_mask"), F.bit_or(outs).alias("out_mask"))


def from_text(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows of a text dump (`ck cov.. edges..`) in long form."""
    parts = F.split(F.trim(line), " +")
    n = ((F.size(parts) - 1) / 2).cast("int")
    rows = lines.select(parts.alias("p"), n.alias("n")).withColumn("color", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    edges = masks.from_text(F.element_at("p", F.col("color") + F.col("n") + 2))
    return rows.select(F.element_at("p", 1).alias("ck"), "color", F.element_at("p", F.col("color") + 2).cast("long").alias("cov"), edges["in_mask"].alias("in_mask"), edges["out_mask"].alias("out_mask"))


def wide(graph: DataFrame, colors: int) -> DataFrame:
    """(ck, cov array, edges array of texts): absent colours have 0 and no edges."""
    named = graph.groupBy("ck").agg(*[F.max(F.when(F.col("color") == c, F.struct("cov", "in_mask", "out_mask"))).alias(f"c{c}") for c in range(colors)])
    return named.select(
        "ck", F.array(*[F.coalesce(F.col(f"c{c}.cov"), F.lit(0)) for c in range(colors)]).alias("cov"),
        F.array(*[F.coalesce(masks.text(F.col(f"c{c}.in_mask"), F.col(f"c{c}.out_mask")), F.lit("........")) for c in range(colors)]).alias("edges"),
    )


def text(graph: DataFrame, colors: int) -> DataFrame:
    return wide(graph, colors).select("ck", F.concat_ws(" ", "ck", F.array_join(F.transform("cov", lambda x: x.cast("string")), " "), F.array_join("edges", " ")).alias("line"))


def join(*graphs: tuple[DataFrame, int]) -> DataFrame:
    """Outer join of graphs, each with its number of colours: colours follow one another."""
    out, at = None, 0
    for graph, colors in graphs:
        moved = graph.withColumn("color", F.col("color") + F.lit(at))
        out, at = moved if out is None else out.unionByName(moved), at + colors
    return out


def remove(graph: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of k-mers that no other graph covers."""
    for other in others:
        graph = graph.join(other.where("cov > 0").select("ck").distinct(), "ck", "left_anti")
    return graph


def numbered(graph: DataFrame) -> DataFrame:
    """k-mers with their 0-based position in sorted order: ranges are dealt and written first, then counted, so no task sorts all
    and every reader sees the same ranges."""
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(graph.select("ck").distinct().repartitionByRange(parts, "ck").withColumn("_p", F.spark_partition_id()), "ranges")
    inside = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("ck")))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_b", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).select("_p", "_b")
    return inside.join(F.broadcast(before), "_p").select("ck", (F.col("_b") + F.col("_n") - 1).alias("at"))


def head(graph: DataFrame, n: int = 10) -> DataFrame:
    return graph.select("ck").distinct().orderBy("ck").limit(n)


def tail(graph: DataFrame, n: int = 10) -> DataFrame:
    return graph.select("ck").distinct().orderBy(F.desc("ck")).limit(n)


def between(graph: DataFrame, start: int, end: int) -> DataFrame:
    return numbered(graph).where((F.col("at") >= start) & (F.col("at") < end))


def first_between(least: DataFrame, start: int, end: int) -> DataFrame:
    """between() of rows (ck) that hold the `end` least k-mers, maybe more than once; for ranges near the start."""
    first = least.distinct().orderBy("ck").limit(end)
    return first.withColumn("at", (F.row_number().over(Window.orderBy("ck")) - 1).cast("long")).where(F.col("at") >= start)


def lookup(graph: DataFrame, kmers: DataFrame, km: str = "km") -> DataFrame:
    """kmers with their rows of the graph, in the k-mer's own direction; absent ones have null coverage."""
    asked = kmers.withColumn("ck", canonical(km))
    found = asked.join(graph, "ck", "left")
    flip = F.col("ck") != F.col(km)
    return found.withColumns({"in_mask": F.when(flip, masks.mirror(F.col("out_mask"))).otherwise(F.col("in_mask")), "out_mask": F.when(flip, masks.mirror(F.col("in_mask"))).otherwise(F.col("out_mask"))})


def oriented(graph: DataFrame) -> DataFrame:
    """Both directions of every row: (km, color, cov, in_mask, out_mask)."""
    back = graph.select(reverse_complement("ck").alias("km"), "color", "cov", masks.mirror(F.col("out_mask")).alias("in_mask"), masks.mirror(F.col("in_mask")).alias("out_mask"))
    return graph.select(F.col("ck").alias("km"), "color", "cov", "in_mask", "out_mask").union(back)


def next_kmers(graph: DataFrame) -> DataFrame:
    """(km, color, next) for both directions of every k-mer."""
    return oriented(graph).select("km", "color", F.explode(masks.bases(F.col("out_mask"))).alias("b")).select("km", "color", F.concat(F.expr("substr(km, 2)"), "b").alias("next"))


def prev_kmers(graph: DataFrame) -> DataFrame:
    return oriented(graph).select("km", "color", F.explode(masks.bases(F.col("in_mask"))).alias("b")).select("km", "color", F.concat("b", F.expr("substr(km, 1, length(km) - 1)")).alias("prev"))


def overlaps(graph: DataFrame) -> DataFrame:
    """graph with ins and outs: the masks of all k-mers of the same colour, in either direction, that overlap by k - 1 letters.

    Oriented k-mers are grouped by their first k - 1 letters; each row asks that table with the k - 1 letters at either end."""
    rest = lambda x: F.expr(f"substr({x}, 2)")
    starts = oriented(graph).groupBy(F.expr("substr(km, 1, length(km) - 1)").alias("_x"), F.col("color").alias("_color")).agg(F.bit_or(masks.bit(F.right("km", F.lit(1)))).alias("_m"))
    rows = graph.withColumn("_rc", reverse_complement("ck"))
    ahead = starts.withColumnsRenamed({"_m": "_o"})
    rows = rows.join(ahead, (rest("ck") == F.col("_x")) & (F.col("color") == F.col("_color")), "left").drop("_x", "_color")
    behind = starts.withColumnsRenamed({"_m": "_i"})
    rows = rows.join(behind, (rest("_rc") == F.col("_x")) & (F.col("color") == F.col("_color")), "left").drop("_x", "_color", "_rc")
    return rows.select(*graph.columns, F.coalesce(masks.mirror(F.col("_i")), F.lit(0)).alias("ins"), F.coalesce("_o", F.lit(0)).alias("outs"))


def infer_edges(graph: DataFrame) -> DataFrame:
    """Edges between every two covered k-mers of a colour that overlap in k - 1 letters, whether read together or not."""
    return overlaps(graph).select("ck", "color", "cov", F.col("ins").alias("in_mask"), F.col("outs").alias("out_mask"))


def color_of(colors: DataFrame, name: Column) -> DataFrame:
    """The colour of a sample by its name without case, if just one has it; else the name as a number, if it is one; else -1."""
    found = colors.where(F.lower("sample_name") == F.lower(name)).agg(F.count("*").alias("n"), F.min("color").alias("c"))
    number = F.when(F.col("n") == 0, name.try_cast("int"))
    return found.select(F.when(F.col("n") == 1, F.col("c")).otherwise(F.coalesce(number, F.lit(-1))).alias("color"))


__all__ = ["between", "build", "color_of", "counted", "from_text", "head", "infer_edges", "join", "kmerize", "lookup", "next_kmers", "numbered", "oriented", "overlaps", "prev_kmers", "remove", "tail", "text", "wide"]

"""Connected components by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.plans.runtime import cut, release


def _mark(edges: DataFrame) -> tuple:
    """(edges, a sum of their hashes, whether they are stars: no node above two others or between two). One row a node, made with
    map-side partial sums, meets in one exchange."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"), F.xxhash64("u", "v").cast("decimal(38,0)").alias("h"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1), F.lit(0).cast("decimal(38,0)")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"), F.sum("h").alias("h"))
    row = nodes.agg(F.sum("up").alias("n"), F.sum("h").alias("h"), F.max(F.col("up") + F.col("down")).alias("most")).first()
    # a node with one edge down has up = 1, the centre of a star up = 0 and down = 1
    return row["n"] or 0, row["h"], (row["most"] or 0) <= 1


def _with_least(edges: DataFrame, least: DataFrame, hubs: DataFrame) -> DataFrame:
    """edges (u, v) with the m of their u from least (u, m, n). Rows of hubs, of which there are few, meet a broadcast table and
    scatter over the tasks of the other rows' join, so no node's rows gather in one task."""
    marked = edges.join(F.broadcast(hubs.select(F.col("u").alias("_hub"), F.col("m").alias("_hm"))), F.col("u") == F.col("_hub"), "left")
    marked = marked.withColumn("_key", F.when(F.col("_hub").isNull(), F.col("u")).otherwise(F.xxhash64("v")))
    found = marked.join(least.select(F.col("u").alias("_node"), "m"), F.col("_key") == F.col("_node"), "left")
    return found.select("u", "v", F.coalesce("_hm", "m").alias("m"))


def _hubs(least: DataFrame, edges: int) -> DataFrame:
    """Nodes with more than a five-hundredth of the edges' ends: under 1000, whatever the input."""
    return least.where(F.col("n") > max(16, edges // 500))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.where("v > u"), least, _hubs(least, count)).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, _hubs(least, count)).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is its least node.

    Loops and repeated edges are harmless, rows with a null end are no edges, an empty list gives no rows.
    Each round joins edges with one minimum a node, made with map-side partial sums; no neighbourhood is collected, and a
    hub's edges are spread over all tasks.
    Rounds grow with the logarithm of the node count, and each is cut by a written table. They end as soon as the edges are stars,
    each u with its one v, which is less and has none: a list that comes as stars takes no round.
    """
    edges = cut(
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(edges)
    while not mark[2]:
        after = cut(_small_star(_large_star(edges, mark[0]), mark[0]), "edges")
        now = _mark(after)
        release(edges)
        edges = after
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

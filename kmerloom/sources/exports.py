"""Texts of results: tracks by sample, karyotypes, JSON of subgraphs, padded tables, and readers of small typed tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def track_lines(sites: DataFrame) -> DataFrame:
    """(sample, value): `chr start stop value` lines of runs (sample, chr, start, stop, value), to be written by sample."""
    return sites.select("sample", F.concat_ws(" ", *[F.col(c).cast("string") for c in ("chr", "start", "stop", "value")]).alias("value"))


def karyotype(reference: DataFrame, breaks: bool = False) -> DataFrame:
    """(contig, start, stop): whole contigs, or their stretches between runs of N; 0-based and half open."""
    if not breaks:
        return reference.select("contig", F.lit(0).alias("start"), F.length("seq").alias("stop"))
    pieces = F.regexp_extract_all("seq", F.lit("([Nn]+|[^Nn]+)"), 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        stop = acc["at"] + F.length(p)
        piece = F.array(F.struct(acc["at"].alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(p.rlike("^[Nn]"), acc["out"]).otherwise(F.concat(acc["out"], piece)).alias("out"))

    return reference.select("contig", F.explode(F.aggregate(pieces, start, step, lambda acc: acc["out"])).alias("x")).select("contig", "x.start", "x.stop")


def json_graph(vertices: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(name, value): one JSON line a vertex and an edge of each subgraph."""
    return vertices.select(name, F.to_json(F.struct(F.lit("vertex").alias("kind"), *[c for c in vertices.columns if c != name])).alias("value")).union(
        edges.select(name, F.to_json(F.struct(F.lit("edge").alias("kind"), *[c for c in edges.columns if c != name])).alias("value"))
    )


def padded(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(value): columns cut or padded to fixed widths; null as NA."""
    return rows.select(F.concat_ws(" ", *[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("NA")), w, " ") for c, w in widths.items()]).alias("value"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value) of a tab-separated matrix whose first column names rows and whose header names columns."""
    wide = spark.read.csv(path, sep="\t", header=True)
    first, *names = wide.columns
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in names])
    return wide.select(F.col(f"`{first}`").alias("row"), F.explode(cells).alias("x")).select("row", "x.column", "x.value")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(table, cells) of white-space text that names its table in the first field; blank lines go."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.element_at(parts, 1).alias("table"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))).alias("cells"))

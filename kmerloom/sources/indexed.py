"""Tables sorted by a key for lookups (links, reference k-mers, contigs, reads), lists of arguments, typed tables."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.sources.graphs import read_links


def write_indexed(rows: DataFrame, key: str, path: str) -> None:
    """rows as Parquet in ranges of the key, sorted in each: files and row groups hold short key ranges, so a lookup by pushed-down
    filters reads few of them."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, values: list | DataFrame) -> DataFrame:
    """Rows of an indexed table for some keys: a list is pushed down to the files, a DataFrame (with column key) is joined."""
    held = spark.read.parquet(path)
    if isinstance(values, DataFrame):
        return held.join(values.select(key).distinct(), key, "left_semi")
    return held.where(F.col(key).isin(*values)) if values else held.where("false")


def open_links(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """Links by what the path names: an indexed table (.parquet) or text files."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_links(spark, path, sample)


def expanded(arguments: list[str]) -> list[str] | dict[str, str]:
    """Arguments with each .list or .txt file replaced by its lines; a dictionary if all are of the form key:value.

    Blank lines and lines that begin with # go."""
    out: list[str] = []
    for x in arguments:
        if x.endswith((".list", ".txt")) and os.path.exists(x):
            with open(x) as f:
                out += [line.strip() for line in f if line.strip() and not line.startswith("#")]
        else:
            out.append(x)
    pairs = [x.split(":", 1) for x in out]
    return dict(pairs) if out and all(len(p) == 2 for p in pairs) else out


def column_types(tables: DataFrame) -> DataFrame:
    """(table, place, type) of the cells (table, cells) of read_tables: long if all of a place are whole numbers, double if all
    are numbers, else string."""
    rows = tables.select("table", F.posexplode("cells").alias("place", "cell"))
    whole, number = F.min(F.col("cell").try_cast("long").isNotNull()), F.min(F.col("cell").try_cast("double").isNotNull())
    found = rows.groupBy("table", "place").agg(whole.alias("w"), number.alias("n"))
    return found.select("table", "place", F.when(F.col("w"), "long").when(F.col("n"), "double").otherwise("string").alias("type"))

"""Predicates on graphs: novel k-mers and the prefilters that mark suspect ones. Graphs are long (ck, color, cov, masks)."""

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import masks


def coverage(graph: DataFrame, colors: list[int]) -> DataFrame:
    """(ck, c<color>..): coverage by colour, one pass and one shuffle."""
    return graph.groupBy("ck").agg(*[F.coalesce(F.max(F.when(F.col("color") == c, F.col("cov"))), F.lit(0)).alias(f"c{c}") for c in colors])


def novel(graph: DataFrame, child: int, parents: list[int]) -> DataFrame:
    """The child's rows whose k-mers no parent covers: one pass and one shuffle, with partial maxima."""
    own = (F.col("color") == child) & (F.col("cov") > 0)
    kept = [c for c in graph.columns if c not in ("ck", "color")]
    rows = graph.groupBy("ck").agg(F.max(F.when(own, F.col("color"))).alias("color"), F.max(F.when(F.col("color").isin(*parents) & (F.col("cov") > 0), 1).otherwise(0)).alias("_p"), *[F.max(F.when(own, F.col(c))).alias(c) for c in kept])
    return rows.where("color is not null and _p = 0").select(*graph.columns)


def is_novel(g: dict) -> np.ndarray:
    """k-mers of colour 2 that colours 0 and 1 do not cover, by columns of buckets.wide."""
    return (g["cov2"] > 0) & (g["cov0"] == 0) & (g["cov1"] == 0)


def is_single(colors: list[int]) -> Callable[[dict], np.ndarray]:
    """singly_connected, by columns of buckets.wide."""
    single = np.array([x in (1, 2, 4, 8) for x in range(16)])

    def test(g: dict) -> np.ndarray:
        ok = True
        for c in colors:
            ok = ok & ((g[f"cov{c}"] == 0) | single[g[f"in{c}"]] & single[g[f"out{c}"]])
        return ok

    return test


def low_coverage(rois: DataFrame, least: int = 10) -> DataFrame:
    return rois.where(F.col("cov") < least)


def dust(rois: DataFrame, most: int = 4) -> DataFrame:
    return rois.where(masks.degree(F.col("in_mask")) + masks.degree(F.col("out_mask")) > most)


def compression_ratio(seq: str | Column) -> Column:
    """Bytes of the gzip form (level 9) for each letter, in Arrow batches.

    Texts of at most 120 bytes are compressed with the least window and tables, which start faster and cut none of their matches."""

    def size(data: bytes) -> int:
        if len(data) > 120:
            return len(zlib.compress(data, 9, 31))
        made = zlib.compressobj(9, zlib.DEFLATED, -9, 1)
        return len(made.compress(data)) + len(made.flush()) + 18  # the header and the checksum of gzip

    def ratio(found: pd.Series) -> pd.Series:
        return found.map(lambda s: size(s.encode()) / len(s) if s else None).astype("float64")

    return F.pandas_udf(ratio, "double", F.PandasUDFType.SCALAR)(seq)


def may_be_low(words: np.ndarray, k: int, least: float) -> np.ndarray:
    """False only for packed k-mers whose gzip form surely has `least` bytes a letter or more.

    Of k-mers with all four letters only a block of fixed codes may be so small: tables of own codes for them and the end take 103 bits,
    and data 5. There a letter takes 8 bits and a match 12 at least, 10 more are the block's, and a match of n letters repeats n - 2
    words of three letters. So too few repeated words are too few matches."""
    bits = 8 * (int(np.ceil(least * k)) - 1 - 18)
    if k < 4 or bits >= 108:
        return np.ones(len(words), bool)
    need = min((k - left // 8 - 2 * m for m in range(k) if (left := bits - 10 - 12 * m) >= 32), default=k)
    seen, letters = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    one, three, six = np.uint64(1), np.uint64(3), np.uint64(63)
    for i in range(k):
        x = words >> np.uint64(2 * i)
        letters |= one << (x & three)
        if i < k - 2:
            seen |= one << (x & six)
    return (letters < 15) | (k - 2 - np.bitwise_count(seen).astype(np.int64) >= need)


def is_novel_low(k: int, least: float) -> Callable[[dict], np.ndarray]:
    """Novel k-mers that may_be_low keeps, by columns of buckets.wide."""

    def test(g: dict) -> np.ndarray:
        keep = is_novel(g)
        at = np.flatnonzero(keep)
        keep[at] = may_be_low(g["ck"][at], k, least)
        return keep

    return test


def low_complexity(rois: DataFrame, least: float = 0.70) -> DataFrame:
    return rois.where(compression_ratio("ck") < least)


def shared(rois: DataFrame, graph: DataFrame, own: list[int]) -> DataFrame:
    """rois that a colour outside `own` covers."""
    return rois.join(graph.where(~F.col("color").isin(*own) & (F.col("cov") > 0)).select("ck").distinct(), "ck", "left_semi")


def recover(graph: DataFrame, dirty: DataFrame, child: int) -> DataFrame:
    """Child coverage of each k-mer: its own, else that of the uncleaned graph if another colour covers the k-mer."""
    rows = graph.groupBy("ck").agg(F.max(F.when(F.col("color") == child, F.col("cov"))).alias("own"), F.max(F.when(F.col("color") != child, F.col("cov"))).alias("other"))
    rows = rows.join(dirty.where("cov > 0").select("ck", F.col("cov").alias("dirty")), "ck", "left")
    cov = F.when(F.coalesce("own", F.lit(0)) > 0, F.col("own")).when((F.coalesce("other", F.lit(0)) > 0) & F.col("dirty").isNotNull(), F.col("dirty"))
    return rows.select("ck", cov.alias("cov")).where("cov is not null")


def validated(graph: DataFrame, absent: list[int], present: list[int], child: int, limit: int) -> DataFrame:
    rows = coverage(graph, [*absent, *present, child])
    test = F.col(f"c{child}") > limit
    for c in absent:
        test &= F.col(f"c{c}") == 0
    for c in present:
        test &= F.col(f"c{c}") > 0
    return rows.where(test).select("ck")


def singly_connected(graph: DataFrame) -> DataFrame:
    """k-mers with one edge in and one out in every covering colour."""
    one = (masks.degree(F.col("in_mask")) == 1) & (masks.degree(F.col("out_mask")) == 1)
    return graph.where("cov > 0").groupBy("ck").agg(F.min(one).alias("one")).where("one").select("ck")


def single_parent(graph: DataFrame, parents: list[int]) -> DataFrame:
    return graph.where(F.col("color").isin(*parents) & (F.col("cov") > 0)).groupBy("ck").agg(F.count("*").alias("n"), F.min("color").alias("parent")).where("n = 1").select("ck", "parent")


def labels(rois: DataFrame, graph: DataFrame, backgrounds: list[tuple[int, str]]) -> DataFrame:
    """rois with the name of the first background that covers them, else `unknown`."""
    rows = rois.select("ck").join(coverage(graph, [c for c, _ in backgrounds]), "ck", "left")
    return rows.select("ck", F.coalesce(*[F.when(F.col(f"c{c}") > 0, F.lit(name)) for c, name in backgrounds], F.lit("unknown")).alias("label"))


def coverage_stats(graph: DataFrame, child: int, parents: list[int], others: list[int]) -> DataFrame:
    """Child coverage -> sum of the numbers of covered parents and other children, over k-mers that all three share."""
    return stats_of(coverage(graph, [child, *parents, *others]), child, parents, others)


def stats_of(rows: DataFrame, child: int, parents: list[int], others: list[int]) -> DataFrame:
    """coverage_stats of rows (c<color>..)."""
    count = lambda cs: sum((F.when(F.col(f"c{c}") > 0, 1).otherwise(0) for c in cs), F.lit(0))
    rows = rows.withColumns({"p": count(parents), "o": count(others)}).where((F.col(f"c{child}") > 0) & (F.col("p") > 0) & (F.col("o") > 0))
    return rows.groupBy(F.col(f"c{child}").alias("coverage")).agg(F.sum(F.col("p") + F.col("o")).alias("total"))

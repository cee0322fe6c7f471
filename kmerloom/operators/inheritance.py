"""Inheritance tracks and matrices: genotype codes, site matrices, sums, principal components, read alignments' CIGAR texts."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def genotype_code(parent0: Column, parent1: Column, child: Column) -> Column:
    """0 where the child has the first parent's genotype and not the second's, else 1."""
    return F.when((child == parent0) & (child != parent1), 0).otherwise(1)


def track(genotypes: DataFrame, site: list[str], parent0: str, parent1: str) -> DataFrame:
    """(site columns, sample, code) of long genotypes (site, sample, gt); every sample but the parents."""
    found = genotypes.groupBy(*site).agg(F.max(F.when(F.col("sample") == parent0, F.col("gt"))).alias("_a"), F.max(F.when(F.col("sample") == parent1, F.col("gt"))).alias("_b"))
    rows = genotypes.where(~F.col("sample").isin(parent0, parent1)).join(found, site)
    return rows.select(*site, "sample", genotype_code(F.col("_a"), F.col("_b"), F.col("gt")).alias("code"))


def matrix(rows: DataFrame, by: list[str], column: str, value: str, names: list[str]) -> DataFrame:
    """One row a site with a column for each name; absent cells are null. names bounds the width."""
    return rows.groupBy(*by).pivot(column, names).agg(F.max(value))


def added(*matrices: DataFrame) -> DataFrame:
    """Sum of matrices in long form (row, column, value); a cell that one lacks counts as 0."""
    out = matrices[0]
    for other in matrices[1:]:
        out = out.unionByName(other)
    return out.groupBy("row", "column").agg(F.sum("value").alias("value"))


def principal_components(rows: DataFrame, columns: list[str], center: bool = True, scale: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, deviations) of numeric columns, by falling deviation; scaled by the population deviation.

    One pass sums products of columns on executors; the driver holds a square of the number of columns (at most 500), not of
    rows. Rows with a null are left out. A column without spread is not scaled. The sign of a component makes its largest
    loading positive. Deviations are those of the singular values over sqrt(max(1, n - 1)).
    """
    d = len(columns)
    if not 0 < d <= 500:
        raise ValueError("between 1 and 500 columns")
    x = [F.col(c).cast("double") for c in columns]
    kept = rows.dropna(subset=columns)
    first = kept.agg(F.count("*"), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    n = first[0]
    if not n:
        return np.eye(d), np.zeros(d)
    mean = np.array(first[1 : d + 1], float) * center
    spread = np.array(first[d + 1 :], float)
    spread = np.where(spread > 0, spread, 1.0) if scale else np.ones(d)
    z = [(c - float(m)) / float(s) for c, m, s in zip(x, mean, spread)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = kept.agg(*[F.sum(z[i] * z[j]) for i, j in pairs]).first()
    gram = np.zeros((d, d))
    for (i, j), v in zip(pairs, sums):
        gram[i, j] = gram[j, i] = v
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] + 1e-300)
    return vectors, np.sqrt(np.maximum(values[order], 0)) / np.sqrt(max(1, n - 1))


def cigar_steps(cigar: Column) -> Column:
    """array of (n, op)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), 1), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))


def cigar_places(cigar: Column, op: str) -> Column:
    """0-based columns at which steps of one kind start; every step moves on by its length, deletions as well."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, s: F.struct((acc["at"] + s["n"]).alias("at"), F.when(s["op"] == op, F.concat(acc["out"], F.array(acc["at"]))).otherwise(acc["out"]).alias("out"))
    return F.aggregate(cigar_steps(cigar), start, step, lambda acc: acc["out"])


def cigar_sizes(cigar: Column, op: str) -> Column:
    """Lengths of the steps of one kind, in order."""
    return F.transform(F.filter(cigar_steps(cigar), lambda s: s["op"] == op), lambda s: s["n"])


def reversed_cigar(cigar: Column) -> Column:
    """The CIGAR of the same alignment read from the other strand."""
    return F.array_join(F.transform(F.reverse(cigar_steps(cigar)), lambda s: F.concat(s["n"].cast("string"), s["op"])), "")


def mismatch_places(md: Column) -> Column:
    """0-based reference places of substitutions that an MD text names; deleted letters move on, too."""
    parts = F.regexp_extract_all(md, F.lit(r"([0-9]+|\^[A-Za-z]+|[A-Za-z])"), 1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        number, gone = p.rlike("^[0-9]+$"), p.startswith("^")
        size = F.when(number, p.try_cast("long")).when(gone, F.length(p) - 1).otherwise(1)
        return F.struct((acc["at"] + size).cast("long").alias("at"), F.when(number | gone, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["at"]))).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])

"""Numeric helpers as Columns: Poisson probabilities, draws from empirical distributions, rounding to steps, first maximum."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def poisson(mu: Column, n: Column) -> Column:
    """The chance of n events at a mean of mu, by logarithms of the factors, so that n may be large; mu 0 gives 1 for n 0."""
    steps = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    logs = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.log(mu / i))
    return F.when(mu == 0, F.when(n == 0, 1.0).otherwise(0.0)).otherwise(F.exp(logs - mu))


def which_max(values: Column) -> Column:
    """The 0-based place of the first greatest element."""
    return F.array_position(values, F.array_max(values)) - 1


def round_up(x: Column, step: int) -> Column:
    return F.ceil(x / step) * step


def round_down(x: Column, step: int) -> Column:
    return F.floor(x / step) * step


def nearly(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= tolerance


def combinations(items: Column) -> Column:
    """All subsets of an array with at least one element, in the order of their bit masks: 2 to its size less 1."""
    masks = F.when(F.size(items) > 0, F.sequence(F.lit(1), (F.call_function("shiftleft", F.lit(1), F.size(items)) - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(masks, lambda m: F.filter(items, lambda _, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))


def drawn(rows: DataFrame, u: str, bins: DataFrame, value: str = "value", rate: str = "rate") -> DataFrame:
    """rows with `drawn`: the least value of the empirical distribution `bins` whose cumulated share reaches u (0 to 1).

    The table of bins is one distribution: its cumulated shares are one array of as many numbers as it has values."""
    order = Window.orderBy(value)
    total = F.sum(rate).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = bins.groupBy(value).agg(F.sum(rate).alias(rate)).withColumn("_to", F.sum(rate).over(order) / total)
    table = upto.agg(F.array_sort(F.collect_list(F.struct("_to", F.col(value).alias("_v")))).alias("_t"))
    found = F.element_at(F.col("_t"), F.least(F.size(F.filter("_t", lambda x: x["_to"] < F.col(u))) + 1, F.size("_t")))
    return rows.join(F.broadcast(table), F.lit(True)).withColumn("drawn", found["_v"]).drop("_t")  # one row

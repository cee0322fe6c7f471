"""A running graph over a stream of reads: the batch build as a stateful aggregate in update or complete mode."""

from pyspark.sql import DataFrame

from kmerloom.operators.graph import build, kmerize


def running_graph(reads: DataFrame, k: int, seq: str = "seq", color: str = "color") -> DataFrame:
    """Coverage and edges so far of every (k-mer, colour) of an unbounded table (color, seq).

    State is one row a k-mer and colour; counts and masks merge, so late reads need no watermark.
    """
    return build(kmerize(reads, k, seq, (color,)), color)

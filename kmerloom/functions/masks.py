"""Edge masks: bit i of a mask is base ACGT[i]. Reading a k-mer backwards swaps in and out and mirrors both."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from kmerloom.functions.sequence import BASES


def bit(base: Column) -> Column:
    """The mask of one base, 0 for null and other letters."""
    return F.when(base == "A", 1).when(base == "C", 2).when(base == "G", 4).when(base == "T", 8).otherwise(0)


def mirror(mask: Column) -> Column:
    """The mask of the complement bases."""
    return sum((F.shiftleft(F.shiftright(mask, i).bitwiseAND(F.lit(1)), 3 - i) for i in range(1, 4)), F.shiftleft(mask.bitwiseAND(F.lit(1)), 3)).cast("int")


def bases(mask: Column) -> Column:
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, F.lit(b)) for i, b in enumerate(BASES)]))


def text(in_mask: Column, out_mask: Column) -> Column:
    """acgtACGT with a dot for each edge that is not there."""
    ins = [F.when(F.shiftright(in_mask, i).bitwiseAND(F.lit(1)) == 1, F.lit(b.lower())).otherwise(".") for i, b in enumerate(BASES)]
    outs = [F.when(F.shiftright(out_mask, i).bitwiseAND(F.lit(1)) == 1, F.lit(b)).otherwise(".") for i, b in enumerate(BASES)]
    return F.concat(*ins, *outs)


def from_text(edges: Column) -> Column:
    """Struct (in_mask, out_mask) of an edge text."""
    flag = [F.when(F.substr(edges, F.lit(i + 1), F.lit(1)) != ".", 1 << (i % 4)).otherwise(0) for i in range(8)]
    return F.struct((flag[0] + flag[1] + flag[2] + flag[3]).alias("in_mask"), (flag[4] + flag[5] + flag[6] + flag[7]).alias("out_mask"))


def degree(mask: Column) -> Column:
    return F.bit_count(mask).cast("int")


def byte(in_mask: Column, out_mask: Column) -> Column:
    """The stored edge byte: the in nibble is A in its high bit, the out nibble A in its low bit."""
    return F.shiftleft(mirror(in_mask), 4) + out_mask

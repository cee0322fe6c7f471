"""Simulated variants as Columns: each generator gives a struct (start, ref, alt) on a sequence, drawn from a seed's hash.

Positions are 0-based. Draws are hashes of (seed, place), so reruns agree on any partitioning. A generator that finds no room
gives null.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.sequence import reverse_complement

_NEXT = "CGTA"


def random_bases(seed: Column, size: Column | int) -> Column:
    """size letters dealt by hash."""
    size = F.lit(size) if isinstance(size, int) else size
    dealt = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substr(F.lit("ACGT"), (F.pmod(F.xxhash64(seed, i), F.lit(4)) + 1).cast("int"), F.lit(1)))
    return F.when(size > 0, F.array_join(dealt, "")).otherwise("")


def _piece(seq: Column, at: Column, size: Column) -> Column:
    return F.substr(seq, at + 1, size)


def _made(seq: Column, at: Column, size: Column, ref: Column, alt: Column) -> Column:
    fits = (at >= 0) & (size > 0) & (at + size <= F.length(seq))
    return F.when(fits & (ref != alt), F.struct(at.cast("long").alias("start"), ref.alias("ref"), alt.alias("alt")))


def snv(seq: Column, at: Column, seed: Column) -> Column:
    """Another letter of the four at one place."""
    ref = F.upper(_piece(seq, at, F.lit(1)))
    others = F.array_remove(F.array(*map(F.lit, "ACGT")), ref)
    return _made(seq, at, F.lit(1), ref, F.element_at(others, (F.pmod(F.xxhash64(seed, at), F.lit(3)) + 1).cast("int")))


def insertion(seq: Column, at: Column, size: Column, seed: Column) -> Column:
    """Dealt letters after one place."""
    ref = _piece(seq, at, F.lit(1))
    return _made(seq, at, F.when(size > 0, 1), ref, F.concat(ref, random_bases(seed, size)))


def deletion(seq: Column, at: Column, size: Column) -> Column:
    """size letters after one place go."""
    return _made(seq, at, F.when(size > 0, size + 1), _piece(seq, at, size + 1), _piece(seq, at, F.lit(1)))


def inversion(seq: Column, at: Column, size: Column) -> Column:
    ref = _piece(seq, at, size)
    return _made(seq, at, size, ref, reverse_complement(ref))


def substitution(seq: Column, at: Column, size: Column) -> Column:
    """size letters, each by the next in the order A, C, G, T, A: every place differs."""
    ref = F.upper(_piece(seq, at, size))
    return _made(seq, at, size, ref, F.translate(ref, "ACGT", _NEXT))


def duplication(seq: Column, at: Column, size: Column) -> Column:
    """size letters twice."""
    ref = _piece(seq, at, size)
    return _made(seq, at, size, ref, F.concat(ref, ref))


def repeat_units(seq: Column, at: Column, size: Column) -> Column:
    """Copies of the unit (size letters at a place) that follow one another there."""
    unit, rest = _piece(seq, at, size), F.substr(seq, at + 1, F.length(seq))
    most = F.floor(F.length(rest) / F.nullif(size, F.lit(0))).cast("int")
    steps = F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0)))
    return F.aggregate(steps, F.lit(0), lambda acc, i: F.when((acc == i) & (F.substr(rest, i * size + 1, size) == unit), i + 1).otherwise(acc))


def repeat_expansion(seq: Column, at: Column, size: Column, more: Column | int) -> Column:
    """A run of at least two copies of a unit, `more` copies longer."""
    n, unit = repeat_units(seq, at, size), _piece(seq, at, size)
    more = F.lit(more) if isinstance(more, int) else more
    return F.when(n >= 2, _made(seq, at, n * size, F.repeat(unit, n), F.repeat(unit, n + more)))


def repeat_contraction(seq: Column, at: Column, size: Column, fewer: Column | int) -> Column:
    """A run of at least two copies of a unit, `fewer` copies shorter, at least one left."""
    n, unit = repeat_units(seq, at, size), _piece(seq, at, size)
    fewer = F.lit(fewer) if isinstance(fewer, int) else fewer
    return F.when(n >= 2, _made(seq, at, n * size, F.repeat(unit, n), F.repeat(unit, F.greatest(n - fewer, F.lit(1)))))


def applied(seq: Column, variant: Column) -> Column:
    """The sequence with a variant in it; itself for a null variant."""
    out = F.concat(F.substr(seq, F.lit(1), variant["start"].cast("int")), variant["alt"], F.substr(seq, (variant["start"] + F.length(variant["ref"]) + 1).cast("int"), F.length(seq)))
    return F.when(variant.isNull(), seq).otherwise(out)


def apply_all(seqs: DataFrame, variants: DataFrame, name: str) -> DataFrame:
    """(name, seq): each sequence with its variants (name, start, ref, alt); of variants that overlap, the first stays.

    Order is by start, then ref and alt. A contig's variants meet in one row beside its sequence.
    """
    own = variants.groupBy(name).agg(F.array_sort(F.collect_set(F.struct("start", "ref", "alt"))).alias("_v"))
    rows = seqs.join(own, name, "left")
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, v: Column) -> Column:
        between = F.substr(F.col("seq"), (acc["at"] + 1).cast("int"), (v["start"] - acc["at"]).cast("int"))
        taken = F.struct(F.concat(acc["out"], between, v["alt"]).alias("out"), (v["start"] + F.length(v["ref"])).cast("long").alias("at"))
        return F.when(v["start"] >= acc["at"], taken).otherwise(acc)

    made = F.aggregate(F.coalesce("_v", F.array().cast("array<struct<start:bigint,ref:string,alt:string>>")), empty, step)
    return rows.withColumn("_m", made).select(name, F.concat("_m.out", F.substr("seq", (F.col("_m.at") + 1).cast("int"), F.length("seq"))).alias("seq"))


def crossovers(kmers: DataFrame, first: str, second: str, count: int, seed: int = 0) -> DataFrame:
    """(chr, pos0, pos1): up to `count` places a chromosome where two parents may cross.

    kmers are (chr, parent, km, pos); a place is a k-mer that each parent has once. The places of least hash are taken, then
    those that would go back in the second parent are left out.
    """
    once = kmers.where(F.col("parent").isin(first, second)).groupBy("chr", "km").agg(*[F.count(F.when(F.col("parent") == p, 1)).alias(f"n{i}") for i, p in enumerate((first, second))], *[F.max(F.when(F.col("parent") == p, F.col("pos"))).alias(f"pos{i}") for i, p in enumerate((first, second))]).where("n0 = 1 and n1 = 1")
    rank = F.row_number().over(Window.partitionBy("chr").orderBy(F.xxhash64(F.lit(seed), "km"), "km"))
    few = once.withColumn("_r", rank).where(F.col("_r") <= count)
    order = Window.partitionBy("chr").orderBy("pos0").rowsBetween(Window.unboundedPreceding, -1)
    return few.withColumn("_m", F.max("pos1").over(order)).where("_m is null or pos1 > _m").select("chr", "pos0", "pos1")


def recombined(first: DataFrame, second: DataFrame, places: DataFrame) -> DataFrame:
    """(chr, seq): chromosomes that start in the first parent and change sides at each place. Letters are upper case from
    the first parent and lower case from the second, as `contigs.case_runs` reads them."""
    at = places.groupBy("chr").agg(F.array_sort(F.collect_list(F.struct("pos0", "pos1"))).alias("_p"))
    rows = first.select("chr", F.upper("seq").alias("_a")).join(second.select("chr", F.lower("seq").alias("_b")), "chr").join(at, "chr", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, p: Column) -> Column:
        here = F.when(acc["side"] == 0, p["pos0"]).otherwise(p["pos1"])
        text = F.when(acc["side"] == 0, F.col("_a")).otherwise(F.col("_b"))
        piece = F.substr(text, (acc["at"] + 1).cast("int"), (here - acc["at"]).cast("int"))
        return F.struct(F.concat(acc["out"], piece).alias("out"), (1 - acc["side"]).alias("side"), F.when(acc["side"] == 0, p["pos1"]).otherwise(p["pos0"]).cast("long").alias("at"))

    made = F.aggregate(F.coalesce("_p", F.array().cast("array<struct<pos0:bigint,pos1:bigint>>")), start, step)
    rest = F.substr(F.when(F.col("_m.side") == 0, F.col("_a")).otherwise(F.col("_b")), (F.col("_m.at") + 1).cast("int"), F.greatest(F.length("_a"), F.length("_b")))
    return rows.withColumn("_m", made).select("chr", F.concat("_m.out", rest).alias("seq"))

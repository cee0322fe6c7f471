"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same number of copies, target / size of the source. Whole copies are certain;
the fractions are paired, and words move at random from one to the other until one is 0 or 1 (in expectation nothing
moves, and the source's expected words stay as they are). Each bin of a source reduces to one open fraction, and the open
fractions of a level are the documents of the next: a reduction tree that ends with one open fraction a source.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import U, mix, runs
from kmerloom.plans.runtime import cut

#: Documents of a bin on average.
BIN = 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, docs) -> the same and target.

    Sources in code point order, null last, take the weights in turn and share `share` times all sizes; none gets more than
    cap times its own, and what is over goes to the others by weight. One row a source is all that is sorted.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    filled = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, onward = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share
    rows = rows.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    level = F.min_by(F.when(F.col("_level") < F.col("_ratio"), F.col("_level")), F.when(F.col("_level") < F.col("_ratio"), F.struct("_ratio", "_level")))
    rows = rows.withColumn("_fill", level.over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("source", "source_size", "docs", F.least("_cap", F.coalesce(F.col("_fill") * F.col("_w"), F.col("_cap"))).alias("target"))


def _uniform(a: int, b: int, salt: int) -> float:
    return int(mix(np.array([a & (2**64 - 1)], U) ^ mix(np.array([(b + salt) & (2**64 - 1)], U)))[0]) / 2**64


def transfer(p: float, a: float, q: float, b: float, u: float) -> tuple[float, float]:
    """Fractions p and q of documents of a and b words after one random move that keeps p a + q b; one of them is 0 or 1."""
    up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
    if u * (up + down) < down:  # p grows with chance down / (up + down)
        return (1.0, q - up / b) if (1 - p) * a <= q * b else (p + up / a, 0.0)
    return (0.0, q + down / b) if p * a <= (1 - q) * b else (p - down / a, 1.0)


def _reduce(seed: int, last: bool):
    names = ["id", "size", "source", "source_size", "target", "base", "frac", "bin", "bins", "open"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        key = None

        def settle(row: dict) -> dict:
            if last:
                row["frac"], row["open"] = float(_uniform(row["id"] or 0, row["size"], seed) < row["frac"]), False
            return row

        for table, _ in runs(batches, "key", 8192):
            out = []
            for row in table.to_pylist():
                own = row.pop("key")
                if own != key:
                    if held is not None:
                        out.append(settle(held))
                    held, key = None, own
                row["open"] = 0 < row["frac"] < 1 and row["size"] > 0
                if not row["open"]:
                    row["frac"] = float(row["frac"] >= 1)
                    out.append(row)
                elif held is None:
                    held = row
                else:
                    u = _uniform(held["id"] or 0, (row["id"] or 0) * 31 + row["size"], seed)
                    held["frac"], row["frac"] = transfer(held["frac"], held["size"], row["frac"], row["size"], u)
                    done, held = (held, row) if held["frac"] in (0.0, 1.0) else (row, held)
                    done["open"] = False
                    out.append(done)
                    if held["frac"] < 1e-12 or held["frac"] > 1 - 1e-12:
                        held["frac"], held["open"] = float(round(held["frac"])), False
                        out.append(held)
                        held = None
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types)], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([settle(held)[n]], t) for n, t in zip(names, types)], names=names)

    return kernel


_SCHEMA = "id long, size long, source string, source_size long, target double, base long, frac double, bin long, bins long, open boolean"


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 3,
) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, copies.

    size counts the words of the text (runs between ASCII white space; null: 0). A source's copies times sizes sum to its
    target but for the last open fraction, at most one document. Documents pair from large to small, so that one is small.
    No document has more than `cap` copies. Rows of size 0 have the whole copies only. A null source is a source; null ids
    and repeated rows are rows as any other, and of rows equal in id, size and source it is left open which is taken. The
    draws hash ids, which are whole numbers, so reruns agree. Other columns are not read. An empty table gives no rows.
    """
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), words(F.col(text_col)).alias("size"), F.col(source_col).alias("source")), "sizes")
    return _mix(rows, weights, share, cap, seed).withColumnsRenamed({"id": id_col, "source": source_col})


def _mix(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 3) -> DataFrame:
    """mix_sources for written rows of (id, size, source)."""
    key = F.struct(F.col("source").isNull().alias("n"), F.col("source"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = cut(source_targets(sizes, list(weights), share, cap), "targets").withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_rate", F.least(rate, F.lit(float(cap))))
    rows = rows.withColumn("base", F.floor("_rate").cast("long")).withColumn("frac", F.col("_rate") - F.floor("_rate"))
    rows = rows.withColumn("bins", F.ceil(F.col("docs") / BIN)).withColumn("bin", F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.col("bins")))
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]
    rows, done, level = rows.select(*columns[:-1]), [], 0
    most = targets.agg(F.max(F.ceil(F.col("docs") / BIN))).first()[0] or 1
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        keyed = rows.withColumn("key", F.xxhash64(F.lit(level), key, "bin")).repartition(parts, "key").sortWithinPartitions("key", F.desc("size"), "id")
        found = cut(keyed.mapInArrow(_reduce(seed + level, most == 1), _SCHEMA), f"level{level}")
        done.append(found.where("not open"))
        if most == 1:
            break
        most, level = -(-most // BIN), level + 1
        rows = found.where("open").select(*columns[:-3], F.pmod(F.col("bin"), F.ceil(F.col("bins") / BIN)).alias("bin"), F.ceil(F.col("bins") / BIN).alias("bins"))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out.select("id", "size", "source", "source_size", "target", (F.col("base") + F.col("frac").cast("long")).alias("copies"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row repeated as often as the mix says; columns as they were, whatever their names.

    Rows of one id, source and size are drawn together, as one document of their common size, so that texts meet their
    copies in one exchange by a hash of these three. Null ids, null sources and null texts (size 0) are values as any other.
    """
    key = F.xxhash64("id", "size", F.col("source").isNull(), "source")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), words(F.col(text_col)).alias("size"), F.col(source_col).alias("source"))
    named = named.withColumn("key", key)
    alike = named.groupBy("key", "id", "size", "source").agg(F.count("*").alias("n"))
    alike = cut(alike.select(F.col("key").alias("id"), (F.col("size") * F.col("n")).alias("size"), "source"), "alike")
    made = _mix(alike, **options).where("copies > 0").select(F.col("id").alias("made"), "copies")
    joined = named.join(made.hint("merge"), F.col("key") == F.col("made"))  # copies grow with the rows: never broadcast, whatever the size
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"row.`{c}`") for c in docs.columns])

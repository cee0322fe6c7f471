"""Embedding near-duplicates by p-stable hashing for the Euclidean distance.

Vectors are scaled to length 1, where cosine c is the distance sqrt(2 - 2c). A table's key is the vector's Gaussian
projections, shifted and quantised to cells. Rows of one cell are compared on 256 signs of further projections; of the pairs
found, those whose cosine shows them near make candidate components, and inside these every pair gets an exact cosine in
double precision.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import U, constants, mix
from kmerloom.llm.near import BLOCK, LEADERS, bucket_links, exact_links, found_edges, sized, tiles
from kmerloom.plans.components import components
from kmerloom.plans.runtime import cut, release

#: Width of a cell, signs of a sketch.
CELL, BITS = 2.0, 256
#: Strangers that a cell holds on average: the number of projections a key follows from it. A row of a further table costs
#: about as much as a hundred comparisons of sketches.
STRANGERS = 128.0
#: Bits of a sketch for each radian, and the angles, beyond that of a link, within which a row stands for its neighbours and
#: within which a pair is kept as a candidate edge.
PER_RADIAN, NEAR, SLACK = BITS / math.pi, 0.2, 0.35


def meet(distance: float) -> float:
    """The chance that one quantised projection agrees for two points at this distance."""
    r = CELL / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(rows: int, cosine: float, recall: float) -> tuple[int, int]:
    """(projections a key, tables): keys so long that STRANGERS of `rows` orthogonal vectors share a cell, as many tables
    as a pair at the threshold needs to meet with chance `recall`."""
    k = max(1, math.ceil(math.log(max(rows, 2) / STRANGERS) / -math.log(meet(math.sqrt(2)))))
    return k, math.ceil(math.log(1 - recall) / math.log1p(-(meet(math.sqrt(2 - 2 * cosine)) ** k)))


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit rows in double precision) of the vectors that are neither null nor zero nor hold null, NaN or infinity."""
    places, rows = [], []
    for i, x in enumerate(vectors):
        if x is None or any(v is None for v in x):
            continue
        x = np.asarray(x, np.float64)
        top = np.abs(x).max(initial=0)
        if top > 0 and np.isfinite(top):
            x = x / top
            places.append(i)
            rows.append(x / math.sqrt(float(x @ x)))
    return np.array(places, np.int64), rows


def _projections(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def _node(row: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b((row + 0.0).tobytes(), digest_size=8).digest(), "big", signed=True)


def _signatures(k: int, tables: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        salt = constants(k, 41) | U(1)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                n = batch.num_rows
                node, sketch, vector, paths = [None] * n, [None] * n, [None] * n, [None] * n
                places, rows = unit(batch.column("vector").to_pylist())
                for dim in {len(x) for x in rows}:
                    use = [i for i, x in enumerate(rows) if len(x) == dim]
                    data = np.stack([rows[i] for i in use])
                    if dim not in made:
                        shift = np.random.default_rng([7, dim]).random(k * tables) * CELL
                        made[dim] = _projections(dim, k * tables, 1), shift, _projections(dim, BITS, 2)
                    dirs, shift, planes = made[dim]
                    cells = np.floor((data @ dirs + shift) / CELL).astype(np.int64).view(U).reshape(len(use), tables, k)
                    keys = mix(np.arange(tables, dtype=U) * U(0x9E3779B97F4A7C15) + U(dim))[None, :]
                    keys = mix(keys + (mix(cells + U(1 << 32)) * salt).sum(axis=2, dtype=U))
                    signs = np.packbits(data @ planes > 0, axis=1)
                    for j, i in enumerate(use):
                        p = int(places[i])
                        node[p], sketch[p], vector[p], paths[p] = _node(data[j]), signs[j].tobytes(), data[j].tobytes(), keys[j].view(np.int64)
                cols = [pa.array(node, pa.int64()), pa.array(sketch, pa.binary()), pa.array(vector, pa.binary()), pa.array(paths, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], names=["id", "node", "sketch", "unit", "paths"])

    return kernel


def cosines(threshold: float):
    def compare(left: list, right: list) -> np.ndarray:
        a, b = ([np.frombuffer(x[0], np.float64) for x in side] for side in (left, right))
        hit = np.zeros((len(a), len(b)), bool)
        for dim in {len(x) for x in a}:
            i, j = ([n for n, x in enumerate(side) if len(x) == dim] for side in (a, b))
            if i and j:
                hit[np.ix_(i, j)] = np.stack([a[n] for n in i]) @ np.stack([b[n] for n in j]).T >= threshold
        return hit

    return compare


def _near_enough(least: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, np.float64) for x in batch.column(c).to_pylist()] for c in ("a", "b"))
            keep = pa.array([len(x) == len(y) and float(x @ y) >= least for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("u", "v")], names=["u", "v"])

    return kernel


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = 0.995) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Two rows are linked if their cosine, in double precision, is at least `cosine`; n_links counts the other rows linked to
    a row; component_id is the least id reachable; kept marks the row of that id. Vectors that are null, empty or zero or
    hold null or non-finite components, and vectors of unlike lengths, link with nothing. Equal vectors are one node, so
    copies cost nothing; repeated rows count each. Null ids get a negative id made from the vector. Ids are whole numbers.
    Other columns are not read; an empty table gives no rows. `recall` is the least chance that a pair exactly at the
    threshold shares a cell. A cell with over LEADERS unlike rows is compared in tiles of that size, so none is left out.
    """
    own_id = F.coalesce(F.col(id_col).cast("long"), -F.abs(F.xxhash64(F.lit("no id"), F.col(vector_col)) % F.lit(1 << 61)) - F.lit(1 << 61))
    source = vectors.select(own_id.alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    k, tables = shape(vectors.count(), cosine, recall)
    marked = cut(source.mapInArrow(_signatures(k, tables), "id long, node long, sketch binary, unit binary, paths array<long>"), "signatures")
    classes = cut(
        marked.where("node is not null").groupBy("node")
        .agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("sketch").alias("sketch"), F.first("unit").alias("unit"), F.first("paths").alias("paths")),
        "classes",
    )
    angle = math.acos(cosine)
    near, far = math.floor(PER_RADIAN * NEAR), math.ceil(PER_RADIAN * (angle + NEAR) + 4.5 * math.sqrt(PER_RADIAN * angle))
    rows = classes.select(F.explode("paths").alias("path"), F.col("node").alias("id"), "sketch")
    level = cut(bucket_links(rows, BITS // 64, near, far, LEADERS), "level")
    crowded = level.where("v is null").select("path", F.col("u").alias("id")).join(classes.select(F.col("node").alias("id"), "sketch"), "id")
    dealt = tiles(sized(crowded, "path", LEADERS), "path").select(F.col("tile").alias("path"), "id", "sketch")
    rest = cut(bucket_links(dealt, BITS // 64, near, far), "rest")
    units = classes.select("node", "unit")
    ends = found_edges([level, rest]).join(units.withColumnsRenamed({"node": "u", "unit": "a"}), "u").join(units.withColumnsRenamed({"node": "v", "unit": "b"}), "v")
    edges = ends.select("u", "v", "a", "b").mapInArrow(_near_enough(math.cos(min(math.pi, angle + SLACK))), "u long, v long")
    comps = cut(sized(components(edges).withColumnsRenamed({"node": "id", "component": "comp"}), "comp", BLOCK), "candidates")
    members = comps.join(classes.select(F.col("node").alias("id"), "weight", "unit"), "id")
    links, trees = exact_links(members, cosines(cosine), ["unit"])
    nodes = classes.select("node", "rep", "weight").join(links.withColumnRenamed("id", "node"), "node", "left").join(components(trees), "node", "left")
    nodes = cut(nodes.withColumn("component", F.coalesce("component", "node")), "nodes")
    least = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    nodes = nodes.join(least, "component").select("node", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = cut(marked.select("id", "node").join(nodes, "node", "left").withColumn("component_id", F.coalesce("component_id", "id")), "linked")
    release(marked, classes, level, rest, comps)
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))

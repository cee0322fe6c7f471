"""N-gram Jaccard join by chosen paths.

Every document is the set of its five-word shingles. In each run, a set descends from the root by every one of its
shingles whose hash at the node falls below 1 / (0.8 |set|): two sets of similarity 0.8 share one child a level on
average, unlike sets share fewer. The first levels need no look at the data, so each document finds its own paths.
Small buckets are brute-forced on 256-bit sketches. In a bucket with too many groups of unlike rows the recursion starts again
from its node: as many runs of further levels as the recall needs, so a pair that meets there is lost below with no more chance
than at the root. What is still crowded at the last level, or holds very many rows that are alike, which further levels would
not take apart, is compared block by block. Candidates make components, and inside these every pair of distinct sets is
compared exactly.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import U, constants, id_key, mix, shingles
from kmerloom.llm.near import BLOCK, DENSE, LEADERS, bucket_links, exact_links, found_edges, sized, tiles
from kmerloom.plans.components import components
from kmerloom.plans.runtime import cut, release

#: Levels of a descent, and how often a crowded bucket starts a further one.
FIRST, AGAIN = 3, 2
BITS = 256
#: Bits that may differ: below NEAR a row stands for its neighbours, above FAR two rows are unlike.
#: One bit in ten differs at a similarity of 0.8; deviations are 4 bits with 256 shingles or more, about 6 with few.
NEAR, FAR = 13, 58
_CHILD = U(0x632BE59BD9B4E019)
_TRIES = np.array([[int(x) for x in mix(np.arange(32, dtype=U) + U(1000 * i + 5)) % U(BITS)] for i in range(BITS)])
_ORDERS = np.array([np.argsort(mix(np.arange(BITS, dtype=U) + U(99_991 * i + 17))) for i in range(BITS)])
_EDGES = np.arange(BITS, dtype=U) << U(56)


def survival(levels: int) -> float:
    """The chance that two sets at the threshold still share a path after so many levels of one run (mean one child)."""
    lost = 0.0
    for _ in range(levels):
        lost = math.exp(lost - 1)
    return 1 - lost


def needed_runs(recall: float, levels: int = FIRST) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(levels)))


def descend(paths: np.ndarray, tokens: np.ndarray, threshold: float) -> np.ndarray:
    """The children of the paths by one set: a token is sampled at a node by a hash that all sets share."""
    if not len(paths) or not len(tokens):
        return np.empty(0, U)
    most = min(1 / (threshold * len(tokens)), 1.0)
    bound = U(min(int(most * 2**64), 2**64 - 1))
    step = max(1, (1 << 18) // len(paths))
    found = []
    for i in range(0, len(tokens), step):
        drawn = mix(paths[:, None] ^ tokens[None, i : i + step])
        found.append(mix(drawn[drawn <= bound] ^ _CHILD))
    return np.concatenate(found)


def sketch(tokens: np.ndarray) -> bytes:
    """One bit from the least hash of each of 256 bins (tokens are sorted hashes); empty bins borrow from others by a fixed order."""
    at = np.searchsorted(tokens, _EDGES)
    full = at < np.append(at[1:], len(tokens))
    use = np.arange(BITS)
    if not full.all():
        empty = np.flatnonzero(~full)
        ok = full[_TRIES[empty]]
        first = ok.argmax(axis=1)
        use[empty] = _TRIES[empty, first]
        for i in empty[~ok.any(axis=1)].tolist():
            use[i] = _ORDERS[i][full[_ORDERS[i]].argmax()]
    bits = (mix(tokens[at[use]] ^ _TRIES_SALT) & U(1)).astype(np.uint8)
    return np.packbits(bits).tobytes()


_TRIES_SALT = constants(BITS, 77)


def digest(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


def _signatures(roots: np.ndarray, threshold: float, width: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        for batch in batches:
            out = []
            for text in batch.column("text"):
                tokens = shingles(text.as_py(), width)
                if not len(tokens):
                    out.append((None, 0, None, None))
                    continue
                paths = roots
                for _ in range(FIRST):
                    paths = descend(paths, tokens, threshold)
                out.append((digest(tokens), len(tokens), sketch(tokens), paths.view(np.int64)))
            cols = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), *cols], names=["id", "hash", "node", "n", "sketch", "paths"])

    return kernel


def _deeper(threshold: float, width: int, salts: np.ndarray):
    """Paths of further levels from each held path: one run for each salt."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, node, bits = [], [], []
            for text, own, held in zip(*(batch.column(c).to_pylist() for c in ("text", "node", "paths")), strict=True):
                tokens = shingles(text, width)
                if digest(tokens) != own:
                    continue  # another text under the same id
                found = mix(np.array(held, np.int64).view(U)[:, None] ^ salts[None, :]).ravel()
                for _ in range(FIRST):
                    found = descend(found, tokens, threshold)
                path.append(found.view(np.int64))
                node += [own] * len(found)
                bits += [sketch(tokens)] * len(found)
            path = np.concatenate(path) if path else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary())], names=["path", "id", "sketch"])

    return kernel


def _tokens(width: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, data = [], []
            for i, (text, own) in enumerate(zip(batch.column("text").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                tokens = shingles(text, width)
                if digest(tokens) == own:
                    keep.append(i)
                    data.append(tokens.tobytes())
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("node", "weight", "comp", "many")), pa.array(data, pa.binary())], names=["id", "weight", "comp", "many", "tokens"])

    return kernel


def similar(threshold: float):
    """The matrix of Jaccard similarity >= threshold of two lists of token sets, exact in integers."""
    up, down = int(round(threshold * 10_000)), 10_000

    def compare(left: list, right: list) -> np.ndarray:
        a, b = ([np.frombuffer(x[0], U) for x in side] for side in (left, right))
        na, nb = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        values, where = np.unique(np.concatenate([*a, *b]), return_inverse=True)
        cut_at = int(na.sum())
        both = np.intersect1d(where[:cut_at], where[cut_at:])
        place = np.full(len(values), -1, np.int64)
        place[both] = np.arange(len(both))
        rows_a, cols_a = np.repeat(np.arange(len(a)), na), place[where[:cut_at]]
        rows_b, cols_b = np.repeat(np.arange(len(b)), nb), place[where[cut_at:]]
        shared = np.zeros((len(a), len(b)), np.float64)
        step = 8192
        order_a, order_b = np.argsort(cols_a, kind="stable"), np.argsort(cols_b, kind="stable")
        cols_a, rows_a, cols_b, rows_b = cols_a[order_a], rows_a[order_a], cols_b[order_b], rows_b[order_b]
        for lo in range(0, len(both), step):
            hi = min(lo + step, len(both))
            x, y = np.zeros((len(a), hi - lo), np.float32), np.zeros((len(b), hi - lo), np.float32)
            i, j = np.searchsorted(cols_a, [lo, hi])
            x[rows_a[i:j], cols_a[i:j] - lo] = 1
            i, j = np.searchsorted(cols_b, [lo, hi])
            y[rows_b[i:j], cols_b[i:j] - lo] = 1
            shared += x @ y.T
        shared = shared.round().astype(np.int64)
        return (shared > 0) & (shared * down >= (na[:, None] + nb[None, :] - shared) * up)

    return compare


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, width: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """(marked, nodes): every row with its node, and every node (a distinct shingle set) with rep, weight, links and component.

    rep is the least (id, hash of the text) of the node's rows."""
    source = docs.select(id_key(id_col, text_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    roots = constants(needed_runs(recall), 31)
    marked = cut(source.mapInArrow(_signatures(roots, threshold, width), "id long, hash long, node long, n int, sketch binary, paths array<long>"), "signatures")
    classes = cut(
        marked.where("node is not null").groupBy("node")
        .agg(F.min(F.struct("id", "hash")).alias("rep"), F.count("*").alias("weight"), F.max("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")),
        "classes",
    )
    texts = source.withColumn("rep", F.struct("id", "hash")).select("rep", "text")
    levels = [cut(bucket_links(classes.select(F.explode("paths").alias("path"), F.col("node").alias("id"), "sketch"), BITS // 64, NEAR, FAR, LEADERS), "level")]
    for again in range(1, AGAIN + 1):
        crowded = levels[-1].where("v is null and not dense").select("path", F.col("u").alias("node"))
        if crowded.isEmpty():
            break
        held = crowded.groupBy("node").agg(F.collect_set("path").alias("paths"))
        asked = texts.join(held.join(classes.select("node", "rep"), "node").hint("merge"), "rep").select("text", "node", "paths")
        salts = constants(needed_runs(recall), 1000 + again)
        rows = cut(asked.mapInArrow(_deeper(threshold, width, salts), "path long, id long, sketch binary").distinct(), "deeper")
        levels.append(cut(bucket_links(rows, BITS // 64, NEAR, FAR, LEADERS), "level"))
        release(rows)
    crowded = [(levels[-1].where("v is null and not dense"), LEADERS), *((x.where("v is null and dense"), DENSE) for x in levels)]
    for rows, size in crowded:
        if not rows.isEmpty():
            rows = sized(rows.select("path", F.col("u").alias("id")), "path", size).join(classes.select(F.col("node").alias("id"), "sketch"), "id")
            levels.append(cut(bucket_links(tiles(rows, "path").select(F.col("tile").alias("path"), "id", "sketch"), BITS // 64, NEAR, FAR), "level"))
    comps = components(found_edges(levels)).withColumnsRenamed({"node": "id", "component": "comp"})
    comps = comps.join(classes.select(F.col("node").alias("id"), "rep", "weight", (F.col("n") * 8).cast("long").alias("bytes")), "id")
    comps = cut(sized(comps, "comp", BLOCK), "candidates")
    asked = comps.select("rep", F.col("id").alias("node"), "weight", "comp", "many").hint("merge")  # they grow with the texts: never broadcast, whatever the size
    asked = texts.join(asked, "rep").select("text", "node", "weight", "comp", "many")
    links, trees = exact_links(asked.mapInArrow(_tokens(width), "id long, weight long, comp long, many int, tokens binary"), similar(threshold), ["tokens"])
    nodes = classes.select("node", "rep", "weight").join(links.withColumnRenamed("id", "node"), "node", "left").join(components(trees), "node", "left")
    nodes = cut(nodes.withColumn("component", F.coalesce("component", "node")), "nodes")
    least = nodes.groupBy("component").agg(F.min("rep").alias("least"))
    nodes = nodes.join(least, "component").select("node", "rep", "least", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    marked_only = cut(marked.select("id", "hash", "n", "node"), "marked")
    nodes = cut(nodes, "nodes")
    release(marked, classes, comps, *levels)
    return marked_only, nodes


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, recall: float = 0.995) -> DataFrame:
    """One row per input row: id, n_shingles, class_id, n_links, component_id.

    Rows with equal shingle sets are one class (class_id: its least id); a link joins two rows whose sets have a Jaccard
    similarity of at least `threshold`; n_links counts the other rows linked to a row, those of its own class included;
    component_id is the least id reachable by links. Words lie between ASCII white space and ASCII letters count without
    case; a text of fewer words than `width` is one shingle. A null, empty or blank text has no shingle: it links with
    nothing and is its own class. Null ids take part under a negative id made from the text; other ids are whole numbers.
    Repeated rows count each; rows that share an id but not a text are separate nodes. An empty table gives no rows. Other
    columns are not read. `recall` is the least chance that a pair exactly at the threshold meets in some bucket; likelier
    ones meet more often.
    """
    marked, nodes = _classes(docs, id_col, text_col, threshold, width, recall)
    out = marked.join(nodes, "node", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep.id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least.id", "id").alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, recall: float = 0.995) -> DataFrame:
    """docs without all rows but the one of least (id, hash of the text) of each component of jaccard_join; columns as they were.

    Rows without a shingle stay; rows equal in id and text become one (which one, if their other columns differ, is left
    open); unlike texts under one id both stay. Columns of any name pass through. An empty table gives no rows.
    """
    marked, nodes = _classes(docs, id_col, text_col, threshold, width, recall)
    alone = marked.where("node is null").select("id", "hash")
    kept = nodes.select("least.id", "least.hash").union(alone).distinct().toDF("kept_id", "kept_hash")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_key(id_col, text_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    out = rows.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi").dropDuplicates(["id", "hash"])
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])


__all__ = ["descend", "jaccard_join", "keep_one", "needed_runs", "similar", "sketch", "survival"]

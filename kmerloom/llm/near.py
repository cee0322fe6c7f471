"""Candidate links inside buckets of binary sketches, and exact links inside candidate components."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import U, runs
from kmerloom.plans.components import components
from kmerloom.plans.runtime import cut, release

#: Groups of unlike rows that a bucket may hold before it is split further, and rows kept before it is compared in tiles.
LEADERS, DENSE = 2048, 16384
#: Rows of a bucket that is compared as one matrix; rows of a bucket whose pairs are listed for all such buckets at once.
MATRIX, TINY = 512, 12
#: Members and payload bytes of a block; blocks of one component are compared two at a time.
BLOCK, BYTES = 256, 8 << 20


class Bucket:
    """Leaders of a bucket of many rows. A row within `near` bits of a leader is not kept: by the triangle inequality whatever
    is linked to it lies within `far` bits of that leader. Edges join rows within `far`, one for each merge of two trees,
    from the row to the nearest leader of the tree. `trees` counts the groups that no edge joins: further runs take these
    apart, but not the rows of one group."""

    def __init__(self, width: int, near: int, far: int, limit: int | None, most: int):
        self.near, self.far, self.limit, self.most = near, far, limit, most
        self.ids, self.tree, self.sketch = np.empty(64, np.int64), np.empty(64, np.int64), np.empty((width, 64), U)
        self.count, self.trees, self.full = 0, 0, False

    def add(self, row: int, sketch: np.ndarray, edges: list) -> None:
        n = self.count
        away = np.zeros(n, np.uint16)
        for own, bits in zip(self.sketch, sketch):
            away += np.bitwise_count(own[:n] ^ bits)
        close, first = np.flatnonzero(away <= self.far), n
        if len(close):
            tree, nearest = self.tree[close], close[away[close].argmin()]
            first, heads = tree.min(), [nearest]
            if (tree != first).any():
                order = np.argsort(away[close], kind="stable")
                _, at = np.unique(tree[order], return_index=True)
                heads = close[order[at]]
                self.tree[:n][np.isin(self.tree[:n], tree)] = first
                self.trees -= len(heads) - 1
            edges.extend((int(x), row) for x in self.ids[heads] if x != row)
            if away[nearest] <= self.near:
                return
        else:
            self.trees += 1
        if n == len(self.ids):
            self.ids, self.tree, self.sketch = np.resize(self.ids, 2 * n), np.resize(self.tree, 2 * n), np.concatenate((self.sketch, self.sketch), axis=1)
        self.ids[n], self.tree[n], self.sketch[:, n], self.count = row, first, sketch, n + 1
        self.full = self.limit is not None and (self.trees > self.limit or self.count > self.most)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.frombuffer(b"".join(x.to_pylist()), U).reshape(-1, width) for x in parts]
    return np.concatenate(parts) if parts else np.empty((0, width), U)


def _tree(away: np.ndarray, far: int) -> list[tuple[int, int]]:
    """The edges of a least spanning forest of the pairs within `far`, by Prim's algorithm."""
    n, taken = len(away), np.iinfo(away.dtype).max
    best, source, out = np.full(n, taken - 1, away.dtype), np.zeros(n, np.int64), []
    for _ in range(n):
        i = int(best.argmin())
        if best[i] <= far:
            out.append((int(source[i]), i))
        best[i] = taken
        closer = (away[i] < best) & (away[i] <= far) & (best != taken)
        best[closer] = away[i][closer]
        source[closer] = i
    return out


def _pairs(sketch: np.ndarray, far: int) -> list[tuple[int, int]]:
    """All pairs of rows within `far` bits, or, where these are many, a least spanning forest of them."""
    bits = np.unpackbits(sketch.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    away = ((bits.shape[1] - bits @ bits.T) / 2).astype(np.int16)
    i, j = np.nonzero(np.triu(away <= far, 1))
    if len(i) <= 4 * len(sketch):
        return list(zip(i.tolist(), j.tolist()))
    return _tree(away, far)


def bucket_links(rows: DataFrame, width: int, near: int, far: int, limit: int | None = None) -> DataFrame:
    """rows (path long, id long, sketch binary) -> (path, u, v, dense): links of each bucket, at least a spanning forest of them by
    least distance, or (path, id, null, dense) for each row of a bucket with more than `limit` groups of unlike rows, or, where dense
    is true, with over DENSE rows to keep in fewer groups.

    Small buckets are compared whole. Larger ones stream through in the order of path; their memory is their leaders.
    """

    keep = DENSE

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = LEADERS if limit is None else limit
        held: Bucket | None = None
        at: int | None = None  # the path of held
        own: list[int] = []
        spilled = False
        over: list[tuple[int, int, bool]] = []
        edges: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            p, u, v = [x[0] for x in over] + [0] * len(edges), [x[1] for x in over] + [x[0] for x in edges], [None] * len(over) + [x[1] for x in edges]
            dense = pa.array([x[2] for x in over] + [False] * len(edges), pa.bool_())
            over.clear()
            edges.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (p, u, v)), dense], names=["path", "u", "v", "dense"])

        def stream(path: int, ids: np.ndarray, sketch: np.ndarray) -> None:
            nonlocal held, at, own, spilled
            if path != at:
                held, at, own, spilled = Bucket(width, near, far, None if limit is None else most, keep), path, [], False
            for x, bits in zip(ids.tolist(), sketch):
                if spilled:
                    over.append((path, x, held.trees <= most))
                    continue
                own.append(x)
                held.add(x, bits, edges)
                if held.full:
                    over.extend((path, y, held.trees <= most) for y in own)
                    spilled, own = True, []

        for table, whole in runs(batches, "path"):
            path, ids = table.column("path").to_numpy(), table.column("id").to_numpy()
            sketch = _matrix(table.column("sketch"), width)
            starts = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
            sizes = np.diff(np.append(starts, len(path)))
            streamed = (sizes > min(MATRIX, most)) | (path[starts] == at if at is not None else False) | (not whole)
            for size in range(2, TINY + 1):
                at_once = starts[(sizes == size) & ~streamed]
                for i in range(size if len(at_once) else 0):
                    for j in range(i + 1, size):
                        a, b = at_once + i, at_once + j
                        hit = (np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= far) & (ids[a] != ids[b])
                        edges.extend(zip(ids[a[hit]].tolist(), ids[b[hit]].tolist()))
            for s, n, by_row in zip(starts.tolist(), sizes.tolist(), streamed.tolist()):
                if by_row:
                    stream(int(path[s]), ids[s : s + n], sketch[s : s + n])
                elif n > TINY:
                    found = ((int(ids[s + i]), int(ids[s + j])) for i, j in _pairs(sketch[s : s + n], far))
                    edges.extend(x for x in found if x[0] != x[1])
                if len(over) + len(edges) > 100_000:
                    yield out()
        yield out()

    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return rows.repartition(int(parts), "path").sortWithinPartitions("path", "id").mapInArrow(kernel, "path long, u long, v long, dense boolean")


def sized(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with `many`: how many blocks of `size` rows, and of BYTES where rows have `bytes`, their key needs.

    Counts are made with map-side partial sums; join them to narrow rows, before payloads."""
    many = F.ceil(F.count("*") / size)
    if "bytes" in rows.columns:
        many = F.greatest(many, F.ceil(F.sum("bytes") / BYTES))
    counts = rows.groupBy(F.col(key).alias("_key")).agg(many.cast("int").alias("many"))
    return rows.join(counts, F.col(key) == F.col("_key")).drop("_key")


def tiles(rows: DataFrame, key: str) -> DataFrame:
    """Give each of the sized rows the `many` pairs of blocks that hold it; adds a, b, block and tile.

    Every two rows of a key meet in the one tile of their blocks."""
    held = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("many")).cast("int"))
    held = held.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    held = held.withColumn("a", F.least("block", "_other")).withColumn("b", F.greatest("block", "_other"))
    return held.withColumn("tile", F.xxhash64(F.lit(3), key, "a", "b")).drop("many", "_other")


def _least(hit: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of n rows reaches over the links hit[i, j] of left[i] and right[j]."""
    low = np.arange(n)
    while True:
        before = low.copy()
        low[right] = np.minimum(low[right], np.where(hit, low[left][:, None], n).min(axis=0))
        low[left] = np.minimum(low[left], np.where(hit, low[right][None, :], n).min(axis=1))
        low = low[low]
        if (low == before).all():
            return low


def exact_links(rows: DataFrame, compare: Callable[[list, list], np.ndarray], payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (id, weight, comp, many, *payload), sized by comp -> links (id, n_links) and trees (u, v).

    compare(left, right) gives the boolean matrix of links between two lists of payload rows. All pairs of a component are
    compared, block by block; what leaves a tile is one count a row and a star for each group, never its pairs.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        seen: set[int] = set()
        for table, whole in runs(batches, "tile", 2 * BLOCK):
            if not whole:  # one tile that repeated rows have made long: rows of an id count once
                ids = table.column("id").to_pylist()
                new = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
                held.append(table.take(new))
                continue
            table = pa.concat_tables([*held, table]).combine_chunks()
            held, seen = [], set()
            yield links(table)
        if held:
            yield links(pa.concat_tables(held).combine_chunks())

    def links(table: pa.Table) -> pa.RecordBatch:
        tile = table.column("tile").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
        got = []
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(tile)).tolist()):
            if e - s > 1:
                got += _tile(table.slice(s, e - s))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in range(3)], names=["u", "v", "n"])

    def _tile(table: pa.Table) -> list:
        cols = {c: table.column(c).to_pylist() for c in ("id", "weight", "block", "a", "b")}
        data = list(zip(*[table.column(c).to_pylist() for c in payload], strict=True))
        first = {}
        for i, x in enumerate(cols["id"]):
            first.setdefault(x, i)
        use = sorted(first.values())
        ids, weight = np.array(cols["id"])[use], np.array(cols["weight"])[use]
        block, a, b = np.array(cols["block"])[use], cols["a"][0], cols["b"][0]
        left = np.flatnonzero(block == a)
        right = left if a == b else np.flatnonzero(block == b)
        if not len(left) or not len(right):
            return []
        hit = compare([data[use[i]] for i in left], [data[use[i]] for i in right])
        counts = np.zeros(len(ids), np.int64)
        if a == b:
            np.fill_diagonal(hit, False)
            counts[left] = hit @ weight[left]
        else:
            counts[left] += hit @ weight[right]
            counts[right] += hit.T @ weight[left]
        out = [(int(ids[i]), None, int(counts[i])) for i in np.flatnonzero(counts)]
        low = _least(hit, left, right, len(ids))
        return out + [(int(ids[i]), int(ids[low[i]]), None) for i in np.flatnonzero(low != np.arange(len(ids)))]

    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = tiles(rows, "comp").repartition(int(parts), "tile").sortWithinPartitions("tile", "id")
    found = cut(dealt.select("tile", "id", "weight", "block", "a", "b", *payload).mapInArrow(kernel, "u long, v long, n long"), "links")
    links = found.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n_links"))
    return links, found.where("v is not null").select("u", "v")


def found_edges(levels: list[DataFrame]) -> DataFrame:
    """The distinct links (u, v), u < v, found in buckets."""
    edges = None
    for x in levels:
        x = x.where("v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        edges = x if edges is None else edges.union(x)
    return edges.distinct()


__all__ = ["BLOCK", "DENSE", "LEADERS", "bucket_links", "components", "exact_links", "found_edges", "release", "sized", "tiles"]

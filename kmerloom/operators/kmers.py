"""K-mers of whole sequences in Arrow kernels: one row a place, or counted by batch before the one shuffle.

A sequence of n letters takes n vectorised steps of numpy; nothing is parsed from text twice. k may be any number: packed
k-mers are words of at most 31 letters, 2 bits each, in order.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Letters of a word, and letters in work at a time.
WORD, SLICE = 31, 1 << 18
COLUMNS = ("pos", "km", "pb", "nb", "ck")
_CODE = np.full(256, 4, np.int8)
_TURN = np.arange(256, dtype=np.uint8)
for _i, (_a, _b) in enumerate(zip(b"ACGT", b"TGCA", strict=True)):
    _CODE[_a] = _CODE[_a + 32] = _i
    _TURN[_a] = _b
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_MASK = np.array([1, 2, 4, 8, 0], np.int32)


def _places(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of k-mers of A, C, G and T only, whether the reverse complement of each is the lesser)."""
    code = _CODE[data]
    bad = np.concatenate(([0], np.cumsum(code == 4)))
    n = len(data) - k + 1
    order = np.zeros(n, np.int8)
    for i in range((k + 1) // 2):
        order = np.where(order, order, np.sign(code[i : i + n] - (3 - code[k - 1 - i : k - 1 - i + n])))
    at = np.flatnonzero(bad[k:] == bad[:n])
    return at, order[at] > 0


def _texts(rows: np.ndarray) -> pa.Array:
    n, size = rows.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * size, max(size, 1), dtype=np.int32)[: n + 1]), pa.py_buffer(np.ascontiguousarray(rows)))


def _slices(value: bytes, k: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(first place, letters, letters before the first place, places) of the parts of a sequence."""
    data = _UPPER[np.frombuffer(value, np.uint8)]
    for at in range(0, len(data) - k + 1, SLICE):
        low, high = max(0, at - 1), min(len(data), at + SLICE + k)
        yield at, data[low:high], at - low, min(SLICE, len(data) - k + 1 - at)


def kmerize(seqs: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = (), columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """keep columns and, of `columns`: pos (0-based), km, the letters before (pb) and after (nb), and the canonical k-mer ck of
    every k-mer of A, C, G and T in any case.

    Sequences shorter than k and null ones have no k-mer; k-mers with other letters are left out.
    """
    wanted = [c for c in COLUMNS if c in columns]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in enumerate(batch.column(len(keep)).to_pylist()):
                if value is None or len(value) < k:
                    continue
                for first, data, lead, count in _slices(value, k):
                    at, flip = _places(data[lead : lead + count + k - 1], k)
                    at += lead
                    made = {"pos": pa.array((at + first - lead).astype(np.int32))}
                    windows = np.lib.stride_tricks.sliding_window_view(data, k)
                    if "km" in wanted or "ck" in wanted:
                        own = windows[at]
                        made["km"] = _texts(own)
                    if "ck" in wanted:
                        made["ck"] = _texts(np.where(flip[:, None], _TURN[own[:, ::-1]], own))
                    for name, step in (("pb", -1), ("nb", k)):
                        if name in wanted:
                            there = at + step
                            ok = (there >= 0) & (there < len(data))
                            made[name] = pc.if_else(pa.array(ok), _texts(data[np.where(ok, there, 0)][:, None]), pa.scalar(None, pa.string()))
                    held = [batch.column(i).take(pa.array(np.full(len(at), row, np.int32))) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*held, *(made[c] for c in wanted)], names=[*keep, *wanted])

    rows = seqs.select(*keep, F.col(seq).cast("string").cast("binary").alias("_s"))
    fields = [*rows.schema.fields[:-1], *(StructField(c, IntegerType() if c == "pos" else StringType()) for c in wanted)]
    return rows.mapInArrow(kernel, StructType(fields))


def _packed(code: np.ndarray, at: np.ndarray, flip: np.ndarray, k: int) -> list[np.ndarray]:
    out = []
    for low in range(0, k, WORD):
        word = np.zeros(len(at), np.int64)
        for i in range(low, min(low + WORD, k)):
            word = word << 2 | np.where(flip, 3 - code[at + (k - 1 - i)], code[at + i])
        out.append(word)
    return out


def _counted(keys: list[np.ndarray], ins: np.ndarray, outs: np.ndarray, counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [x[order] for x in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    first = np.flatnonzero(new)
    total = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)
    return [x[first] for x in keys], total.astype(np.int64), np.bitwise_or.reduceat(ins[order], first), np.bitwise_or.reduceat(outs[order], first)


def unpack(words: list[Column], k: int) -> Column:
    """The letters of a packed k-mer."""
    sizes = [min(WORD, k - i) for i in range(0, k, WORD)]
    return F.concat(*[F.translate(F.lpad(F.conv(w.cast("string"), 10, 4), n, "0"), "0123", "ACGT") for w, n in zip(words, sizes, strict=True)])


def counted(seqs: DataFrame, k: int, seq: str = "seq", color: str = "color") -> DataFrame:
    """The graph (ck, color, cov, in_mask, out_mask) of all sequences: kmerize and build in one.

    Each batch counts its packed k-mers, so what is shuffled is one row of integers for each k-mer, colour and batch.
    """
    n = -(-k // WORD)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for own, parts in held.items():
                keys, cov, ins, outs = _counted(*[[np.concatenate([p[0][i] for p in parts]) for i in range(n)], *(np.concatenate([p[j] for p in parts]) for j in (1, 2))])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cov), own, np.int32)), *map(pa.array, keys), pa.array(cov), pa.array(ins), pa.array(outs)], names=names)
            held.clear()

        for batch in batches:
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own is None or value is None or len(value) < k:
                    continue
                for _, data, lead, count in _slices(value, k):
                    at, flip = _places(data[lead : lead + count + k - 1], k)
                    at += lead
                    code = _CODE[data].astype(np.int64)
                    edge = np.append(code, 4)  # beyond either end of the sequence: no edge
                    before, after = edge[np.where(at > 0, at - 1, len(code))], edge[np.minimum(at + k, len(code))]
                    turn = np.array([3, 2, 1, 0, 4])
                    ins, outs = _MASK[np.where(flip, turn[after], before)], _MASK[np.where(flip, turn[before], after)]
                    held.setdefault(own, []).append((_packed(code, at, flip, k), ins, outs))
                    size += len(at)
                    if size > 4 * SLICE:
                        yield from out()
                        size = 0
        yield from out()

    names = ["color", *(f"w{i}" for i in range(n)), "cov", "in_mask", "out_mask"]
    rows = seqs.select(F.col(color).cast("int"), F.col(seq).cast("string").cast("binary"))
    schema = "color int, " + ", ".join(f"w{i} long" for i in range(n)) + ", cov long, in_mask int, out_mask int"
    words = [f"w{i}" for i in range(n)]
    whole = rows.mapInArrow(kernel, schema).groupBy(*words, "color").agg(F.sum("cov").alias("cov"), F.bit_or("in_mask").alias("in_mask"), F.bit_or("out_mask").alias("out_mask"))
    return whole.select(unpack([F.col(w) for w in words], k).alias("ck"), "color", "cov", "in_mask", "out_mask")

"""Vectorised helpers of the kernels: 64-bit mixing, word and shingle hashes, streams of equal keys."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64
_A, _B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes of text whose hashes are held at a time.
PIECE = 1 << 20

np.seterr(over="ignore")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * _A
    x = (x ^ (x >> U(27))) * _B
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = constants(256, 11)[_FOLD]
_P = 0x9E3779B97F4A7C15 | 1
_POWER = np.cumprod(np.full(PIECE + 1, _P, U)) * U(pow(_P, -1, 1 << 64))
_INVERSE = np.cumprod(np.full(PIECE + 1, pow(_P, -1, 1 << 64), U)) * U(_P)


def _piece_words(data: np.ndarray, spaces: np.ndarray, at: int) -> np.ndarray:
    """Hashes of the words of data[at : at + len(spaces)], which starts and ends between words."""
    edge = np.diff(np.concatenate(([True], spaces, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(spaces) + 1, U)
    np.cumsum(_BYTE[data[at : at + len(spaces)]] * _POWER[: len(spaces)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _INVERSE[start] + (end - start).astype(U))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order. Words lie between ASCII white space; ASCII letters count without case.

    Long texts go through in pieces that end at white space; a word longer than a piece is hashed by itself.
    """
    data = np.frombuffer(text, np.uint8)
    spaces = _SPACE[data]
    if len(data) <= PIECE:
        return _piece_words(data, spaces, 0)
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            last = np.flatnonzero(spaces[at:end])
            if len(last):
                end = at + int(last[-1]) + 1
            else:  # no space in a whole piece: one long word
                stop = np.flatnonzero(spaces[end:])
                end = end + int(stop[0]) if len(stop) else len(data)
                folded = _BYTE[data[at:end]]
                out.append(np.array([long_hash(folded)], U))
                at = end
                continue
        out.append(_piece_words(data, spaces[at:end], at))
        at = end
    return np.concatenate(out)


def long_hash(values: np.ndarray) -> np.uint64:
    total = U(0)
    for i in range(0, len(values), PIECE):
        part = values[i : i + PIECE]
        total = mix(np.array([total + (part * _POWER[: len(part)]).sum(dtype=U)], U))[0]
    return total


_PLACE = constants(16, 23) | U(1)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the runs of width words; of all words, if they are fewer; none without a word."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, U)
    for i in range(width):
        total += mix(words[i : len(words) - width + 1 + i] ^ _PLACE[i])
    return np.unique(mix(total * _PLACE[width]))


def runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[tuple[pa.Table, bool]]:
    """Regroup a stream sorted by key into tables that end where the key changes.

    Yields (table, True) for whole keys. A key with over `rows` rows comes as several tables, all but the last with False.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], "left")) if keys[0] <= keys[-1] else int(np.flatnonzero(keys != keys[-1])[-1]) + 1
        if last:
            yield table.slice(0, last).combine_chunks(), True
            held = table.slice(last).combine_chunks().to_batches()
        else:
            yield table.combine_chunks(), False
            held = []
        count = sum(x.num_rows for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), True


def id_key(name: str, text: str) -> Column:
    """The id as a long; rows without one get a negative number made from their text."""
    return F.coalesce(F.col(name).cast("long"), -F.abs(F.xxhash64(F.lit("no id"), F.col(text)) % F.lit(1 << 61)) - F.lit(1 << 61))


def crc_mod(name: str, n: int) -> Column:
    """crc32(id as text) mod n, 0 for a null id."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % n, F.lit(0))

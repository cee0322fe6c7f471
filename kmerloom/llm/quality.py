"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Every word bucket has a sparse random index vector; a word's vector is the sum of the index vectors around its occurrences
in the learning sample, plus its own. Words are runs of letters, of digits or of other signs, and each also counts as its
shape (kind, case, length), so words never seen still have a known shape; a word that
repeats the one before has a shape of its own. A document is the mean of its vectors. The
network's scores are divided by a temperature fitted on rows that the network did not see.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import _BYTE, _INVERSE, _POWER, U, long_hash, mix

#: Word buckets, dimensions of a vector, nonzero entries of an index vector, words on each side that count as context.
BUCKETS, DIMS, NONZERO, NEAR = 1 << 13, 48, 4, 2
#: Labelled rows learned from (about), hidden units, bytes of text in work at a time.
SAMPLE, HIDDEN, SLICE = 6000, 24, 1 << 18
#: Tasks that read the sampled texts; parts in which their tables of word vectors are added up.
TASKS, PARTS = 12, 64
THRESHOLD = 0.3

_KIND = np.full(256, 4, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 3
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(6)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIMS, BUCKETS)] += rng.choice([-1.0, 1.0], BUCKETS)
    return out


def _pieces(text: str | None) -> Iterator[np.ndarray]:
    """The bytes of a text in pieces of about SLICE that end between words; a longer word is a piece by itself."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        if end < len(data):
            edge = np.flatnonzero(np.diff(_KIND[data[at : end + 1]]))
            if len(edge):
                end = at + int(edge[-1]) + 1
            while not len(edge) and end < len(data):  # one word fills the piece: go on to its end
                edge = np.flatnonzero(np.diff(_KIND[data[end - 1 : end + SLICE]]))
                end = end + int(edge[0]) if len(edge) else min(end + SLICE, len(data))
        yield data[at:end]
        at = end


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, kind, shape) of the words of a piece."""
    kind = _KIND[data]
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    end = np.append(edge[1:], len(data))
    use = kind[edge] != 0
    start, end, kind = edge[use], end[use], kind[edge[use]].astype(U)
    if len(data) < len(_POWER):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * _POWER[: len(data)], out=sums[1:])
        words = mix((sums[end] - sums[start]) * _INVERSE[start] + U(1))
    else:  # one very long word
        words = np.array([long_hash(_BYTE[data[a:z]]) for a, z in zip(start.tolist(), end.tolist())], U)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    upper, size = upper[end] - upper[start], end - start
    case = np.where(upper == 0, 0, np.where(upper == size, 3, np.where(upper == 1, 1, 2))).astype(U)
    return words, kind, mix(kind * U(64) + case * U(16) + np.minimum(size, 12).astype(U) + U(1 << 40))


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(word buckets, shape buckets) of a whole text."""
    found = [_words(x) for x in _pieces(text)] or [(np.empty(0, U),) * 3]
    words, kind, shapes = (np.concatenate(x) for x in zip(*found, strict=True))
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    shapes = np.where(again & (kind < 4), U(12345), np.where(kind == 4, mix(words ^ U(99)), shapes))
    return (words & U(BUCKETS - 1)).astype(np.int32), (shapes & U(BUCKETS - 1)).astype(np.int32)


def add_contexts(sums: np.ndarray, found: np.ndarray, index: np.ndarray) -> None:
    """Add to sums[b], for each place of a bucket b, the index vectors of b and of the buckets within NEAR places."""
    for at in range(0, len(found), SLICE):
        low, high = max(0, at - NEAR), min(len(found), at + SLICE + NEAR)
        part = found[low:high]
        around = index[part]
        for away in range(1, NEAR + 1):
            around[away:] += index[part[:-away]]
            around[:-away] += index[part[away:]]
        part, around = found[at : at + SLICE], around[at - low : at - low + SLICE]
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        sums[part[order][first]] += np.add.reduceat(around[order], first, axis=0)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stream of buckets: how often b stands within NEAR of a, as sums of index vectors, in PARTS rows."""
    index = index_vectors()
    sums = np.zeros((2, BUCKETS, DIMS), np.float64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for stream, found in enumerate(tokens(text)):
                add_contexts(sums[stream], found, index)
    parts = np.split(sums.astype(np.float32).reshape(-1, DIMS), PARTS)
    yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "sums"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The unit vectors of each part's sums over all tasks."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            held[part] = held.get(part, 0) + np.frombuffer(sums, np.float32).reshape(-1, DIMS).astype(np.float64)
    found = [(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32).tobytes() for x in held.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(found, pa.binary())], names=["part", "vectors"])


def pool(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Features of each text: the mean vector of its words, of their shapes, and the logarithm of their number."""
    out = np.zeros((len(texts), 2 * DIMS + 1))
    for i, text in enumerate(texts):
        both = tokens(text)
        n = len(both[0])
        for stream, found in enumerate(both):
            total = np.bincount(found, minlength=BUCKETS) @ vectors[stream] if n > BUCKETS else vectors[stream][found].sum(axis=0, dtype=np.float64)
            out[i, stream * DIMS : (stream + 1) * DIMS] = total / max(1, n)
        out[i, -1] = np.log1p(n)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradients(z: np.ndarray, y: np.ndarray, w: list[np.ndarray]) -> list[np.ndarray]:
    """Of the mean log loss plus 0.00005 times the squares of both layers' weights."""
    h = np.tanh(z @ w[0] + w[1])
    d = (_sigmoid(h @ w[2] + w[3][0]) - y) / len(y)
    back = np.outer(d, w[2]) * (1 - h * h)
    return [z.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> dict:
    """A network of HIDDEN tanh units learned by Adam on the rows not held, its temperature on the held ones."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, rng = (x - mean) / scale, np.random.default_rng(61)
    w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    train = np.flatnonzero(~held)
    for _ in range(60 if len(train) else 0):
        rng.shuffle(train)
        for at in range(0, len(train), 128):
            rows = train[at : at + 128]
            step += 1
            for i, g in enumerate(gradients(z[rows], y[rows], w)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = {"mean": mean, "scale": scale, "w": w, "temperature": 1.0}
    if held.any():
        raw = logits(x[held], model)
        losses = [(-(y[held] * np.log(p := np.clip(_sigmoid(raw / t), 1e-9, 1 - 1e-9)) + (1 - y[held]) * np.log(1 - p)).mean(), t) for t in np.geomspace(1, 16, 33)]
        model["temperature"] = min(losses)[1]
    return model


def logits(x: np.ndarray, model: dict) -> np.ndarray:
    a, b, c, d = model["w"]
    return (np.tanh((x - model["mean"]) / model["scale"] @ a + b) @ c + d[0]) / model["temperature"]


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> dict | None:
    """A model from about `sample` labelled rows, chosen by a hash of the id; None without labelled rows.

    Word vectors, network and temperature (on a fifth of the rows) all come from these rows. Labels that are null or of a null
    id are left out; of several labels of an id the highest counts. Other columns are not read. The whole table is scanned by
    as many tasks as it has splits; only the sampled texts move.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("y"))
    marks = marks.withColumn("draw", F.pmod(F.xxhash64(F.lit(66), "label_id"), F.lit(1 << 20)))
    n = marks.count()
    if not n:
        return None
    marks = marks.where(F.col("draw") < int((1 << 20) * min(1.0, sample / n)))
    marks = F.broadcast(marks)  # about `sample` rows
    rows = docs.join(marks, F.col("id") == F.col("label_id")).select("text", "y", F.pmod("draw", F.lit(5)).alias("fold"))
    rows = rows.repartition(TASKS).persist()  # about `sample` texts
    tables = rows.select("text").mapInArrow(_contexts, "part int, sums binary").repartition(TASKS, "part")
    tables = sorted(tables.mapInArrow(_vectors, "part int, vectors binary").collect())  # one table of fixed size, whatever the tasks
    if not tables:  # no document has a label
        rows.unpersist()
        return None
    vectors = np.frombuffer(b"".join(r["vectors"] for r in tables), np.float32).reshape(2, BUCKETS, DIMS)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = pool(batch.column("text").to_pylist(), shared.value)
                cols = [x, *(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "fold"))]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names=["x", "y", "fold"])

    got = rows.mapInArrow(kernel, "x binary, y binary, fold binary").collect()  # about `sample` rows, packed by batch
    rows.unpersist()
    if not got:
        return None
    x, y, fold = (np.frombuffer(b"".join(r[i] for r in got), float) for i in range(3))
    x = x.reshape(len(y), -1)
    order = np.lexsort((fold, y, *x.T[::-1]))  # by the values, so that no order of tasks shows
    x, y, fold = x[order], y[order], fold[order]
    return fit(x, y, fold == 0) | {"vectors": vectors}


def score_texts(texts: list[str | None], model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    return _sigmoid(logits(pool(texts, model["vectors"]), model))


def grade(docs: DataFrame, model: dict | None, text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on), from the text alone.

    Null and empty texts are scored as texts of no words; without labelled rows every score is 0.5. Long texts are pooled in
    slices. Rows keep their columns (but former score and predicted, and the text unless keep_text); an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # word vectors of fixed size
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    place = names.index(text_col)
    after = [c for c in names if keep_text or c != text_col]

    def kept(batch: pa.RecordBatch) -> list:
        return [x for i, x in enumerate(batch.columns) if keep_text or i != place]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_texts(batch.column(place).to_pylist(), shared.value)
            cols = [*kept(batch), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*after, "score", "predicted"])

    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = rows.select(*[F.col(f"`{c}`") for c in after]).withColumns({"score": F.lit(0.0), "predicted": F.lit(0).cast("int")}).schema
    return rows.mapInArrow(kernel, schema)



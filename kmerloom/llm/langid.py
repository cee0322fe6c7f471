"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of the learned languages come from a bounded sample of labelled rows; the matrix of log probabilities (BUCKETS rows,
one column a language) is broadcast. A batch is scored as a sparse count matrix in numpy: the n-grams of all its texts
are row numbers of the matrix, summed between the texts' boundaries.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import U, mix

#: Hash buckets of n-grams, n-gram lengths, labelled rows learned from for each language (about), characters in work at a time.
BUCKETS, LENGTHS, SAMPLE, SLICE = 1 << 14, (2, 3), 3000, 1 << 18
#: Tasks that count the sampled texts.
TASKS = 12
_ASCII_LETTER = re.compile(r"[A-Za-z]")
_SALT = mix(np.arange(1, 5, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def has_letter(text: str | None) -> bool:
    """Whether a character of a Unicode letter category stands in the text (digits, numerals and marks are none)."""
    return text is not None and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    total = codes[: len(codes) - n + 1] * _SALT[0]
    for i in range(1, n):
        total = (total ^ (total >> U(29))) * _SALT[i] + codes[i : len(codes) - n + 1 + i]
    return (mix(total + U(n)) & U(BUCKETS - 1)).astype(np.int32)


def grams(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text in lower case, a space at either end, for at most SLICE places at a time.

    A slice reads on into the next one, so the n-grams of a long text are those of the whole."""
    text = f" {text.lower()} "
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE + max(LENGTHS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        found = [_hashed(codes[: SLICE + n - 1], n) for n in LENGTHS if len(codes) >= n]
        if found:
            yield np.concatenate(found)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for found in grams(text):
                own += np.bincount(found, minlength=BUCKETS)
    names = sorted(held)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([held[x].tobytes() for x in names], pa.binary())], names=["lang", "counts"])


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key: Column | None = None, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, BUCKETS x languages log probabilities, log priors) from rows with a language and a text.

    About `sample` rows a language are learned from, chosen by a hash of `key`; the priors count all rows. Rows without a
    language or a text are left out; other columns are not read. The whole table is scanned by as many tasks as it has
    splits; only the sampled texts move.
    """
    key = F.col("doc_id") if key is None else key
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit(77), key), F.lit(1 << 20)).alias("draw"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not totals:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(max(1, int((1 << 20) * min(1.0, sample / n))))) for k, n in sorted(totals.items())])
    found = rows.where(F.col("draw") < bound).select("lang", "text").repartition(TASKS).mapInArrow(_counts, "lang string, counts binary").collect()
    langs = sorted(totals)
    table = np.zeros((BUCKETS, len(langs)))
    for r in found:  # one row a language and task of at most TASKS
        table[:, langs.index(r["lang"])] += np.frombuffer(r["counts"], np.int64)
    logs = np.log(table + 0.5) - np.log((table + 0.5).sum(axis=0))
    prior = np.log(np.array([totals[x] for x in langs], float) / sum(totals.values()))
    return langs, logs.astype(np.float32), prior


def score(texts: list[str | None], langs: list[str], logs: np.ndarray, prior: np.ndarray) -> list[tuple[str, float]]:
    """(language, posterior) of each text; ("und", 0.0) without a letter, or if nothing was learned."""
    totals = np.zeros((len(texts), len(langs)))
    parts, owner, size = [], [], 0

    def add() -> None:
        starts = np.concatenate(([0], np.cumsum([len(x) for x in parts])[:-1]))
        np.add.at(totals, owner, np.add.reduceat(logs[np.concatenate(parts)], starts, axis=0, dtype=np.float64))

    use = [bool(langs) and has_letter(x) for x in texts]
    for i, text in enumerate(texts):
        if not use[i]:
            continue
        for found in grams(text):
            parts.append(found)
            owner.append(i)
            size += len(found)
            if size > len(LENGTHS) * SLICE:
                add()
                parts, owner, size = [], [], 0
    if parts:
        add()
    out = []
    for i, ok in enumerate(use):
        if not ok:
            out.append(("und", 0.0))
            continue
        x = totals[i] + prior
        x = np.exp(x - x.max())
        best = int(x.argmax())
        out.append((langs[best], float(x[best] / x.sum())))
    return out


def identify(docs: DataFrame, model: tuple, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score, from the text alone.

    A null text, and one without a letter, is `und` with score 0; ties go to the first language in order. Long texts are
    summed in slices without a seam. Rows keep their columns (but former lang_pred and score, and the text unless keep_text); an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = names.index(text_col)
    after = [c for c in names if keep_text or c != text_col]

    def kept(batch: pa.RecordBatch) -> list:
        return [x for i, x in enumerate(batch.columns) if keep_text or i != place]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(batch.column(place).to_pylist(), *shared.value)
            cols = [*kept(batch), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*after, "lang_pred", "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = rows.select(*[F.col(f"`{c}`") for c in after]).withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return rows.mapInArrow(kernel, schema)

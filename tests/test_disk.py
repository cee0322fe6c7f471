"""Queries that once moved or wrote a row a k-mer: they move at most 3.2 bytes a letter (4 times a table of documents, which takes 0.8
bytes a letter), and give what their SQL gives, with ids below 0, repeats, short and null texts."""

import gzip
import random

import duckdb
import numpy as np
import pytest

from kmerloom.operators import buckets, filters, graph
from kmerloom.operators.kmers import SLICE, counted, kmerize
from kmerloom.plans import catalog, runtime
from kmerloom.plans import queries as Q
from tests.test_whole import dna, folder

#: By finding.
NAMES = [
    "mappable_kmers",
    "shared_kmers",
    "contig_distance_to_end",
    "cov_stats",
    "degrees",
    "evaluate_rois",
    "filter_sizes",
    "partition_filter",
    "accounting",
    "best_overlap",
    "contig_coverage",
    "gfa_links",
    "graph_range",
    "kmer_index",
    "label_kmers",
    "low_complexity",
    "low_coverage",
    "novel_kmers",
    "prev_kmers",
    "recover_excluded",
    "sections",
    "validated_kmers",
    "variant_seeds",
    "walk_edges",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    parts, r = [dna(400, i) for i in range(40)], random.Random(5)
    docs = {i: "".join(r.choices(parts, k=2)) + dna(900, 1000 + i) + r.choice(parts) * (i % 2) for i in range(-20, 220)}
    docs |= {300: dna(20, 7), 301: "", 302: parts[0], 303: "A" * 700, 304: dna(21, 8), 305: parts[0][100:300], 306: "ACACAC" * 40, 307: dna(60, 9), 308: parts[0][280:380]}
    truth = {i: parts[i][: 100 + 30 * i] + docs[i + 6][1050:1150] for i in range(6)} | {6: "ACG"}
    at = folder(spark, tmp_path_factory.mktemp("disk"), docs, truth)
    return at, sum(map(len, docs.values()))


def written(spark) -> int:
    """Bytes of all shuffles of the session so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("name", NAMES)
def test_whole_and_small(spark, tables, name, tmp_path, monkeypatch):
    at, letters = tables
    cuts = []
    real = runtime.cut

    def cut(df, label="cut"):
        out = real(df, label)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out._kmerloom_path)
        cuts.append(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength())
        return out

    for module in (catalog, graph, Q):
        monkeypatch.setattr(module, "cut", cut, raising=False)
    monkeypatch.setattr(catalog, "_kept", {})
    before = written(spark)
    Q.queries()[name](spark, at).write.parquet(str(tmp_path / "out"))
    assert written(spark) - before + sum(cuts) <= 3.2 * letters
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}/{table}.parquet/*.parquet')")
    con.sql(f"CREATE TABLE got AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    if name == "low_complexity":  # compression is not SQL
        rows = con.sql(Q.oracle_sql()["low_coverage"].replace("WHERE cov < 10", "")).fetchall()
        want = sorted((ck, cov) for ck, cov in rows if len(gzip.compress(ck.encode())) / len(ck) < 1.5)
        assert want and sorted(con.sql("SELECT * FROM got").fetchall()) == want
        return
    con.sql(f"CREATE TABLE want AS {Q.oracle_sql()[name]}")
    assert con.sql("DESCRIBE got").fetchall() and [x[0] for x in con.sql("DESCRIBE got").fetchall()] == [x[0] for x in con.sql("DESCRIBE want").fetchall()]
    assert con.sql("SELECT * FROM want").fetchall()
    for a, b in (("got", "want"), ("want", "got")):
        assert not con.sql(f"SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}").fetchall()


@pytest.mark.parametrize("k", [1, 4, 9, 16, 21, 27])
def test_graph_by_runs(spark, k):
    """Runs of all lengths: other letters, both cases, cuts of long sequences and long runs of one minimizer; even k has palindromes."""
    texts = [(0, dna(SLICE + 500, 3)), (1, dna(300, 4).lower() + "N" + dna(200, 5) + "nn" + dna(30, 6)), (1, "AT" * 900), (2, "A" * 1500), (2, "ACGT"), (2, None), (None, dna(50, 7)), (-1, dna(80, 8))]
    seqs = spark.createDataFrame(texts, "color int, seq string")
    got, want = buckets.graph(seqs, k, [-1, 0, 1, 2]), counted(seqs, k)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    wide = buckets.wide(seqs, k, [-1, 0, 1, 2], ["ck", "cov2", "in2", "out2"], filters.is_novel)
    rows = filters.novel(want, 2, [0, 1]).select("ck", "cov", "in_mask", "out_mask")
    assert wide.exceptAll(rows).count() == rows.exceptAll(wide).count() == 0
    first = [r.ck for r in graph.first_between(buckets.least(seqs, k, 7), 2, 7).collect()]
    assert first == [r.ck for r in kmerize(seqs, k).select("ck").distinct().orderBy("ck").limit(7).collect()][2:]
    with pytest.raises(ValueError):
        buckets.graph(seqs, 28, [0])


def test_compression_sizes(spark):
    r = random.Random(2)
    texts = ["".join(r.choices("ACGT"[: r.randint(1, 4)], k=r.randint(1, 140))) for _ in range(2000)] + ["é" * 70, ""]
    rows = spark.createDataFrame([(x,) for x in texts], "s string").select("s", filters.compression_ratio("s").alias("r")).collect()
    assert all(x.r == (len(gzip.compress(x.s.encode())) / len(x.s) if x.s else None) for x in rows)


def test_low_complexity_bound():
    """No k-mer that gzip makes small is left out before it is compressed."""
    r = random.Random(3)
    for k, least in ((21, 1.5), (21, 1.6), (21, 1.3), (27, 1.3), (12, 2.2), (5, 4.0), (21, 0.7)):
        made = {"".join(r.choices("ACGT", [r.random() ** 3 + 1e-9 for _ in range(4)], k=k)) for _ in range(4000)}
        made |= {("".join(r.choices("ACGT", k=r.randint(1, 9))) * k)[:k] for _ in range(4000)}
        made |= {"".join(r.choice((x, y)) for x, y in zip("ACGT" * k, "".join(r.choices("ACGT", k=3)) * k))[:k] for _ in range(4000)}
        made = sorted(made)
        words = np.array([int("".join(str("ACGT".index(c)) for c in x), 4) for x in made], np.uint64)
        kept = filters.may_be_low(words, k, least)
        assert all(kept[i] for i, x in enumerate(made) if len(gzip.compress(x.encode())) / k < least)
    words = np.random.default_rng(1).integers(0, 4**21, 100_000).astype(np.uint64)
    assert filters.may_be_low(words, 21, 1.5).mean() < 0.1


def test_letters_by_eight():
    """One table lookup gives a k-mer and the one before it: k-mers of all lengths, with a letter ahead."""
    r = random.Random(8)
    for k in range(1, 28):
        texts = ["".join(r.choices("ACGT", k=k + 1)) for _ in range(50)]
        rows = buckets._rows(np.array([int("".join(str("ACGT".index(c)) for c in x), 4) for x in texts], np.uint64), k + 1)
        assert buckets._texts(rows[:, 1:]).to_pylist() == [x[1:] for x in texts]
        assert buckets._texts(rows[:, :-1]).to_pylist() == [x[:-1] for x in texts]

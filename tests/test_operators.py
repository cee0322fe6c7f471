import importlib.util

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import masks
from kmerloom.functions import sequence as S
from kmerloom.operators import contigs, evaluate, filters, graph, intervals, traverse, unitigs
from kmerloom.plans.components import components


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 6), (7, 7), (8, 9), (9, 10), (10, 11), (11, 12), (None, 4)], "u long, v long")
    found = dict(rows(components(edges)))
    assert found == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 8: 8, 9: 8, 10: 8, 11: 8, 12: 8}
    assert rows(components(edges.where("false"))) == []


def test_components_end_at_stars(spark, monkeypatch):
    """Stars are written once and take no round; what is none of them takes rounds until it is."""
    import random

    from kmerloom.plans import components as module

    written = []
    cut = module.cut
    monkeypatch.setattr(module, "cut", lambda df, name="cut": written.append(name) or cut(df, name))
    stars = [(i, i // 10 * 10) for i in range(200) if i % 10] + [(1000 + i, 999) for i in range(50)]
    assert dict(rows(components(spark.createDataFrame(stars, "u long, v long")))) == {x: v for u, v in stars for x in (u, v)}
    assert len(written) == 1
    rng = random.Random(8)
    for edges in ([(3, 2), (3, 1)], [(3, 2), (2, 1)], [(i, i - 1) for i in range(1, 60)], [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(300 + i, 7) for i in range(60)]):
        want = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in want:
            for u, v in edges:
                if u != v:
                    want[u] = want[v] = min(want[u], want[v])
        written.clear()
        assert dict(rows(components(spark.createDataFrame(edges, "u long, v long")))) == want
        assert len(written) > 1


def test_sequences(spark):
    df = spark.createDataFrame([("AACGTN", "acgt")], "a string, b string")
    got = df.select(S.reverse_complement("a"), S.reverse_complement("b"), S.canonical("a"), S.translate_cds("a"), S.hamming("a", F.lit("AACGTA")), S.truncate(F.lit("AAACCCGGG")), S.is_valid("a"), S.code_hash(F.lit("hello"))).first()
    assert tuple(got) == ("NACGTT", "acgt", "AACGTN", "NN", 1, "AAACCC...GGG", False, 99162322)
    assert df.select(S.translate_cds(F.lit("ATGAAATAG"))).first()[0] == "MK*"
    t = df.select(S.trim_alleles(F.lit("ACGTT"), F.lit("ACTT")).alias("t")).first()["t"]
    assert tuple(t) == (2, "G", "")
    assert df.select(S.pack(F.lit("ACGT")), S.breakend(F.lit("A[chr1:5["))).first()[:] == (27, "chr1:5")


def test_masks(spark):
    df = spark.createDataFrame([(1, 12)], "i int, o int")
    got = df.select(masks.mirror(F.col("i")), masks.text(F.col("i"), F.col("o")), masks.bases(F.col("o")), masks.byte(F.col("i"), F.col("o"))).first()
    assert tuple(got) == (8, "a.....GT", ["G", "T"], 140)


def _graph(spark, samples, k):
    df = spark.createDataFrame(samples, "color int, seq string")
    return graph.build(graph.kmerize(df, k, "seq", ("color",)))


def test_graph_matches_kernel(spark):
    samples = [(0, "AGTTCTGATCTGGGCTATATGCT"), (1, "AGTTCGAATCTGGGCTATATGCT"), (2, "AGTNTCTGATCTGGGCTATGGCTA"), (2, "AC"), (2, None)]
    got = {(r["ck"], r["color"]): (r["cov"], r["in_mask"], r["out_mask"]) for r in _graph(spark, samples[:2], 5).collect()}
    want = traverse.LocalGraph.of(samples[:2], 5)
    assert got == {(ck, c): x for ck, own in want.rows.items() for c, x in own.items()}
    assert all("N" not in r["ck"] for r in _graph(spark, samples, 5).collect())


def test_filters(spark):
    g = _graph(spark, [(0, "AGTTCTGATCTGGGCTATATGCT"), (1, "AGTTCGAATCTGGGCTATATGCT"), (2, "AGTTCTGATCTGGGCTATGGCTA")], 5).cache()
    novel = {r["ck"] for r in filters.novel(g, 2, [0, 1]).collect()}
    assert novel and novel == {r["ck"] for r in g.where("color = 2").collect()} - {r["ck"] for r in g.where("color < 2").collect()}
    assert rows(graph.head(g, 2)) == rows(graph.between(g, 0, 2).select("ck"))
    assert rows(evaluate.compare_sets(g, g))[0][2:4] == (0, 0)


def test_unitigs(spark):
    g = unitigs.merged_colors(_graph(spark, [(0, "AGTTCGAATCTGGGCTATATGCT"), (0, "AGTTCGAATCTGAGCTATATGCT")], 7), [0])
    found = {r["seq"] for r in unitigs.unitigs(g).collect()}
    assert {min(s, traverse.rc(s)) for s in ("AGTTCGAATCTG", "AGCTATATGCT")} <= {min(s, traverse.rc(s)) for s in found} | {min(s, traverse.rc(s)) for s in ("AGCTATATGCT",)}
    assert sum(r["kmers"] for r in unitigs.unitigs(g).collect()) == g.count()


def test_walks_by_component(spark):
    g = _graph(spark, [(0, "AGTTCTGATCTGGGCTATATGCT"), (0, "CCCCGACCC")], 5)
    seeds = spark.createDataFrame([("CCCAG",), ("AAAAA",)], "ck string")
    assert rows(traverse.walk_truth(g, seeds, [0])) == [("CCCAG", traverse.rc("AGTTCTGATCTGGGCTATATGCT"))]


def test_contigs(spark):
    pos = spark.createDataFrame([("a", p) for p in (1, 2, 3, 10, 11, 5000)], "name string, pos int")
    regions = contigs.islands(pos, "name")
    assert rows(regions) == [("a", 1, 3, 3), ("a", 10, 11, 2), ("a", 5000, 5000, 1)]
    lengths = spark.createDataFrame([("a", 5100)], "name string, n int")
    assert rows(contigs.sections(regions, lengths, "name")) == [("a", 0, 211), ("a", 4800, 5099)]
    n50 = spark.createDataFrame([(x,) for x in (7, 4, 3, 2, 2, 1, 1)], "len int")
    assert contigs.half_length(n50, "len").first()[0] == 4
    m = contigs.moments(spark.createDataFrame([("x", v) for v in (1.0, 2.0, 5.0, 10.0, -5.0)], "g string, v double"), ["g"], "v").first()
    assert (m["n"], round(m["mean"], 6), round(m["variance"], 6), round(m["deviation"], 6)) == (5, 2.6, 30.3, 5.504544)


def test_intervals(spark):
    a = spark.createDataFrame([(1, 5, 2500, "x"), (1, 1, 2, "y")], "chr int, start long, stop long, id string")
    assert rows(intervals.overlaps(a, a, 1000).select("id", "b_id")) == [("x", "x"), ("y", "y")]
    p = spark.createDataFrame([(1, 10, "p"), (2, 10, "q")], "chr int, pos long, k string")
    assert rows(intervals.nearest(p, a, "k", 20)) == [("p", "x", 5)]


def test_import_without_session():
    assert importlib.util.find_spec("kmerloom.plans.queries")
    import __spark_entry__

    assert "novel_kmers" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_training_data_operators(tmp_path):
    """The rest runs where the subpackage of training-data operators and its tests are gone, with or without the pipeline."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    check = "import __spark_entry__ as e; q = e.queries(); assert 'novel_kmers' in q and not [x for x in q if x.startswith('op') or x == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", check], cwd=tmp_path / "copy", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")})
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)


@pytest.mark.parametrize("name", ["novel_kmers", "n50", "interval_merge", "tips", "gfa_links", "f1_table", "truth_alleles", "consistent_edges", "infer_edges", "kmer_pair_matrix"])
def test_queries_against_duckdb(spark, name):
    import duckdb

    import __spark_entry__

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "benchmark", "lineitem", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = __spark_entry__.queries()[name](spark, sf)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert rows(got) == sorted(want)

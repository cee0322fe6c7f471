from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.operators import annotate, clean, graph
from kmerloom.sources import exports

MAIN = "TTAGTTGTGCCGCAGCGAAGTAGTGCTTGAAATATGCGAC"


def rows(df):
    return sorted(map(tuple, df.collect()))


def built(spark, *seqs):
    df = spark.createDataFrame([(0, s) for s in seqs], "color int, seq string")
    return graph.build(graph.kmerize(df, 7, "seq", ("color",)))


def test_tip_and_bubble(spark):
    want = rows(built(spark, MAIN, MAIN, MAIN))
    tip = built(spark, MAIN, MAIN, MAIN, MAIN[8:20] + "GGG")
    short = rows(clean.cleaned(tip, 5, pop=False))
    assert [(r[0], r[3], r[4]) for r in short] == [(r[0], r[3], r[4]) for r in want]
    other = MAIN[:18] + "G" + MAIN[19:]
    popped = rows(clean.cleaned(built(spark, MAIN, MAIN, other), 0))
    assert [(r[0], r[3], r[4]) for r in popped] == [(r[0], r[3], r[4]) for r in want]
    assert rows(clean.cleaned(built(spark, MAIN, MAIN, MAIN), 5, 2.0)) == want
    assert rows(clean.cleaned(built(spark, MAIN), 0, 2.0)) == []


def test_annotate(spark):
    calls = spark.createDataFrame([(1, 50, "c1"), (1, 500, "c2"), (2, 50, "c3"), (None, None, "c4")], "chr long, pos long, call string")
    spans = lambda *x: spark.createDataFrame(list(x), "chr long, start long, stop long, id string")
    got = annotate.annotate(calls, "call", spans((1, 1, 60, "edge")), spans((1, 40, 60, "g2"), (1, 45, 52, "g1"), (1, 900, 950, "g3")), spans((2, 50, 50, "r")), 420)
    assert rows(got.select("call", "region", "gene", "closest_gene", "repeat", "genic")) == [("c1", "edge", "g1", "g1", None, True), ("c2", "core", None, "g3", None, False), ("c3", "core", None, None, "r", False), ("c4", "core", None, None, None, False)]


def test_match_and_filter(spark):
    called = spark.createDataFrame([(1, 100, "SNP", 1), (1, 100, "DEL", 2), (1, 700, "DEL", 3)], "chr long, pos long, type string, id long")
    truth = spark.createDataFrame([(1, 109, "SNP", 7), (1, 111, "SNP", 8), (1, 400, "DEL", 9), (2, 100, "SNP", 10)], "chr long, pos long, type string, id long")
    assert rows(annotate.positional_match(called, truth, "id", {"SNP": 10})) == [(1, 7, 9), (2, 9, 300), (3, 9, 300)]
    df = spark.createDataFrame([(1, 30.0, 1.0), (2, None, 9.0), (3, 10.0, 1.0)], "id long, dp double, sor double")
    assert rows(annotate.quality_filter(df, {"dp": 20}, {"sor": 3}).select("id")) == [(1,)]


def test_more_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTACGG", "TTACGGAC")], "a string, b string")
    got = df.select(S.longest_common_substring("a", "b"), S.longest_common_substring(F.lit(""), "b"), S.splits(F.lit("AANNC"), "N"), S.edits(F.lit("A-C"), F.lit("ATC"))).first()
    assert tuple(got) == ("TACGG", "", ["AA", "NN", "C"], 1)
    two = df.select(S.second_neighbours(F.lit("ACG"), 3)).first()[0]
    assert len(two) == 27 and all(sum(x != y for x, y in zip("ACG", s)) == 2 for s in two)


def test_exports(spark, tmp_path):
    ref = spark.createDataFrame([("c", "ACNNGT"), ("d", "NN")], "contig string, seq string")
    assert rows(exports.karyotype(ref)) == [("c", 0, 6), ("d", 0, 2)]
    assert rows(exports.karyotype(ref, True)) == [("c", 0, 2), ("c", 4, 6)]
    assert rows(exports.padded(spark.createDataFrame([("a", None)], "x string, y long"), {"x": 3, "y": 4})) == [("a   NA  ",)]
    (tmp_path / "m.tsv").write_text("id\ts1\ts2\nr1\t1\t2.5\nr2\tNA\t4\n")
    assert rows(exports.read_matrix(spark, str(tmp_path / "m.tsv")))[:2] == [("r1", "s1", 1.0), ("r1", "s2", 2.5)]
    (tmp_path / "t.txt").write_text("one a 1\n\ntwo  b\nthree\n")
    assert rows(exports.read_tables(spark, str(tmp_path / "t.txt"))) == [("one", ["a", "1"]), ("three", []), ("two", ["b"])]
    v, e = spark.createDataFrame([("g", "ACG")], "g string, km string"), spark.createDataFrame([("g", "ACG", "CGT")], "g string, a string, b string")
    assert rows(exports.json_graph(v, e, "g")) == [("g", '{"kind":"edge","a":"ACG","b":"CGT"}'), ("g", '{"kind":"vertex","km":"ACG"}')]
    runs = spark.createDataFrame([("s", "c", 1, 5, 0)], "sample string, chr string, start int, stop int, value int")
    assert rows(exports.track_lines(runs)) == [("s", "c 1 5 0")]

import numpy as np
from pyspark.sql import functions as F

from kmerloom.operators import inheritance, simulate
from kmerloom.operators.graph import kmerize

SEQ = "GGATCATCATCAGGCTTAGC"


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_generators(spark):
    df = spark.createDataFrame([(SEQ, 7)], "seq string, seed long")
    s, seed = F.col("seq"), F.col("seed")
    at = lambda n: F.lit(n)
    assert tuple(one(df, simulate.deletion(s, at(4), at(3)))) == (4, "CATC", "C")
    assert tuple(one(df, simulate.inversion(s, at(0), at(4)))) == (0, "GGAT", "ATCC")
    assert tuple(one(df, simulate.substitution(s, at(0), at(4)))) == (0, "GGAT", "TTCA")
    assert tuple(one(df, simulate.duplication(s, at(2), at(3)))) == (2, "ATC", "ATCATC")
    assert one(df, simulate.repeat_units(s, at(2), at(3))) == 3
    assert tuple(one(df, simulate.repeat_expansion(s, at(2), at(3), 2))) == (2, "ATC" * 3, "ATC" * 5)
    assert tuple(one(df, simulate.repeat_contraction(s, at(2), at(3), 9))) == (2, "ATC" * 3, "ATC")
    assert one(df, simulate.repeat_expansion(s, at(0), at(4), 1)) is None
    snv = one(df, simulate.snv(s, at(5), seed))
    assert snv["ref"] == SEQ[5] and snv["alt"] in "ACGT" and snv["alt"] != snv["ref"] and snv == one(df, simulate.snv(s, at(5), seed))
    ins = one(df, simulate.insertion(s, at(5), at(6), seed))
    assert ins["ref"] == SEQ[5] and len(ins["alt"]) == 7 and set(ins["alt"]) <= set("ACGT")
    for bad in (simulate.deletion(s, at(18), at(3)), simulate.inversion(s, at(-1), at(3)), simulate.duplication(s, at(2), at(0)), simulate.inversion(s, at(2), at(-2))):
        assert one(df, bad) is None
    assert one(df, simulate.applied(s, simulate.deletion(s, at(4), at(3)))) == SEQ[:5] + SEQ[8:]
    assert one(df, simulate.applied(s, simulate.deletion(s, at(40), at(3)))) == SEQ


def test_apply_all(spark):
    seqs = spark.createDataFrame([("a", SEQ), ("b", "ACGT")], "name string, seq string")
    made = spark.createDataFrame([("a", 2, "ATC", "A"), ("a", 3, "T", "G"), ("a", 2, "ATC", "A"), ("a", 10, "C", "CTT")], "name string, start long, ref string, alt string")
    got = dict(map(tuple, simulate.apply_all(seqs, made, "name").collect()))
    assert got == {"a": "GGA" + SEQ[5:10] + "CTT" + SEQ[11:], "b": "ACGT"}


def test_recombination(spark):
    a = "ACGGTCATTGCAGGATCCTAAGCTTGACCA"
    b = "TTT" + a[:12] + "G" + a[13:]
    parents = spark.createDataFrame([("1", "m", a), ("1", "f", b), ("2", "m", "ACGT"), ("2", "f", "TTTT")], "chr string, parent string, seq string")
    places = simulate.crossovers(kmerize(parents, 7, "seq", ("chr", "parent")), "m", "f", 2)
    found = sorted(map(tuple, places.collect()))
    assert len(found) == 2 and all(y == x + 3 for _, x, y in found)
    (_, x, _), (_, y, _) = found
    got = dict(map(tuple, simulate.recombined(parents.where("parent = 'm'"), parents.where("parent = 'f'"), places).collect()))
    assert got == {"1": a[:x] + b[x + 3 : y + 3].lower() + a[y:], "2": "ACGT"}


def test_inheritance(spark):
    df = spark.createDataFrame([(1, "m", "0/0"), (1, "f", "1/1"), (1, "a", "0/0"), (1, "b", "1/1"), (2, "m", "0/0"), (2, "f", "0/0"), (2, "a", "0/0"), (2, "b", None)], "site long, sample string, gt string")
    assert sorted(map(tuple, inheritance.track(df, ["site"], "m", "f").collect())) == [(1, "a", 0), (1, "b", 1), (2, "a", 1), (2, "b", 1)]
    assert sorted(map(tuple, inheritance.matrix(df, ["site"], "sample", "gt", ["a", "b", "c"]).collect())) == [(1, "0/0", "1/1", None), (2, "0/0", None, None)]


def test_principal_components(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(40, 3)) @ np.array([[2.0, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    df = spark.createDataFrame([*map(lambda r: tuple(map(float, r)), data), (None, 1.0, 2.0)], "a double, b double, c double")
    rotation, deviations = inheritance.principal_components(df, ["a", "b", "c"])
    z = (data - data.mean(axis=0)) / data.std(axis=0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(deviations, s / np.sqrt(39)) and np.allclose(np.abs(rotation), np.abs(vt.T))
    assert np.allclose(inheritance.principal_components(df.where("false"), ["a"])[1], 0)


def test_cigars(spark):
    df = spark.createDataFrame([("5M2I3M1D4M", "5A2^GT3C1"), ("", ""), (None, None)], "c string, md string")
    got = [tuple(r) for r in df.select(inheritance.cigar_places(F.col("c"), "I"), inheritance.cigar_places(F.col("c"), "D"), inheritance.cigar_sizes(F.col("c"), "M"), inheritance.reversed_cigar(F.col("c")), inheritance.mismatch_places(F.col("md"))).collect()]
    assert got == [([5], [10], [5, 3, 4], "4M1D3M2I5M", [5, 13]), ([], [], [], "", []), (None,) * 5]

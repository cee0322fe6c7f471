import gzip
import random
import struct

from pyspark.sql import functions as F

from kmerloom.functions import numbers
from kmerloom.functions import sequence as S
from kmerloom.operators import evaluate, filters, graph, haplotypes, intervals, traverse
from kmerloom.operators.kmers import counted
from kmerloom.operators.traverse import LocalGraph, build_links, contig, dfs, dfs_all, low, walk, with_neighbours
from kmerloom.sources import alignments, exports, indexed


def rows(df):
    return sorted(map(tuple, df.collect()))


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def test_numbers(spark):
    df = spark.createDataFrame([(2.0, 3, [1, 5, 5], 7.2)], "mu double, n int, a array<int>, x double")
    got = df.select(F.round(numbers.poisson(F.col("mu"), F.col("n")), 6), F.round(numbers.poisson(F.lit(50.0), F.lit(50)), 6), numbers.poisson(F.lit(0.0), F.lit(0)), numbers.which_max(F.col("a")), numbers.round_up(F.col("x"), 5), numbers.round_down(F.col("x"), 5), numbers.nearly(F.col("x"), F.lit(7.2000001)), numbers.combinations(F.array(F.lit("a"), F.lit("b"))), numbers.combinations(F.array().cast("array<int>"))).first()
    assert tuple(got) == (0.180447, 0.056325, 1.0, 1, 10, 5, True, [["a"], ["b"], ["a", "b"]], [])
    bins = spark.createDataFrame([(1, 1.0), (2, 1.0), (7, 2.0)], "value int, rate double")
    us = spark.createDataFrame([(0.0,), (0.25,), (0.26,), (0.5,), (0.99,), (1.0,)], "u double")
    assert [r["drawn"] for r in numbers.drawn(us, "u", bins).orderBy("u").collect()] == [1, 1, 2, 2, 7, 7]


def test_sequences_more(spark):
    one = spark.range(1)
    x = dna(47, 1)
    got = one.select(S.base_letter(F.lit("a")), S.base_letter(F.lit("-")), S.clean_name(F.lit("Pf3D7_01_v3"), "_v[0-9]+$"), S.kmer_array(F.lit("ACGT"), 3), S.kmer_array(F.lit("AC"), 3), S.cigar_of(F.lit("AC--GT"), F.lit("ACGGG-")), S.unpack_words(S.pack_words(F.lit(x), 47), 47), F.size(S.pack_words(F.lit(x), 47))).first()
    assert tuple(got) == ("A", "N", "Pf3D7_01", ["ACG", "CGT"], [], "2M2D1M1I", x, 2)
    s = dna(60, 2)
    turned = one.select(S.same_strand(F.lit(s), F.lit(s[10:50]), 11), S.same_strand(F.lit(s), S.reverse_complement(F.lit(s[10:50])), 11), S.same_strand(F.lit("ACGT"), F.lit("ACGT"), 4)).first()
    assert tuple(turned) == (True, False, False)


def test_haplotypes(spark):
    ref = spark.createDataFrame([("1", "AACCGGTTAC")], "chr string, seq string")
    found = haplotypes.windows(spark.createDataFrame([("1", 4, "GG", "T"), ("1", 4, "AA", "T"), ("1", 9, "CA", "T"), ("1", 0, "A", "")], "chr string, start int, ref string, alt string"), ref, 3)
    assert rows(found.select("start", "old", "new")) == [(0, "AACC", "ACC"), (4, "ACCGGTTA", "ACCTTTA")]
    assert rows(haplotypes.variant_kmers(found.where("start = 4"), "start", 5)) == [(4, low(x)) for x in sorted(("ACCTT", "CCTTT", "CTTTA"), key=low)]
    a = spark.createDataFrame([("r", 5, 1, "x"), ("r", 9, 2, "y"), ("r", 9, 1, "z")], "read string, span int, edits int, id string")
    assert rows(haplotypes.ranked(a, "read", [F.desc("span"), F.col("edits")]).select("rank", "id")) == [(1, "z"), (2, "y"), (3, "x")]
    v = spark.createDataFrame([("b", 3, "<DEL>", 1), ("b", 3, "A", 2), ("b", 3, "C", 3), ("a", 9, "A", 4)], "chr string, start int, alt string, id int")
    ranks = spark.createDataFrame([("b", 0), ("a", 1)], "chr string, rank int")
    assert [r["id"] for r in haplotypes.ordered(v, ranks, F.col("alt").startswith("<"), F.col("id")).collect()] == [2, 1, 4]
    t = [spark.createDataFrame(x, "name string, end int, contig string, mq int") for x in ([("q", 1, "m2", 9), ("q", 1, "m1", 9), ("w", 1, "m1", 9)], [("q", 1, "f", 1), ("w", 1, "f", 0)])]
    assert rows(haplotypes.merged_reads({"m": t[0], "f": t[1]})) == [("q", 1, ["m1", "m2"], ["f"])]
    k = spark.createDataFrame([(2, "aa", 5), (1, "aa", 0), (3, "bb", 7)], "read int, ck string, mq int")
    assert rows(haplotypes.mappable(spark.createDataFrame([("aa",), ("bb",), ("cc",)], "ck string"), k, "read")) == [("aa", 1, False), ("bb", 3, True), ("cc", None, False)]
    c = spark.createDataFrame([("f1", "aa", "ACGT"), ("f2", "bb", "AC")], "file string, seed string, seq string")
    assert sorted(haplotypes.seed_lengths(spark.createDataFrame([("aa",), ("bb",)], "ck string"), c, ["f1", "f2"]).collect()) == [("aa", 4, None), ("bb", None, 2)]
    marks = spark.createDataFrame([("x", 0, "a"), ("x", 1, "b"), ("x", 2, "c"), ("x", 3, "d")], "name string, pos int, ck string")
    assert rows(haplotypes.covered_part(marks, spark.createDataFrame([("b",), ("c",)], "ck string"), spark.createDataFrame([("x", "ACGTAC")], "name string, seq string"), "name", 3)) == [("x", 1, "CGTA")]
    g = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("b", 1, 1), ("c", 1, 1), ("d", 1, 0)], "ck string, color int, cov int")
    assert rows(haplotypes.walk_edges(marks, g, "name")) == [("x", 0, 0), ("x", 1, 1)]
    assert spark.range(1).select(haplotypes.remaining(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))).first()[0] == ["b"]
    assert rows(haplotypes.filter_sizes({"x": k, "y": k.where("mq > 5")})) == [("x", 3), ("y", 1)]


def test_partitions(spark):
    """Contigs of novel k-mers against walks of the in-memory graph; one contig in both directions counts once."""
    k, base = 11, dna(120, 3)
    child = [base[:60] + dna(20, 4) + base[60:], dna(50, 5)]
    samples = [(0, base), *((2, s) for s in child)]
    g = counted(spark.createDataFrame(samples, "color int, seq string"), k)
    rois = filters.novel(g, 2, [0])
    none = g.select("ck", "color", F.lit(True).alias("is_fw"), F.lit("").alias("choices")).limit(0)
    got = rows(traverse.partitions(g, traverse.color_components(g), none, rois, 2))
    novel = {r["ck"] for r in rois.collect()}
    local = LocalGraph.of(samples, k)
    want = sorted({low(contig(walk(local, x, [2]))) for x in novel})
    assert [x[0] for x in got] == want == sorted(map(low, child))
    assert all(n == len({low(s[i : i + k]) for i in range(len(s) - k + 1)} & novel) and size == len(s) for s, size, n in got)


def test_corrected(spark):
    k, s = 11, dna(60, 6)
    g = counted(spark.createDataFrame([(0, s[:30])], "color int, seq string"), k)
    fixed = traverse.corrected(g, spark.createDataFrame([(0, s[15:]), (0, None)], "color int, seq string"), k)
    want = counted(spark.createDataFrame([(0, s)], "color int, seq string"), k)
    assert rows(fixed.select("ck", "in_mask", "out_mask")) == rows(want.select("ck", "in_mask", "out_mask"))
    assert {r["ck"] for r in fixed.where("cov = 2").collect()} == {low(s[i : i + k]) for i in range(15, 20)}


def test_searches_from_many_seeds():
    k, s = 7, dna(40, 7)
    g = LocalGraph.of([(0, s), (0, s[:20] + "T" + dna(10, 8))], k)
    one = dfs(g, s[:k], "contig", [0], both=False)
    assert dfs_all(g, [s[:k], "AAAAAAA"], "contig", [0], both=False) >= one
    more = with_neighbours(g, one, [0])
    assert more >= one and all(b in g.neighbours(a, True, [0]) for a, b in more)
    assert build_links(g, [s], k, 0) is not None


def test_merged_intervals(spark):
    rng = random.Random(9)
    spans = [(rng.choice(["a", None]), s, s + rng.choice([0, 3, 40, 900])) for s in (rng.randrange(5000) for _ in range(300))]
    want = set()
    for by in ("a", None):
        open_ = None
        for _, s, z in sorted((x for x in spans if x[0] == by), key=lambda x: x[1:]):
            if open_ and s <= open_[1]:
                open_ = (open_[0], max(open_[1], z))
            else:
                want |= {(by, *open_)} if open_ else set()
                open_ = (s, z)
        want |= {(by, *open_)}
    df = spark.createDataFrame(spans + [("a", None, 3)], "by string, start int, stop int")
    for size in (10, 700, 100_000):
        assert set(map(tuple, intervals.merged(df, ["by"], size).collect())) == want


def bam(reads, refs):
    """A BAM file in two gzip members."""
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(refs))
    for name, size in refs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    body = b""
    for name, flag, ref, pos, mq, ops, seq, qual, tags in reads:
        packed = bytes(alignments.BASES.index(seq[i]) << 4 | (alignments.BASES.index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        cigar = b"".join(struct.pack("<I", n << 4 | alignments.OPERATIONS.index(o)) for n, o in ops)
        fixed = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mq, 0, len(ops), flag, len(seq), -1, -1, 0)
        r = fixed + name.encode() + b"\0" + cigar + packed + (bytes(ord(q) - 33 for q in qual) if qual else b"\xff" * len(seq)) + tags
        body += struct.pack("<i", len(r)) + r
    return gzip.compress(head) + gzip.compress(body[:40]) + gzip.compress(body[40:])


def test_bam(spark, tmp_path):
    reads = [
        ("r1", 0, 1, 9, 60, [(3, "M"), (1, "I"), (2, "M")], "ACGTNA", "IIIIII", b"XAZtext\0" + b"XBBs" + struct.pack("<ihh", 2, 1, 2) + b"NMC\x02"),
        ("r2", 4, -1, -1, 0, [], "ACG", "", b""),
    ]
    (tmp_path / "a.bam").write_bytes(bam(reads, [("c1", 100), ("c2", 50)]))
    got = alignments.read_bam(spark, str(tmp_path / "a.bam")).orderBy("name").collect()
    assert [tuple(r)[1:7] + tuple(r)[10:] for r in got] == [("r1", 0, "c2", 10, 60, "3M1I2M", "ACGTNA", "IIIIII", 2), ("r2", 4, None, 0, 0, "*", "ACG", "*", None)]


def test_indexed(spark, tmp_path):
    df = spark.createDataFrame([(dna(9, i), i) for i in range(500)], "ck string, v int")
    at = str(tmp_path / "links.parquet")
    indexed.write_indexed(df, "ck", at)
    keys = [dna(9, 3), dna(9, 77), "nothing"]
    assert {r["v"] for r in indexed.lookup(spark, at, "ck", keys).collect()} >= {3, 77}
    assert rows(indexed.lookup(spark, at, "ck", keys)) == rows(indexed.lookup(spark, at, "ck", spark.createDataFrame([(x,) for x in keys], "ck string")))
    assert indexed.lookup(spark, at, "ck", []).count() == 0 and indexed.open_links(spark, at, "s").count() == 500
    (tmp_path / "a.list").write_text("x:1\n\n# no\ny:2\n")
    assert indexed.expanded([str(tmp_path / "a.list")]) == {"x": "1", "y": "2"} and indexed.expanded(["b", "c"]) == ["b", "c"]
    (tmp_path / "t").write_text("one 1 2.5 a\none 2 3 b\n\ntwo x\n")
    assert rows(indexed.column_types(exports.read_tables(spark, str(tmp_path / "t")))) == [("one", 0, "long"), ("one", 1, "double"), ("one", 2, "string"), ("two", 0, "string")]


def test_sample_names(spark):
    colors = spark.createDataFrame([(0, "Mom"), (1, "kid"), (2, "KID")], "color int, sample_name string")
    assert [graph.color_of(colors, F.lit(x)).first()[0] for x in ("mom", "kid", "2", "none")] == [0, -1, 2, -1]
    assert evaluate.inverted(spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "ck string, r int"), "r").first()[1:] == (2, 1)

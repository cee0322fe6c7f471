import random

from pyspark.sql import functions as F

from kmerloom.operators import contigs, evaluate, filters, graph, prefilter
from kmerloom.operators.kmers import SLICE, counted, kmerize
from kmerloom.operators.traverse import LocalGraph, low, rc, walk
from kmerloom.plans.components import components


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def rows(df):
    return sorted(map(tuple, df.collect()))


def seqs(spark, samples):
    return spark.createDataFrame(samples, "color int, seq string")


def brute(samples, k):
    """The graph by plain slicing, with letters outside ACGT left out."""
    out = {}
    for color, s in samples:
        s = (s or "").upper()
        for i in range(len(s) - k + 1):
            km = s[i : i + k]
            if set(km) <= set("ACGT"):
                before, after = s[i - 1 : i] if i else "", s[i + k : i + k + 1]
                if low(km) != km:
                    before, after = (rc(x) for x in (after, before))
                x = out.setdefault((low(km), color), [0, 0, 0])
                x[0] += 1
                x[1] |= 1 << "ACGT".index(before) if before and before in "ACGT" else 0
                x[2] |= 1 << "ACGT".index(after) if after and after in "ACGT" else 0
    return {key: tuple(x) for key, x in out.items()}


def test_kernels_match_slicing(spark, monkeypatch):
    """k of one and of two words, even and odd, letters outside ACGT, lower case, texts over a slice, nulls and short texts."""
    from kmerloom.operators import kmers

    monkeypatch.setattr(kmers, "SLICE", 37)
    samples = [(0, dna(300, 1)), (0, dna(90, 2) + "N" + dna(90, 3).lower()), (1, rc(dna(300, 1))), (1, "ACGT" * 40), (2, "é" + dna(100, 4)), (2, None), (2, ""), (2, "AC"), (None, "ACGTACGTACGT" * 9)]
    for k in (4, 5, 21, 31, 32, 47, 63):
        want = brute([x for x in samples if x[0] is not None], k)
        for g in (counted(seqs(spark, samples), k), graph.build(kmerize(seqs(spark, samples), k, "seq", ("color",)).where("color is not null"))):
            assert {(r["ck"], r["color"]): (r["cov"], r["in_mask"], r["out_mask"]) for r in g.collect()} == want
    places = kmerize(seqs(spark, samples), 21, "seq", ("color",), ("pos", "km"))
    assert places.columns == ["color", "pos", "km"]
    assert rows(places.where("color = 1")) == sorted((1, i, s[i : i + 21]) for c, s in samples[:4] if c == 1 for i in range(len(s) - 20))
    assert SLICE > 37 and counted(seqs(spark, samples).limit(0), 21).count() == 0


def test_hub(spark):
    """A star of 3000 nodes, beside chains, in one node's neighbourhood."""
    edges = [(1, i) for i in range(2, 3002)] + [(5000 + i, 5001 + i) for i in range(40)]
    found = dict(rows(components(spark.createDataFrame(edges, "u long, v long"))))
    assert all(found[i] == 1 for i in range(1, 3002)) and all(found[5000 + i] == 5000 for i in range(41))


def test_walk_prefilters(spark):
    """Against walks of the in-memory graph: each novel k-mer is judged by its own walk."""
    k, base = 11, dna(400, 5)
    child = [base[:150] + dna(60, 6) + base[150:250], base[200:330] + dna(25, 7), dna(80, 8), dna(30, 9) + base[330:400]]
    other = dna(200, 12)
    child.append(other[:100] + dna(15, 13) + other[100:])
    samples = [(0, base), (0, other), *((2, s) for s in child)]
    g = counted(seqs(spark, samples), k).cache()
    own, rois = g.where("color = 2"), filters.novel(g, 2, [0])
    local, novel = LocalGraph.of(samples, k), {r["ck"] for r in rois.collect()}
    walks = {x: walk(local, x, [2]) for x in novel}
    dead = lambda km, forward: not local.neighbours(km, forward, [2])
    want = {x for x, w in walks.items() if (low(w[0]) in novel and dead(w[0], False)) or (low(w[-1]) in novel and dead(w[-1], True))}
    assert {r["ck"] for r in prefilter.tips(own, rois).collect()} == want and 0 < len(want) < len(novel)
    refs = spark.createDataFrame([("a", "1", base[:240]), ("a", "2", base[:100]), ("b", "1", other)], "background string, contig string, seq string")
    once = {r["ck"] for r in prefilter.anchors(refs, k).collect()}
    count = [low(s[i : i + k]) for s in (base[:240], base[:100], other) for i in range(len(s) - k + 1)]
    assert once == {x for x in count if count.count(x) == 1}
    loose = {x for x, w in walks.items() if not any(low(y) in once - novel for y in w)}
    anchors = prefilter.anchors(refs, k)
    assert {r["ck"] for r in prefilter.unanchored(own, rois, anchors).collect()} == loose and 0 < len(loose) < len(novel)
    contam = {low(child[2][i : i + k]) for i in range(20)}
    marks = spark.createDataFrame([(x,) for x in contam], "ck string")
    want = {x for x in loose if any(low(y) in contam & novel for y in walks[x])}
    assert {r["ck"] for r in prefilter.contamination(own, rois, marks, anchors).collect()} == want and want
    alone = {low(child[2][i : i + k]) for i in range(70)}
    assert {r["ck"] for r in prefilter.orphans(own, rois).collect()} == alone
    kept = {r["ck"] for r in prefilter.prefiltered(own, rois, 1, 0.1).collect()}
    assert kept == novel - {r["ck"] for r in prefilter.tips(own, rois).collect()} - alone - {r["ck"] for r in filters.dust(rois).collect()}


def test_end_links(spark):
    k, s = 7, dna(60, 10)
    parts = [(1, s[:30]), (2, s[24:]), (3, rc(s[24:])), (4, dna(20, 11))]
    g = counted(seqs(spark, [(2, s)]), k)
    df = spark.createDataFrame(parts, "doc_id long, seq string")
    assert rows(contigs.end_links(df, g, "doc_id", k)) == [(1, "+", 2, "+"), (1, "+", 3, "-"), (2, "-", 1, "-"), (3, "+", 1, "-")]


def test_tables_of_calls(spark):
    called = spark.createDataFrame([(1, "SNP", 5), (2, "SNP", 50), (3, "DEL", 700)], "id long, type string, length int")
    truth = spark.createDataFrame([(7, "SNP", 5), (8, "SNP", 9), (9, "INS", 2000)], "id long, type string, length int")
    found = evaluate.call_table(called, truth, spark.createDataFrame([(1, 7)], "id long, truth_id long"))
    assert rows(found.select("type", "bucket", "tp", "fp", "fn", "f1")) == [("DEL", "501-1000", 0, 1, 0, 0.0), ("INS", "1001+", 0, 0, 1, 0.0), ("SNP", "1-100", 1, 1, 1, 0.5)]
    matrix = evaluate.pair_matrix(spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "ck string, variant int"), spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "b"), ("y", "c"), ("z", "d")], "name string, ck string"), "name")
    assert rows(matrix) == [("a", "a", 1), ("a", "b", 1), ("b", "b", 1), ("b", "c", -1), ("c", "c", 1)]
    truth = spark.createDataFrame([(1, "SNP", "m", "1", 10, 10), (2, "SNP", "m", "1", 90, 90), (3, "DEL", "f", "2", 5, 9)], "variant int, type string, background string, chr string, start int, stop int")
    pairs = spark.createDataFrame([(1, 11, "m", "1", 20, 30, "SNP"), (3, 12, "m", "2", 5, 9, "INS")], "variant int, call int, c_background string, c_chr string, c_start int, c_stop int, c_type string")
    assert rows(evaluate.variant_scores(pairs, truth)) == [("DEL", 1, 1, 0, 1, 1, 1, 0), ("SNP", 2, 1, 1, 1, 1, 0, 1)]
    assert rows(evaluate.shared_percent(spark.createDataFrame([(1, "a"), (1, "b")], "k int, ck string"), spark.createDataFrame([("a",)], "ck string"), "k").select("k", F.round("percent", 1))) == [(1, 50.0)]

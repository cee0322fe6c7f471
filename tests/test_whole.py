"""Registered queries do their whole job on small folders of tables."""

import random

from kmerloom.operators.traverse import LocalGraph, build_links, contig, fill_gap, low, walk
from kmerloom.plans import queries as Q

_LETTERS = str.maketrans("ACGT", "abcd")


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def folder(spark, path, docs, truth):
    """documents (colour: id mod 3) and benchmark whose texts are dealt to the given letters."""
    spark.createDataFrame([(i, s.translate(_LETTERS)) for i, s in docs.items()], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, s.translate(_LETTERS)) for i, s in truth.items()], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_mosaics_over_two_parents(spark, tmp_path):
    docs = {0: dna(300, 1), 1: dna(300, 2), 2: dna(300, 3), 4: dna(300, 2)}
    truth = {7: docs[0][100:160] + docs[1][150:210], 8: docs[2][50:150]}
    at = folder(spark, tmp_path, docs, truth)
    rows = Q.queries()["tesserae"](spark, at).collect()
    assert {r["item_id"] for r in rows} == {7}  # the child's own document is no target
    assert [(r["name"], r["start"], r["stop"]) for r in sorted(rows, key=lambda r: r["row"])[1:]] == [("0", 100, 159), ("1", 150, 209)]
    calls = Q.queries()["variant_calls"](spark, at).where("kind = 'breakpoints'").collect()
    assert len(calls) == 2 and any("[sample1:1:" in r["alt"] for r in calls) and any("]sample0:0:" in r["alt"] for r in calls)


def test_every_kmer_is_looked_up(spark, tmp_path):
    docs, truth = {0: dna(120, 4), 1: dna(90, 5)}, {3: dna(60, 6) + dna(120, 4)[40:80], 4: dna(15, 7)}
    at, made = folder(spark, tmp_path, docs, truth), Q.queries()
    whole = {(r["item_id"], r["pos"], r["contig"], r["start"], r["strand"]) for r in made["reference_lookup"](spark, at).collect()}
    turned = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    asked = [(i, p, s[p : p + 21]) for i, s in truth.items() for p in range(len(s) - 20)]
    assert whole == {(i, p, d, a + 1, x) for i, p, km in asked for d, s in docs.items() for a in range(len(s) - 20) for x, y in (("+", km), ("-", turned(km))) if s[a : a + 21] == y}
    assert len(whole) >= 20
    short = {r["km"]: (r["places"], r["neighbours"]) for r in made["ed1_neighbours"](spark, at).collect()}
    places = [s[i : i + 8] for s in truth.values() for i in range(len(s) - 7)]
    assert short == {x: (places.count(x), 24) for x in places}


def test_every_feature_annotates(spark, tmp_path):
    """Against brute force, with genes up to 100,000 positions off, ties, empty bins and line numbers over 3."""
    rng = random.Random(8)
    lines = sorted({(rng.randrange(400_000), rng.randrange(1, 8)) for _ in range(60)})
    lines = [(o, n, rng.randrange(10), float(rng.randrange(1, 50))) for o, n in lines] + [(250_000, 6, 1, 5.0), (250_000, 7, 1, 5.0), (250_020, 4, 1, 9.0)]
    events = [(e, rng.randrange(10), "x") for e in sorted(rng.sample(range(600_000), 150))] + [(250_010, 1, "x"), (250_000, 1, "x")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").dropDuplicates(["event_id"]).write.parquet(f"{tmp_path}/events.parquet")
    feats = [(s % 5, o, o + int(q), o * 10 + n) for o, n, s, q in lines]
    got = {r["pos"]: r for r in Q.queries()["annotate_calls"](spark, str(tmp_path)).collect()}
    far = {r["pos"]: (r["distance"], r["id"]) for r in Q.queries()["nearest_feature"](spark, str(tmp_path)).collect()}
    assert set(got) == {e for e, _, _ in events}
    for pos, row in got.items():
        chr_ = next(u % 5 for e, u, _ in events if e == pos)
        over = [min((f[3] for f in feats if f[0] == chr_ and f[3] % 3 == i and f[1] <= pos <= f[2]), default=None) for i in range(3)]
        near = [(abs(f[1] - pos), f[3]) for f in feats if f[0] == chr_ and abs(f[1] - pos) <= 100_000]
        assert (row["region"], row["gene"], row["repeat"], row["genic"]) == (str(over[0]) if over[0] else "core", over[1], over[2], over[1] is not None)
        assert row["closest_gene"] == min((x for x in near if x[1] % 3 == 1), default=(0, None))[1]
        assert far.get(pos) == min(near, default=None)
    assert any(r["repeat"] for r in got.values()) and any(100 < d for d, _ in far.values())


def test_links_walks_and_gaps(spark, tmp_path):
    """Whole-table links, walks and gaps are those of the in-memory functions; links pass a repeat that stops a plain walk."""
    again, a = dna(30, 9), [dna(40, i) for i in range(10, 18)]
    docs = {0: a[0] + again + a[1] + again + a[2], 3: a[3] + again + a[4], 1: a[5] + again + a[6], 4: a[7] + again + a[6], 2: dna(80, 19)}
    truth = {5: docs[0][:60], 6: a[7] + again + a[6], 7: a[0][:30] + dna(25, 20) + a[1][5:35]}
    at, made = folder(spark, tmp_path, docs, truth), Q.queries()
    local = LocalGraph.of([(i % 3, s) for i, s in docs.items()], 21)
    links = [{}, {}, {}]
    for i, s in docs.items():
        for ck, xs in build_links(local, [s], 21, i % 3).items():
            links[i % 3].setdefault(ck, set()).update(xs)
    whole = {(ck, c, *x) for c in range(3) for ck, xs in links[c].items() for x in xs}
    assert whole and {(r["ck"], r["color"], r["is_fw"], r["choices"]) for r in made["link_build"](spark, at).collect()} == whole
    asked = [(i, p, s[p : p + 21]) for i, s in truth.items() for p in range(len(s) - 20)]
    found = {(r["item_id"], r["pos"], r["color"], r["is_fw"], r["choices"]) for r in made["link_lookup"](spark, at).collect()}
    assert found == {(i, p, c, *x) for i, p, km in asked for c in range(3) for x in links[c].get(low(km), ())}
    walks = {(r["seed"], r["color"]): r["contig"] for r in made["walk_links"](spark, at).collect()}
    seeds = {(low(km), c) for _, _, km in asked for c in range(3) if local.covered(km, [c])}
    assert walks == {(s, c): contig(walk(local, s, [c], links=links[c])) for s, c in seeds}
    assert any(len(x) > len(contig(walk(local, s, [c]))) for (s, c), x in walks.items())
    assert docs[0] in walks[low(docs[0][:21]), 0] or docs[0] in walks[low(docs[0][:21]), 0].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    gaps = {(r["item_id"], r["color"], r["start"], r["stop"]): r["seq"] for r in made["gap_fill"](spark, at).collect()}
    expected = {}
    for i, s in truth.items():
        for c in range(3):
            has = [p for j, p, km in asked if j == i and local.covered(km, [c])]
            expected |= {(i, c, x, y): fill_gap(local, s[x : x + 21], s[y : y + 21], [c]) for x, y in zip(has, has[1:]) if y > x + 1}
    assert gaps == expected and any(gaps.values())

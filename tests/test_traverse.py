from kmerloom.operators.traverse import LocalGraph, RULES, build_links, contig, dfs, fill_gap, rc, shortest_paths, walk

MOM, DAD, KID = "AGTTCTGATCTGGGCTATATGCT", "AGTTCGAATCTGGGCTATATGCT", "AGTTCTGATCTGGGCTATGGCTA"


def test_build():
    g = LocalGraph.of([(0, "AATA"), (1, "AATG")], 3)
    assert sorted(g.rows) == ["AAT", "ATA", "ATG"]
    assert g.rows["AAT"] == {0: (1, 0, 1), 1: (1, 0, 4)}
    assert g.rows["ATA"] == {0: (1, 1, 0)} and g.rows["ATG"] == {1: (1, 1, 0)}
    assert len(LocalGraph.of([(0, MOM)], 5).rows) == 19


def test_walks_by_colour():
    g = LocalGraph.of([(0, MOM), (1, DAD), (2, KID)], 5)
    assert contig(walk(g, "CTGGG", [0])) == MOM
    assert contig(walk(g, "CTGGG", [1])) == "TTCGAATCTGGGCTATATGCT"
    assert contig(walk(g, "CTGGG", [2])) == "AGTTCTGATCTGGGCTATGGCT"
    assert rc(contig(walk(g, "CCCAG", [0]))) == MOM


def test_recruitment():
    g = LocalGraph.of([(0, MOM), (1, MOM), (2, "AGTTCTG"), (2, "ATGGCTA")], 5)
    assert contig(walk(g, "GTTCT", [2], recruit=[0, 1])) == MOM
    assert contig(walk(g, "GTTCT", [2])) == "AGTTCTG"


def test_cycle_with_and_without_links():
    whole = "ACTGATTTCGATGCGATGCGATGCCACGGTGG"
    g = LocalGraph.of([(0, whole)], 5)
    assert contig(walk(g, "ACTGA", [0])) == "ACTGATTTCGATGC"
    links = build_links(g, ["TTTCGATGCGATGCGATGCCACG"], 5, 0)
    assert len(g.rows) == 21 and len(links) == 4 and sum(map(len, links.values())) == 6
    assert contig(walk(g, "ACTGA", [0], links=links)) == whole


def test_fork():
    g = LocalGraph.of([(0, "AGTTCGAATCTGGGCTATATGCT"), (0, "AGTTCGAATCTGAGCTATATGCT")], 7)
    from kmerloom.operators.traverse import extend

    assert contig(["AGTTCGA", *extend(g, "AGTTCGA", True, [0])]) == "AGTTCGAATCTG"
    assert contig([*extend(g, "ATATGCT", False, [0])[::-1], "ATATGCT"]) == "GCTATATGCT"


def test_gap_and_paths():
    mom, kid = "TGGCTAGGTCATTATGATATTAAAATGCTAGCGC", "TGGCTAGGTCATTATGAGATTAAAATGCTAGCGC"
    g = LocalGraph.of([(0, mom), (1, kid)], 7)
    assert contig(walk(g, "TGAGATT", [1])) == kid
    assert fill_gap(g, mom[:7], mom[-7:], [0]) == mom
    assert fill_gap(g, mom[:7], "AAAAAAA", [0]) is None
    paths = shortest_paths([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("b", "c")], "a", "d")
    assert paths == [["a", "b", "d"], ["a", "c", "d"], ["a", "b", "c", "d"]]


def test_every_rule_ends():
    g = LocalGraph.of([(0, MOM), (1, DAD), (2, KID)], 5)
    for name in RULES:
        facts = {"parents": [0, 1], "novel": frozenset({"ATGGC", "TGGCT"}), "sinks": frozenset({"CTATG"})}
        found = dfs(g, "CTGGG", name, [2], both=False, **facts)
        assert found is None or all(a[1:] == b[:-1] for a, b in found)
    assert dfs(g, "CTGGG", "contig", [0]) is not None

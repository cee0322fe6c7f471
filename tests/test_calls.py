import random

import pytest

from kmerloom.operators import calls
from kmerloom.operators.align import mosaic
from kmerloom.operators.traverse import low, rc

K = 21
RNG = random.Random(3)
MOM, DAD = ("".join(RNG.choice("ACGT") for _ in range(300)) for _ in range(2))
OTHER = {"A": "C", "C": "G", "G": "T", "T": "A"}


def kmers(seq):
    return {low(seq[i : i + K]) for i in range(len(seq) - K + 1)}


def found(child, targets):
    novel = kmers(child) - set().union(*map(kmers, targets.values()))
    rows = mosaic(child, targets, 0.035, 0.9, 6e-4, 0.001)[1]
    return calls.call(rows, targets, novel, K)


def brief(call):
    return call["kind"], call["start"], call["ref"], call["alt"], call["svtype"], call["background"]


def test_substitution():
    child = MOM[:150] + OTHER[MOM[150]] + MOM[151:]
    (call,) = found(child, {"mom:a": MOM})
    assert brief(call) == ("smallBubble", 150, MOM[150], OTHER[MOM[150]], "", "mom")
    assert call["hap"] in child and len(call["hap"]) >= 2 * K


@pytest.mark.parametrize("cut", [1, 6, 15])
def test_small_indels(cut):
    """Applying a call to the parent gives the child, wherever a repeat lets the gap lie."""
    for child, parent in ((MOM[:150] + MOM[150 + cut :], MOM), (MOM, MOM[:150] + MOM[150 + cut :])):
        (call,) = found(child, {"mom:a": parent})
        assert parent[: call["start"]] + call["alt"] + parent[call["start"] + len(call["ref"]) :] == child


def test_inversion():
    (call,) = found(MOM[:150] + rc(MOM[150:160]) + MOM[160:], {"mom:a": MOM})
    assert call["svtype"] == "INV"


def test_jumps():
    pair = found(MOM[:150] + DAD[150:], {"mom:a": MOM, "dad:b": DAD})
    assert [c["svtype"] for c in pair] == ["BND", "BND"] and pair[0]["mate"] == pair[1]["id"] and pair[1]["mate"] == pair[0]["id"]
    assert pair[0]["alt"].startswith(pair[0]["ref"] + "[dad:b:")
    (skip,) = found(MOM[:100] + MOM[200:], {"mom:a": MOM})
    assert (skip["kind"], skip["alt"][1:]) == ("largeBubble", MOM[100:200])
    (both,) = found(MOM[:120] + DAD[120:180] + MOM[180:], {"mom:a": MOM, "dad:b": DAD})
    assert both["kind"] == "doubleBreakpoint" and both["svtype"] == "MNP"
    assert both["ref"] == MOM[119:180] and both["alt"] == MOM[119] + DAD[120:180]


def test_no_novel_kmers_no_call():
    assert found(MOM, {"mom:a": MOM}) == []
    assert calls.call([("query", "ACGT", 0, 3)], {}, set(), K) == []


def test_call_variants(spark):
    child = MOM[:150] + OTHER[MOM[150]] + MOM[151:]
    novel = sorted(kmers(child) - kmers(MOM))
    data = [(1, child, {"mom:a": MOM}, novel, 1000), (2, child, {"mom:a": MOM}, novel, None), (3, None, None, None, 0), (4, "", {}, [], 0), (5, child, {"mom:a": None}, novel, 0)]
    df = spark.createDataFrame(data, "contig long, query string, targets map<string,string>, novel array<string>, offset long")
    got = sorted((r["contig"], r["pos"], r["ref"], r["alt"], r["call_id"]) for r in calls.call_variants(df, "contig", K).collect())
    assert got == [(1, 1150, MOM[150], OTHER[MOM[150]], "1.1"), (2, 150, MOM[150], OTHER[MOM[150]], "2.1")]
    assert calls.call_variants(df.where("false"), "contig", K).count() == 0

"""Each stopping rule's outcome (succeeded, failed) at steps of one branch, as its definition gives it."""

import pytest

from kmerloom.operators.traverse import RULES, LocalGraph, State, rc

#: A k-mer of a parent and the child, one of the child that is novel, one of the child only, and one of nobody.
BOTH, NOVEL, OWN, NONE = "AACCG", "TTTGA", "CACAC", "GGGGA"
GRAPH = LocalGraph([("AACCG", 0, 3, 1, 1), ("AACCG", 2, 3, 1, 1), (min(NOVEL, rc(NOVEL)), 2, 4, 1, 1), (min(OWN, rc(OWN)), 2, 4, 1, 1)])
GO, DONE, FAIL, EACH = (False, False), (True, False), (False, True), (True, True)
STEADY = {"n": 1, "ins": 1, "outs": 1}


def step(km, **facts):
    return {"km": km, **STEADY, **facts}


CASES = [
    ("contig", [(step(OWN), GO), (step(OWN, n=2), DONE), (step(OWN, n=0), DONE), (step(OWN, size=9, longest=9), DONE)]),
    ("cycle_collapsing_contig", [(step(OWN), GO), (step(OWN, n=2), GO), (step(OWN, n=0), DONE)]),
    ("destination", [(step(OWN, sinks=frozenset({OWN})), DONE), (step(OWN, depth=6), GO), (step(OWN, depth=7), FAIL), (step(OWN, depth=3, size=70_000), FAIL), (step(OWN, depth=2, size=70_000), GO), (step(OWN, size=75_000), FAIL)]),
    ("paired_read_closing", [(step(OWN, sinks=frozenset({rc(OWN)})), DONE), (step(OWN, depth=4), GO), (step(OWN, depth=5), FAIL), (step(OWN, n=0), FAIL)]),
    ("bubble_opening", [(step(OWN, depth=4), GO), (step(OWN, depth=5), FAIL), (step(OWN, n=0), FAIL), (step(NOVEL), GO), (step(NOVEL, n=2), GO), (step(BOTH), GO), (step(BOTH, n=2), DONE)]),
    ("bubble_opening", [(step(NOVEL), GO), *[(step(BOTH), GO)] * 30, (step(BOTH), DONE)]),
    ("bubble_closing", [(step(OWN, size=10_000, depth=1), GO), (step(OWN, size=10_001), FAIL), (step(OWN, depth=2), FAIL), (step(OWN, n=0), FAIL)]),
    ("gap_closing", [(step(OWN, depth=5), GO), (step(OWN, depth=6), FAIL), (step(OWN, n=0), FAIL)]),
    ("contaminant", [(step(OWN), GO), (step(OWN, n=0), DONE), (step(BOTH), EACH), (step(NONE, n=0), GO)]),
    ("orphan", [(step(OWN), GO), (step(OWN, ins=0), DONE), (step(OWN, outs=0), DONE), (step(BOTH), FAIL)]),
    ("tip_beginning", [(step(OWN), GO), (step(OWN, outs=0), FAIL), (step(BOTH), DONE)]),
    ("tip_end", [(step(OWN), GO), (step(OWN, outs=0), DONE), (step(BOTH), FAIL)]),
    ("dust", [(step(OWN, ins=3, outs=2), GO), *[(step(OWN), GO)] * 4, (step(OWN), FAIL), (step(OWN, ins=3, outs=2), GO), (step(BOTH), DONE), (step(OWN, ins=0), DONE)]),
    ("exploration", [(step(OWN, depth=2), GO), (step(OWN, depth=3), DONE), (step(OWN, n=0), DONE), (step(OWN, size=75_000), DONE)]),
    ("visualization", [(step(OWN, depth=2, size=500), GO), (step(OWN, depth=3), DONE), (step(OWN, size=501), DONE), (step(OWN, n=0), DONE)]),
    ("nahr", [(step(OWN, depth=1, size=999), GO), (step(OWN, depth=2), FAIL), (step(OWN, size=1000), FAIL), (step(OWN, n=0), FAIL), (step(NOVEL, depth=4), GO), (step(OWN, depth=5), DONE), (step(OWN, n=0), DONE), (step(OWN, children_done=True), DONE)]),
    ("novel_continuation", [(step(OWN), GO), (step(OWN, n=2, children_done=True), DONE), (step(OWN, size=75_000), DONE), (step(OWN, depth=1), FAIL), (step(NOVEL, depth=1), GO), *[(step(OWN, depth=1), GO)] * 10, (step(OWN, depth=1), FAIL), (step(NOVEL, depth=4), FAIL)]),
    ("novel_aggregation", [(step(BOTH, size=99), GO), (step(BOTH, size=100), FAIL), (step(BOTH, depth=3), FAIL), (step(OWN, depth=3), GO), (step(BOTH), DONE)]),
    ("novel_limited_contig", [(step(OWN, n=2), GO), (step(NOVEL), GO), (step(OWN), GO), (step(OWN, n=0), DONE), (step(OWN, size=75_000), DONE)]),
    ("novel_limited_contig", [(step(NOVEL), GO), *[(step(OWN), GO)] * 2000, (step(OWN), DONE)]),
    ("novel_partition", [(step(OWN), GO), (step(OWN, n=2), GO), (step(OWN, depth=1), FAIL), (step(OWN, n=0), FAIL), (step(OWN, n=2, children_done=True), FAIL), (step(NOVEL), GO), (step(OWN, depth=1), DONE), (step(OWN, n=0), DONE)]),
]


@pytest.mark.parametrize(("rule", "steps"), CASES)
def test_outcomes(rule, steps):
    memory: dict = {}
    for i, (facts, expected) in enumerate(steps):
        facts = dict(facts)
        state = State(GRAPH, facts.pop("km"), [2], parents=[0], novel=frozenset({min(NOVEL, rc(NOVEL))}), memory=memory, **facts)
        found = RULES[rule](state)
        assert (bool(found[0]), bool(found[1])) == expected, (rule, i)


def test_every_rule_has_a_case():
    assert {x for x, _ in CASES} == set(RULES)

"""Variant calls from mosaics: the child's contig against segments of parental sequences, column by column.

A mosaic's first row is the child, the others are its segments in order. Columns where the two differ inside novel regions
are small bubbles; jumps between segments are insertions, repeats or pairs of breakends.
"""

from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.operators.align import mosaic
from kmerloom.operators.traverse import low, rc

FIELDS = ["kind", "start", "stop", "ref", "alt", "svtype", "background", "id", "mate", "hap"]
SCHEMA = "array<struct<kind:string,start:long,stop:long,ref:string,alt:string,svtype:string,background:string,id:string,mate:string,hap:string>>"


class Columns:
    """A mosaic by columns: child letter, parent letter and segment; a segment ends where the next one begins."""

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        self.child, self.segments = rows[0][1], rows[1:]
        self.width = len(self.child)
        self.parent, self.segment = [" "] * self.width, [-1] * self.width
        for s, (_, text, _, _) in enumerate(self.segments):
            for c, letter in enumerate(text[: self.width]):
                if letter != " ":
                    self.parent[c], self.segment[c] = letter.upper(), s

    def background(self, column: int) -> str:
        s = self.segment[min(max(column, 0), self.width - 1)]
        return self.segments[s][0].split(":")[0] if s >= 0 else "unknown"

    def jumps(self) -> list[tuple[int, int, int]]:
        """(column, segment, next segment): the last column before each jump."""
        return [(c, a, b) for c, (a, b) in enumerate(zip(self.segment, self.segment[1:])) if a != b and a >= 0 and b >= 0]

    def letter(self, column: int, step: int) -> str:
        """The parent's first letter at or beyond a column."""
        while 0 <= column < self.width and self.parent[column] in "- ":
            column += step
        return self.parent[column] if 0 <= column < self.width else "N"

    def texts(self, a: int, z: int) -> tuple[str, str]:
        """Parent and child letters of columns a to z - 1, gaps left out."""
        pick = lambda s: "".join(x for x in s[a:z] if x not in "- ")
        return pick(self.parent), pick(self.child)

    def hap(self, region: tuple[int, int], k: int) -> str:
        """The child's letters of a region with k more on each side."""
        a, z, more = region[0], region[1] + 1, k
        while a > 0 and more:
            a -= 1
            more -= self.child[a] != "-"
        more = k
        while z < self.width and more:
            more -= self.child[z] != "-"
            z += 1
        return self.child[a:z].replace("-", "")


def novel_regions(columns: Columns, novel: set[str], k: int) -> list[tuple[int, int]]:
    """Closed runs of columns that novel k-mers of the child cover, grown over gaps beside them."""
    at = [c for c, x in enumerate(columns.child) if x != "-"]
    seq = "".join(columns.child[c] for c in at)
    marks = [False] * columns.width
    for i in range(len(seq) - k + 1):
        if low(seq[i : i + k]) in novel:
            for c in range(at[i], at[i + k - 1] + 1):
                marks[c] = True
    gap = [columns.child[c] == "-" or columns.parent[c] == "-" for c in range(columns.width)]
    for order in (range(1, columns.width), range(columns.width - 2, -1, -1)):
        step = 1 if order.step > 0 else -1
        for c in order:
            marks[c] |= gap[c] and marks[c - step]
    runs = [[c for c, _ in g] for on, g in groupby(enumerate(marks), key=lambda x: x[1]) if on]
    return [(r[0], r[-1]) for r in runs]


def _call(columns: Columns, kind: str, start: int, stop: int, ref: str, alt: str, region: tuple[int, int], k: int, svtype: str = "", **more: str) -> dict:
    base = {"kind": kind, "start": start, "stop": stop, "ref": ref, "alt": alt, "svtype": svtype, "id": "", "mate": "", "hap": columns.hap(region, k)}
    return {**base, "background": columns.background(start), **more}


def small_bubbles(columns: Columns, regions: list[tuple[int, int]], k: int) -> list[dict]:
    """Runs of unlike columns in novel regions. Unlike lengths take the letter before; a run at an end of the alignment is a
    breakend with a dot on its open side."""
    out = []
    for region in regions:
        a, z = region
        for unlike, group in groupby(range(a, z + 1), key=lambda c: columns.child[c].upper() != columns.parent[c]):
            run = list(group)
            first, after = run[0], run[-1] + 1
            if not unlike or (after > z and after < columns.width):
                continue  # a run that its region cuts off is not explained by novel k-mers
            ref, alt = columns.texts(first, after)
            if first == 0 or after == columns.width:
                alt = "." + alt if first == 0 else columns.child[first - 1] + alt + "."
                ref = ref if first == 0 else columns.child[first - 1] + ref
                if first == 0 and after < columns.width:
                    alt, ref = alt + columns.child[after], ref + columns.child[after]
                out.append(_call(columns, "smallBubble", first, after, ref, alt, region, k, "BND", background=columns.background(min(after, columns.width - 1) if first == 0 else first - 1)))
            elif len(ref) == len(alt) == 1:
                out.append(_call(columns, "smallBubble", first, after, ref, alt, region, k, background=columns.background(first - 1)))
            else:
                before = columns.letter(first - 1, -1)
                out.append(_call(columns, "smallBubble", first - 1, after, before + ref, before + alt, region, k))
    return out


def jump_calls(columns: Columns, regions: list[tuple[int, int]], targets: dict[str, str], k: int, name: str = "") -> list[dict]:
    """Calls at jumps in novel regions. Within one target a jump ahead gives the letters passed over as the other allele and
    a jump back over the same extent a repeat of it; between targets it gives two breakends that name each other."""
    out = []
    for column, a, b in columns.jumps():
        region = next((r for r in regions if r[0] <= column <= r[1]), None)
        if region is None:
            continue
        (name0, _, start0, stop0), (name1, _, start1, stop1) = columns.segments[a], columns.segments[b]
        before, after = columns.letter(column, -1), columns.letter(column + 1, 1)
        if name0 != name1:
            ids = f"{name}bnd{column}a", f"{name}bnd{column}b"
            out.append(_call(columns, "breakpoints", column, column + 1, before, f"{before}[{name1}:{start1}[", region, k, "BND", id=ids[0], mate=ids[1]))
            out.append(_call(columns, "breakpoints", column + 1, column + 2, after, f"]{name0}:{stop0}]{after}", region, k, "BND", id=ids[1], mate=ids[0]))
        elif start1 > stop0 + 1:
            out.append(_call(columns, "largeBubble", column, column + 1, before, before + targets[name0][stop0 + 1 : start1], region, k))
        elif (start0, stop0) == (start1, stop1):
            out.append(_call(columns, "repeats", column, column + 1, before, before + targets[name0][start0 : stop0 + 1], region, k))
    return out


def merge_near(columns: Columns, calls: list[dict], within: int = 10) -> list[dict]:
    """Neighbouring calls without breakends under `within` columns apart as one; the turned parent's letters are an inversion."""
    out: list[dict] = []
    waiting = sorted(calls, key=lambda c: (c["start"], c["stop"]))
    while waiting:
        call = waiting.pop(0)
        other = waiting[0] if waiting else None
        if other and not call["svtype"] and not other["svtype"] and {call["kind"], other["kind"]} == {"smallBubble"} and other["start"] - call["stop"] < within:
            ref, alt = columns.texts(call["start"], other["stop"])
            if ref and alt:
                call = {**call, "stop": other["stop"], "ref": ref, "alt": alt}
                waiting.pop(0)
                same = 0
                while same < min(len(ref), len(alt)) - 1 and ref[same] == alt[same]:
                    same += 1
                if len(ref) == len(alt) > 1 and any(alt[i:] == rc(ref[i:]) for i in range(same + 1)):
                    call["svtype"] = "INV"
        out.append(call)
    return out


def merge_breakends(columns: Columns, calls: list[dict]) -> list[dict]:
    """Two pairs of breakends that leave a background and come back to it as one call of the letters between them."""
    pairs = [(a, b) for a, b in zip(calls, calls[1:]) if a["kind"] == b["kind"] == "breakpoints" and a["mate"] == b["id"]]
    drop, made, done = set(), [], -1
    for i, (out0, in0) in enumerate(pairs):
        if i <= done:
            continue
        for j in range(i + 1, len(pairs)):
            in1, out1 = pairs[j]
            left, right = columns.segment[out0["start"]], columns.segment[out1["start"]]
            inner = columns.segment[in0["start"]]
            if columns.background(out0["start"]) != columns.background(out1["start"]) or inner != columns.segment[in1["start"]]:
                continue
            (name0, _, _, stop0), (name1, _, start1, _) = columns.segments[left], columns.segments[right]
            ref, alt = "", columns.texts(in0["start"], in1["start"] + 1)[1]
            if name0 == name1 and start1 > stop0:
                ref = columns.targets[name0][stop0 + 1 : start1]
            turned = columns.segments[inner][0].endswith("-") != name0.endswith("-")
            kind = "INV" if turned and ref and rc(ref) == alt else "MNP" if len(ref) == len(alt) else "INS" if len(alt) > len(ref) else "DEL"
            if ref != alt:
                made.append({**out0, "kind": "doubleBreakpoint", "stop": out1["stop"], "ref": out0["ref"] + ref, "alt": out0["ref"] + alt, "svtype": kind, "mate": ""})
                drop |= {x["id"] for x in (out0, in0, in1, out1)}
                done = j
                break
    return sorted([c for c in calls if not c["id"] or c["id"] not in drop] + made, key=lambda c: (c["start"], c["stop"], c["kind"]))


def call(rows: list[tuple[str, str, int, int]], targets: dict[str, str], novel: set[str], k: int, name: str = "") -> list[dict]:
    """All calls of one mosaic, in order of columns; calls with like alleles are dropped."""
    if len(rows) < 2:
        return []
    columns = Columns(rows)
    columns.targets = targets
    regions = novel_regions(columns, novel, k)
    small = merge_near(columns, small_bubbles(columns, regions, k))
    found = sorted(small + jump_calls(columns, regions, targets, k, name), key=lambda c: (c["start"], c["stop"], c["kind"]))
    found = [c for c in found if c["ref"] != c["alt"]]
    return merge_breakends(columns, found)


def call_variants(sections: DataFrame, key: str, k: int, gap: float = 0.025, extend: float = 0.75, jump: float = 1e-4, end: float = 1e-3) -> DataFrame:
    """(key, call_id, pos, end, kind, ref, alt, svtype, background, id, mate, hap) of sections (key, query, targets, novel, offset).

    targets maps names to parental sequences, novel lists canonical novel k-mers, offset is the section's place in its
    contig. One section is one row, so tasks hold a batch of sections; null or empty queries and targets give no call. Calls
    at the same place of a section with equal alleles are one. call_id is `key.n`, in order within the section.
    """

    def run(query: pd.Series, targets: pd.Series, novel: pd.Series) -> pd.Series:
        out = []
        for q, t, n in zip(query, targets, novel):
            known = {a: b for a, b in dict(t if t is not None else {}).items() if b}
            rows = mosaic(q, known, gap, extend, jump, end)[1] if q and known else []
            out.append([{f: c[f] for f in FIELDS} for c in call(rows, known, set(n if n is not None else ()), k)])
        return pd.Series(out)

    found = F.pandas_udf(run, SCHEMA)("query", "targets", "novel")
    rows = sections.select(key, F.coalesce("offset", F.lit(0)).alias("_at"), F.explode(found).alias("c"))
    rows = rows.select(key, (F.col("_at") + F.col("c.start")).alias("pos"), (F.col("_at") + F.col("c.stop")).alias("end"), *[f"c.{f}" for f in FIELDS if f not in ("start", "stop")])
    rows = rows.dropDuplicates([key, "pos", "ref", "alt", "svtype"])
    order = Window.partitionBy(key).orderBy("pos", F.col("svtype") != "", "ref", "alt", "svtype")
    return rows.withColumn("call_id", F.concat_ws(".", F.col(key).cast("string"), F.row_number().over(order).cast("string")))

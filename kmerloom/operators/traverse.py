"""Walks on a local graph: neighbours by colour, link-guided steps, depth-first search with stopping rules.

The kernel holds the rows of one component; `walk_seeds` ships components to executors and walks every seed there.
"""

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions import masks
from kmerloom.functions.sequence import canonical, complement
from kmerloom.operators.graph import counted, next_kmers
from kmerloom.plans.components import components
from kmerloom.plans.runtime import cut

_SWAP = str.maketrans("ACGT", "TGCA")


def rc(s: str) -> str:
    return s.translate(_SWAP)[::-1]


def comp(s: str) -> str:
    return s.translate(_SWAP)


def low(s: str) -> str:
    return min(s, rc(s))


class LocalGraph:
    """Rows (ck, color, cov, in_mask, out_mask) as a dictionary, with neighbours in any direction."""

    def __init__(self, rows: Iterable[tuple]):
        self.rows: dict[str, dict[int, tuple[int, int, int]]] = {}
        for ck, color, cov, ins, outs in rows:
            self.rows.setdefault(ck, {})[color] = (cov, ins, outs)

    @classmethod
    def of(cls, samples: list[tuple[int, str]], k: int) -> "LocalGraph":
        """The graph of (colour, sequence) pairs."""
        made: dict[tuple[str, int], list[int]] = {}
        for color, seq in samples:
            for i in range(len(seq) - k + 1):
                km = seq[i : i + k]
                before, after = seq[i - 1 : i] if i else "", seq[i + k : i + k + 1]
                if low(km) != km:
                    before, after = comp(after), comp(before)
                row = made.setdefault((low(km), color), [0, 0, 0])
                row[0] += 1
                row[1] |= 1 << "ACGT".index(before) if before else 0
                row[2] |= 1 << "ACGT".index(after) if after else 0
        return cls((ck, c, *x) for (ck, c), x in made.items())

    def covered(self, km: str, colors: Iterable[int]) -> bool:
        row = self.rows.get(low(km), {})
        return any(row.get(c, (0,))[0] > 0 for c in colors)

    def _masks(self, km: str, color: int) -> tuple[str, str]:
        _, ins, outs = self.rows.get(low(km), {}).get(color, (0, 0, 0))
        a, b = ("".join(x for i, x in enumerate("ACGT") if m >> i & 1) for m in (ins, outs))
        return (a, b) if low(km) == km else (comp(b), comp(a))

    def neighbours(self, km: str, forward: bool, colors: Iterable[int], recruit: Iterable[int] = ()) -> list[str]:
        """Next (or previous) k-mers over the colours; over the recruitment colours only if these have none."""
        for group in (colors, recruit):
            found = sorted({km[1:] + b if forward else b + km[:-1] for c in group for b in self._masks(km, c)[1 if forward else 0]})
            if found:
                return found
        return []


def build_links(graph: LocalGraph, reads: Iterable[str], k: int, color: int) -> dict[str, set[tuple[bool, str]]]:
    """Junction choices of reads: canonical k-mer -> {(the k-mer was canonical, bases chosen at the forks that follow)}."""
    links: dict[str, set[tuple[bool, str]]] = {}
    for read in reads:
        for s in (read, rc(read)):
            kmers = [s[i : i + k] for i in range(len(s) - k + 1)]
            forks = [len(graph.neighbours(x, True, [color])) > 1 for x in kmers]
            joins = [len(graph.neighbours(x, False, [color])) > 1 for x in kmers]
            for i in range(1, len(kmers)):
                if joins[i]:
                    chosen = "".join(kmers[j][-1] for j in range(i, len(kmers)) if forks[j - 1] and j >= i)
                    if chosen:
                        links.setdefault(low(kmers[i - 1]), set()).add((low(kmers[i - 1]) == kmers[i - 1], chosen))
    return links


@dataclass
class LinkStore:
    """Links picked up on the way. The oldest vote at a fork and must agree; those that agree move on, others go."""

    held: list[list] = field(default_factory=list)  # [bases, position, age]

    def add(self, km: str, links: dict, forward: bool) -> None:
        for canonical_start, bases in sorted(links.get(low(km), ())):
            agrees = (low(km) == km) == canonical_start
            if agrees == forward:
                text = bases if agrees else comp(bases)
                if not any(x[0] == text and x[1] == 0 and x[2] == 0 for x in self.held):
                    self.held.append([text, 0, 0])

    def choose(self) -> str | None:
        if not self.held:
            return None
        oldest = max(x[2] for x in self.held)
        bases = {x[0][x[1]] for x in self.held if x[2] == oldest}
        if len(bases) != 1:
            return None
        base = bases.pop()
        self.held = [[t, p + 1, a] for t, p, a in self.held if t[p] == base and p + 1 < len(t)] if base else []
        return base

    def age(self) -> None:
        for x in self.held:
            x[2] += 1

    @property
    def new(self) -> bool:
        return any(x[2] == 0 for x in self.held)


def extend(graph: LocalGraph, seed: str, forward: bool, colors: list[int], recruit: Iterable[int] = (), links: dict | None = None, most: int = 75_000) -> list[str]:
    """The k-mers after (or before) a seed: while one neighbour is unseen, or links say which way to go."""
    cur, seen, out, store = seed, set(), [], LinkStore()
    links = links or {}
    store.add(cur, links, forward)
    while len(out) < most:
        options = graph.neighbours(cur, forward, colors, recruit)
        seen.add(cur)
        fresh = [x for x in options if x not in seen]
        chosen = None
        if len(options) == 1 and (fresh or store.held):
            chosen = options[0]
            forked = False
        elif len(options) > 1 and store.held:
            forked = True
            base = store.choose()
            want = None if base is None else (cur[1:] + base if forward else base + cur[:-1])
            chosen = want if want in options else None
            store.age()
        elif len(fresh) == 1:
            chosen, forked = fresh[0], False
        if chosen is None:
            break
        cur = chosen
        out.append(cur)
        store.add(cur, links, forward)
        if not forked and store.new or forked and store.new:
            store.age()
    return out


def walk(graph: LocalGraph, seed: str, colors: list[int], **options) -> list[str]:
    """The contig's k-mers around a seed; empty if the colours (or recruitment colours) do not cover it."""
    if not graph.covered(seed, [*colors, *options.get("recruit", ())]):
        return []
    back = [rc(x) for x in extend(graph, rc(seed), True, colors, **options)]
    return [*back[::-1], seed, *extend(graph, seed, True, colors, **options)]


def contig(kmers: list[str]) -> str:
    return kmers[0] + "".join(x[-1] for x in kmers[1:]) if kmers else ""


@dataclass
class State:
    """What a stopping rule sees at a vertex."""

    graph: LocalGraph
    km: str
    colors: list[int]
    parents: list[int] = field(default_factory=list)
    novel: frozenset = frozenset()
    sinks: frozenset = frozenset()
    n: int = 0
    depth: int = 0
    size: int = 0
    longest: int = 75_000
    children_done: bool = False
    ins: int = 0
    outs: int = 0
    #: Kept along one branch: whether a novel k-mer was met and how far back it and the last other mark are.
    memory: dict = field(default_factory=dict)

    @property
    def inherited(self) -> bool:
        return self.graph.covered(self.km, self.parents)

    @property
    def is_novel(self) -> bool:
        return low(self.km) in self.novel

    @property
    def over(self) -> bool:
        return self.size >= self.longest

    @property
    def dead_end(self) -> bool:
        return self.ins == 0 or self.outs == 0


def _since(s: State) -> int:
    """Notes novel k-mers; steps since the last one, -1 before the first."""
    s.memory["since"] = 0 if s.is_novel else s.memory["since"] + 1 if s.memory.get("since", -1) >= 0 else -1
    return s.memory["since"]


def _bubble_opening(s: State) -> tuple[bool, bool]:
    found = _since(s) >= 0
    if found and s.inherited:
        s.memory["joined"] = s.memory.get("joined", -1) + 1
    return found and s.memory.get("joined", -1) >= 0 and (s.memory["joined"] >= 30 or s.n != 1), not found and (s.depth >= 5 or s.n == 0)


def _dust(s: State) -> tuple[bool, bool]:
    s.memory["plain"] = 0 if s.ins + s.outs > 4 else s.memory.get("plain", 0) + 1
    return s.dead_end or s.inherited, s.memory["plain"] >= len(s.km)


def _partition(s: State) -> tuple[bool, bool]:
    since = _since(s)
    s.memory["steps"] = s.memory.get("steps", 0) + 1
    stop = (since if since >= 0 else s.memory["steps"]) > 2000 or s.depth > 0 or s.over or s.n == 0 or s.n > 1 and s.children_done
    return since >= 0 and stop, since < 0 and stop


def _nahr(s: State) -> tuple[bool, bool]:
    found = _since(s) >= 0
    return found and (s.memory["since"] >= 1000 or s.depth >= 5 or s.n == 0 or s.children_done), not found and (s.size >= 1000 or s.depth >= 2 or s.n == 0)


def _aggregation(s: State) -> tuple[bool, bool]:
    if not s.inherited and s.graph.covered(s.km, s.colors):
        s.memory["own"] = True
    return bool(s.memory.get("own")) and s.inherited, not s.memory.get("own") and (s.size >= 100 or s.depth >= 3)


def _limited(s: State) -> tuple[bool, bool]:
    since = _since(s)
    return since >= 0 and (since > 2000 or s.n != 1 or s.over), False


def _continuation(s: State) -> tuple[bool, bool]:
    since = _since(s)
    return s.children_done and s.n != 1 or s.over, s.depth > 0 and (since < 0 or since > 2 * len(s.km)) or s.depth > 3


#: name -> rule(state) -> (succeeded, failed)
RULES: dict[str, Callable[[State], tuple[bool, bool]]] = {
    "contig": lambda s: (s.n != 1 or s.over, False),
    "cycle_collapsing_contig": lambda s: (s.n == 0, False),
    "destination": lambda s: (s.km in s.sinks, s.depth > 1 + math.ceil(5 * math.exp(-1e-4 * s.size)) or s.over),
    "paired_read_closing": lambda s: (low(s.km) in {low(x) for x in s.sinks}, s.depth >= 5 or s.n == 0 or s.over),
    "bubble_opening": _bubble_opening,
    "bubble_closing": lambda s: (False, s.size > 10_000 or s.depth >= 2 or s.n == 0),
    "gap_closing": lambda s: (False, s.depth > 5 or s.n == 0),
    "contaminant": lambda s: (low(s.km) in s.graph.rows and (s.inherited or s.n == 0), low(s.km) in s.graph.rows and s.inherited),
    "orphan": lambda s: (s.dead_end, s.inherited),
    "tip_beginning": lambda s: (s.inherited, s.dead_end),
    "tip_end": lambda s: (s.dead_end, s.inherited),
    "dust": _dust,
    "exploration": lambda s: (s.over or s.n == 0 or s.depth >= 3, False),
    "visualization": lambda s: (s.n == 0 or s.depth > 2 or s.size > 500, False),
    "nahr": _nahr,
    "novel_continuation": _continuation,
    "novel_aggregation": _aggregation,
    "novel_limited_contig": _limited,
    "novel_partition": _partition,
}


def search(graph: LocalGraph, seed: str, rule: str, forward: bool, colors: list[int], recruit: Iterable[int] = (), depth: int = 0, path: frozenset = frozenset(), **facts) -> set[tuple[str, str]] | None:
    """Edges of one branch and of the accepted branches after its junction; None if the rule does not accept them.

    Every branch has its own rule memory and its own set of visited k-mers; recursion is as deep as junctions are nested.
    """
    cur, seen, edges, size, memory = seed, set(path), set(), 0, {}
    while True:
        options = [x for x in graph.neighbours(cur, forward, colors, recruit) if x not in seen]
        seen.add(cur)
        ins, outs = (len(graph.neighbours(cur, d, colors)) for d in (False, True))
        state = State(graph, cur, colors, n=len(options), depth=depth, size=size, ins=ins, outs=outs, memory=memory, **facts)
        done, failed = RULES[rule](state)
        if failed:
            return None
        if done:
            return edges
        if not options:
            return None
        if len(options) == 1:
            edges.add((cur, options[0]) if forward else (options[0], cur))
            cur, size = options[0], size + 1
            continue
        accepted = False
        for x in options:
            below = search(graph, x, rule, forward, colors, recruit, depth + 1, frozenset(seen), **facts)
            if below is not None:
                accepted = True
                edges |= below | {(cur, x) if forward else (x, cur)}
        if accepted:
            return edges
        state.children_done = True
        return edges if RULES[rule](state)[0] else None


def dfs(graph: LocalGraph, seed: str, rule: str, colors: list[int], both: bool = True, recruit: Iterable[int] = (), **facts) -> set[tuple[str, str]] | None:
    """The subgraph around a seed: reverse and forward branches, both accepted if `both`, any otherwise."""
    found = [search(graph, seed, rule, d, colors, recruit, **facts) for d in (False, True)]
    if both and None in found or found == [None, None]:
        return None
    return set().union(*(x for x in found if x))


def fill_gap(graph: LocalGraph, start: str, stop: str, colors: list[int], most: int = 1000) -> str | None:
    """The shortest path of colours from one k-mer to another, as a sequence; ties go to the lower k-mer."""
    seen, layer = {start: None}, [start]
    for _ in range(most):
        if stop in seen or not layer:
            break
        after = []
        for x in layer:
            for y in graph.neighbours(x, True, colors):
                if y not in seen:
                    seen[y] = x
                    after.append(y)
        layer = after
    if stop not in seen:
        return None
    path = [stop]
    while seen[path[-1]] is not None:
        path.append(seen[path[-1]])
    return contig(path[::-1])


def shortest_paths(edges: Iterable[tuple[str, str]], start: str, stop: str, count: int = 10, must: frozenset = frozenset(), without: frozenset = frozenset()) -> list[list[str]]:
    """Up to `count` loopless paths by length, then order (Yen's method); only those through all of `must` and none of `without`."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)

    def best(source: str, closed: set, barred: set) -> list[str] | None:
        before, layer = {source: None}, [source]
        while layer and stop not in before:
            after = []
            for x in sorted(layer):
                for y in sorted(out.get(x, ())):
                    if y not in before and y not in closed and (x, y) not in barred:
                        before[y] = x
                        after.append(y)
            layer = after
        if stop not in before:
            return None
        path = [stop]
        while before[path[-1]] is not None:
            path.append(before[path[-1]])
        return path[::-1]

    first = best(start, set(), set())
    found, waiting = ([first] if first else []), []
    while found and len(found) < count:
        for i in range(len(found[-1]) - 1):
            root = found[-1][: i + 1]
            barred = {(p[i], p[i + 1]) for p in found if p[: i + 1] == root and len(p) > i + 1}
            rest = best(root[-1], set(root[:-1]), barred)
            if rest and (path := root[:-1] + rest) not in waiting and path not in found:
                waiting.append(path)
        if not waiting:
            break
        waiting.sort(key=lambda p: (len(p), p))
        found.append(waiting.pop(0))
    return [p for p in found if must <= set(p) and not without & set(p)]


def walk_seeds(rows: DataFrame, seeds: DataFrame, colors: list[int], recruit: list[int] | None = None, component: str = "component") -> DataFrame:
    """(seed, contig) of each seed (component, seed) over graph rows (component, ck, color, cov, in_mask, out_mask).

    A component's rows meet in one task; cut giant components into unitigs first.
    """

    def kernel(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        graph = LocalGraph(left[["ck", "color", "cov", "in_mask", "out_mask"]].itertuples(index=False, name=None))
        return pd.DataFrame({"seed": right["seed"], "contig": [contig(walk(graph, s, colors, recruit=recruit or ())) for s in right["seed"]]})

    seeds = seeds.select(F.col(component).alias("_at"), "seed")
    return rows.groupBy(component).cogroup(seeds.groupBy("_at")).applyInPandas(kernel, "seed string, contig string")


def graph_components(graph: DataFrame, colors: list[int]) -> DataFrame:
    """(ck, component): connected k-mers of the colours; 64-bit hashes of k-mers are the nodes."""
    own = graph.where(F.col("color").isin(*colors))
    edges = next_kmers(own).select(F.xxhash64(canonical("km")).alias("u"), F.xxhash64(canonical("next")).alias("v")).distinct()
    found = components(edges)
    rows = own.select("ck").distinct().withColumn("node", F.xxhash64("ck"))
    return rows.join(found, "node", "left").select("ck", F.coalesce("component", "node").alias("component"))


def walk_truth(graph: DataFrame, kmers: DataFrame, colors: list[int]) -> DataFrame:
    """(seed, contig): walks from every k-mer of `kmers` that the graph covers, one component a task group."""
    at = cut(graph_components(graph, colors), "components")
    seeds = kmers.select(F.col("ck").alias("seed")).distinct().join(at.withColumnRenamed("ck", "seed"), "seed")
    used = seeds.select("component").distinct()
    rows = graph.where(F.col("color").isin(*colors)).join(at, "ck").join(used, "component", "left_semi")
    seeds = seeds.toDF(*seeds.columns)  # new column identities on either side
    return walk_seeds(rows.select("component", "ck", "color", "cov", "in_mask", "out_mask").toDF("component", "ck", "color", "cov", "in_mask", "out_mask"), seeds, colors)


def link_rows(graph: DataFrame, kmers: DataFrame, read: str) -> DataFrame:
    """build_links over whole tables: (ck, color, is_fw, choices, reads) from the k-mers (read, color, pos, km, ck, pb, nb) of
    graph.kmerize, threaded through the graph of their colour in both directions."""
    flip = F.col("ck") != F.col("km")
    degrees = graph.select("ck", "color", masks.degree(F.col("in_mask")).alias("_i"), masks.degree(F.col("out_mask")).alias("_o")).where("_i > 1 or _o > 1")
    at = kmers.join(degrees, ["ck", "color"])
    at = at.select(read, "color", "pos", "km", "pb", "nb", F.when(flip, F.col("_o")).otherwise(F.col("_i")).alias("ins"), F.when(flip, F.col("_i")).otherwise(F.col("_o")).alias("outs"))
    ahead = F.when((F.col("outs") > 1) & F.col("nb").isNotNull(), F.struct("pos", F.col("nb").alias("b")))
    behind = F.when((F.col("ins") > 1) & F.col("pb").isNotNull(), F.struct("pos", complement("pb").alias("b")))
    forks = at.groupBy(read, "color").agg(F.array_sort(F.collect_list(ahead)).alias("ahead"), F.reverse(F.array_sort(F.collect_list(behind))).alias("behind"))
    rows = at.join(forks, [read, "color"])
    text = lambda xs: F.array_join(F.transform(xs, lambda x: x["b"]), "")

    def made(key: Column, on: Column, xs: Column) -> DataFrame:
        return rows.where(on).select(read, "color", key.alias("key"), text(xs).alias("choices"))

    size = F.length("km") - 1
    fore = made(F.concat("pb", F.substr("km", F.lit(1), size)), (F.col("ins") > 1) & F.col("pb").isNotNull(), F.filter("ahead", lambda x: x["pos"] >= F.col("pos") - 1))
    turned = F.reverse(complement(F.concat(F.substr("km", F.lit(2), size), F.col("nb"))))
    back = made(turned, (F.col("outs") > 1) & F.col("nb").isNotNull(), F.filter("behind", lambda x: x["pos"] <= F.col("pos") + 1))
    links = fore.union(back).where("choices <> ''").select(read, "color", canonical("key").alias("ck"), (canonical("key") == F.col("key")).alias("is_fw"), "choices").distinct()
    return links.groupBy("ck", "color", "is_fw", "choices").agg(F.count("*").alias("reads"))


def color_components(graph: DataFrame) -> DataFrame:
    """(ck, color, component): connected k-mers of each colour by itself."""
    node = lambda x: F.xxhash64(x, "color")
    found = components(next_kmers(graph).select(node(canonical("km")).alias("u"), node(canonical("next")).alias("v")).distinct())
    return graph.select("ck", "color", node("ck").alias("node")).join(found, "node", "left").select("ck", "color", F.coalesce("component", "node").alias("component"))


def _of_component(left: pd.DataFrame) -> tuple[LocalGraph, dict, list[int]]:
    graph = LocalGraph(left[["ck", "color", "cov", "in_mask", "out_mask"]].itertuples(index=False, name=None))
    links = {ck: {(x[0] == "+", x[1:]) for x in xs} for ck, xs in zip(left["ck"], left["links"]) if xs is not None}
    return graph, links, sorted(set(left["color"]))


def _rows_at(graph: DataFrame, at: DataFrame, links: DataFrame, asked: DataFrame) -> DataFrame:
    """Graph rows and links of the components that are asked, a row a k-mer."""
    held = links.groupBy("ck", "color").agg(F.collect_set(F.concat(F.when(F.col("is_fw"), "+").otherwise("-"), "choices")).alias("links"))
    rows = graph.join(at, ["ck", "color"]).join(asked.select("component").distinct(), "component", "left_semi").join(held, ["ck", "color"], "left")
    return rows.select("component", "ck", "color", "cov", "in_mask", "out_mask", "links")


def walk_linked(graph: DataFrame, at: DataFrame, links: DataFrame, kmers: DataFrame) -> DataFrame:
    """(seed, color, contig): link-guided walks in each colour from all `kmers` that it covers; `at` is color_components.

    A colour's component meets in one task.
    """

    def kernel(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        graph, links, colors = _of_component(left)
        return pd.DataFrame({"seed": right["seed"], "color": right["color"], "contig": [contig(walk(graph, s, colors, links=links)) for s in right["seed"]]})

    seeds = kmers.select("ck").distinct().join(at, "ck").select(F.col("component").alias("_at"), F.col("ck").alias("seed"), "color")
    rows = _rows_at(graph, at, links, seeds.withColumnRenamed("_at", "component"))
    return rows.groupBy("component").cogroup(seeds.groupBy("_at")).applyInPandas(kernel, "seed string, color int, contig string")


def gaps_filled(graph: DataFrame, at: DataFrame, kmers: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """(key, color, start, stop, seq) of each gap of a colour in a sequence's k-mers (key, pos, km, ck): the shortest path from the
    last k-mer before to the first one after, of at most `most` steps; null where there is none."""

    def kernel(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        graph, _, colors = _of_component(left)
        return right[["_key", "color", "start", "stop"]].assign(seq=[fill_gap(graph, a, b, colors, most) for a, b in zip(right["a"], right["b"])])

    order = Window.partitionBy(key, "color").orderBy("pos")
    after = F.lead(F.struct("pos", "km", "component")).over(order)
    gaps = kmers.join(at, "ck").withColumn("z", after).where("z.pos > pos + 1")
    gaps = gaps.select(F.col(key).alias("_key"), "color", F.col("pos").alias("start"), F.col("z.pos").alias("stop"), F.col("km").alias("a"), F.col("z.km").alias("b"), "component", (F.col("z.component") == F.col("component")).alias("_same"))
    near = gaps.where("_same").withColumnRenamed("component", "_at")
    none = graph.select("ck", "color", F.lit(True).alias("is_fw"), F.lit("").alias("choices")).limit(0)
    kind = {f.name: f.dataType.simpleString() for f in gaps.schema}
    rows = _rows_at(graph, at, none, near.withColumnRenamed("_at", "component"))
    out = rows.groupBy("component").cogroup(near.groupBy("_at")).applyInPandas(kernel, f"_key {kind['_key']}, color int, start {kind['start']}, stop {kind['stop']}, seq string")
    far = gaps.where("not _same").select("_key", "color", "start", "stop", F.lit(None).cast("string").alias("seq"))
    return out.unionByName(far).withColumnRenamed("_key", key)


def partitions(graph: DataFrame, at: DataFrame, links: DataFrame, rois: DataFrame, color: int) -> DataFrame:
    """(contig, length, novels): the contigs that novel k-mers (ck) of a colour lie on, each once whatever its direction.

    In the order of k-mers, every novel k-mer that lies on no contig yet starts a link-guided walk; a k-mer on several contigs goes
    to the longest (the earliest in a tie), and contigs that keep no k-mer are left out. `at` is color_components; a colour's
    component with novel k-mers meets in one task.
    """

    def kernel(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        local, held, colors = _of_component(left)
        novel = set(right["seed"])
        best: dict[str, str] = {}
        for seed in sorted(novel):
            if seed in best:
                continue
            kmers = walk(local, seed, colors, links=held)
            text = contig(kmers)
            for x in {low(x) for x in kmers} & novel:
                if x not in best or len(text) > len(best[x]):
                    best[x] = text
        kept = sorted({low(x) for x in best.values()})
        k = len(next(iter(novel)))
        count = [len({low(x[i : i + k]) for i in range(len(x) - k + 1)} & novel) for x in kept]
        return pd.DataFrame({"contig": kept, "length": [len(x) for x in kept], "novels": count})

    seeds = rois.select("ck").join(at.where(F.col("color") == color), "ck").select(F.col("component").alias("_at"), F.col("ck").alias("seed"))
    rows = _rows_at(graph.where(F.col("color") == color), at, links, seeds.withColumnRenamed("_at", "component"))
    return rows.groupBy("component").cogroup(seeds.groupBy("_at")).applyInPandas(kernel, "contig string, length long, novels long")


def corrected(graph: DataFrame, filled: DataFrame, k: int) -> DataFrame:
    """The graph with the k-mers of filled gaps (color, seq; of gaps_filled) that it lacks: coverages add up, edges unite."""
    more = counted(filled.where("seq is not null"), k)
    both = graph.select("ck", "color", "cov", "in_mask", "out_mask").unionByName(more)
    return both.groupBy("ck", "color").agg(F.sum("cov").alias("cov"), F.bit_or("in_mask").alias("in_mask"), F.bit_or("out_mask").alias("out_mask"))


def dfs_all(graph: LocalGraph, seeds: Iterable[str], rule: str, colors: list[int], **options) -> set[tuple[str, str]] | None:
    """The union of the subgraphs around several seeds; None if no seed's is accepted."""
    found = [x for x in (dfs(graph, s, rule, colors, **options) for s in seeds) if x is not None]
    return set().union(*found) if found else None


def with_neighbours(graph: LocalGraph, edges: set[tuple[str, str]], colors: list[int]) -> set[tuple[str, str]]:
    """Edges of a subgraph and all edges of the colours that leave or enter its k-mers."""
    out = set(edges)
    for km in {x for e in edges for x in e}:
        out |= {(km, x) for x in graph.neighbours(km, True, colors)} | {(x, km) for x in graph.neighbours(km, False, colors)}
    return out

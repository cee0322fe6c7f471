"""The tables that the registered queries run on, derived from the driver's tables, and the same as DuckDB views.

documents are samples' sequences (colour: doc_id mod 3, as mother, father, child; letters a-z dealt to ACGT), benchmark
texts are truth sequences, lineitem rows are features, events are variants. Whole texts and whole tables are used.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import buckets, contigs, filters, graph, traverse
from kmerloom.plans.runtime import cut, spread

K = 21
#: What doc_id mod 3 may be, with ids below 0.
COLORS = [-2, -1, 0, 1, 2]
LETTERS, DEALT = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
_kept: dict[tuple, DataFrame] = {}


class Catalog:
    """Lazily derived tables of one folder; the graph and novel k-mers are written once for each session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _once(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _kept:
            _kept[key] = cut(make(), name)
        return _kept[key]

    @property
    def seqs(self) -> DataFrame:
        seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, DEALT)
        return spread(self.table("documents").select("doc_id", "text")).select("doc_id", (F.col("doc_id") % 3).cast("int").alias("color"), seq.alias("seq"))

    @property
    def truth(self) -> DataFrame:
        seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, DEALT)
        return self.table("benchmark").select("item_id", seq.alias("seq"))

    @property
    def kmers(self) -> DataFrame:
        """One row a letter: made anew by each query that asks, never written."""
        return graph.kmerize(self.seqs, K, "seq", ("doc_id", "color"))

    @property
    def marks(self) -> DataFrame:
        """kmers with places and canonical k-mers only."""
        return graph.kmerize(self.seqs, K, "seq", ("doc_id", "color"), ("pos", "ck"))

    @property
    def graph(self) -> DataFrame:
        return self._once("graph", lambda: graph.counted(self.seqs, K))

    @property
    def edges(self) -> DataFrame:
        """The graph, made anew by each query that asks and never written."""
        return buckets.graph(self.seqs, K, COLORS)

    def wide(self, columns: list[str], where=None) -> DataFrame:
        """One row a k-mer, never written: see buckets.wide."""
        return buckets.wide(self.seqs, K, COLORS, columns, where)

    @property
    def rois(self) -> DataFrame:
        return self._once("rois", lambda: filters.novel(self.graph, 2, [0, 1]))

    @property
    def contigs(self) -> DataFrame:
        return self.seqs.where((F.col("color") == 2) & (F.length("seq") >= K))

    @property
    def contig_kmers(self) -> DataFrame:
        return graph.kmerize(self.contigs, K, "seq", ("doc_id", "color"), ("pos", "km", "ck"))

    @property
    def truth_kmers(self) -> DataFrame:
        return self._once("truth_kmers", lambda: graph.kmerize(self.truth, K, "seq", ("item_id",)))

    @property
    def links(self) -> DataFrame:
        return self._once("links", lambda: traverse.link_rows(self.graph, self.kmers, "doc_id"))

    @property
    def color_components(self) -> DataFrame:
        return self._once("components", lambda: traverse.color_components(self.graph))

    @property
    def lengths(self) -> DataFrame:
        return self.contigs.select("doc_id", F.length("seq").alias("len"))

    @property
    def regions(self) -> DataFrame:
        return contigs.novelty_regions(self.contig_kmers, self.rois, "doc_id")

    @property
    def features(self) -> DataFrame:
        return self.table("lineitem").select((F.col("l_suppkey") % 5).alias("chr"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("stop"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))

    @property
    def variants(self) -> DataFrame:
        return self.table("events").select((F.col("user_id") % 5).alias("chr"), F.col("event_id").alias("pos"), "event_type", "user_id")


_SEQ = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{DEALT}')"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _kmers(name: str, keep: str) -> str:
    """K-mers of every place: texts go through in pieces of 256 places, with a blank at either end, so no place is searched from afar."""
    return f"""{name}_p AS (SELECT *, unnest(range(0, length(seq) - {K} + 1, 256)) AS low FROM {name} WHERE length(seq) >= {K}),
{name}_q AS (SELECT {keep}, low, length(seq) - {K} + 1 - low AS n, substr(' ' || seq || ' ', low + 1, {K + 257}) AS piece FROM {name}_p),
{name}_i AS (SELECT {keep}, low, piece, unnest(range(0, least(256, n))) AS j FROM {name}_q),
{name}_m AS (SELECT {keep}, low + j AS pos, substr(piece, j + 2, {K}) AS km, nullif(substr(piece, j + 1, 1), ' ') AS pb, nullif(substr(piece, j + {K + 2}, 1), ' ') AS nb FROM {name}_i),
{name}_k AS (SELECT {keep}, pos, km, least(km, reverse(translate(km, 'ACGT', 'TGCA'))) AS ck, pb, nb FROM {name}_m)"""


def _bit(x: str, letters: str = "ACGT") -> str:
    a, c, g, t = letters
    return f"CASE {x} WHEN '{a}' THEN 1 WHEN '{c}' THEN 2 WHEN '{g}' THEN 4 WHEN '{t}' THEN 8 ELSE 0 END"


_CTE = {
    "seqs": f"seqs AS (SELECT doc_id, CAST(doc_id % 3 AS INT) AS color, {_SEQ} AS seq FROM documents)",
    "truth": f"truth AS (SELECT item_id, {_SEQ} AS seq FROM benchmark)",
    "kmers": _kmers("seqs", "doc_id, color"),
    "truth_kmers": _kmers("truth", "item_id"),
    "graph": f"""graph AS MATERIALIZED (SELECT ck, color, count(*) AS cov,
  CAST(bit_or(CASE WHEN ck <> km THEN {_bit("nb", "TGCA")} ELSE {_bit("pb")} END) AS INT) AS in_mask,
  CAST(bit_or(CASE WHEN ck <> km THEN {_bit("pb", "TGCA")} ELSE {_bit("nb")} END) AS INT) AS out_mask
  FROM seqs_k GROUP BY ck, color)""",
    "rois": """rois AS MATERIALIZED (SELECT ck, 2 AS color, max(CASE WHEN color = 2 THEN cov END) AS cov, max(CASE WHEN color = 2 THEN in_mask END) AS in_mask, max(CASE WHEN color = 2 THEN out_mask END) AS out_mask
  FROM graph WHERE cov > 0 GROUP BY ck HAVING max(CASE WHEN color IN (0, 1) THEN 1 ELSE 0 END) = 0 AND max(CASE WHEN color = 2 THEN 1 ELSE 0 END) = 1)""",
    "oriented": """oriented AS (SELECT ck AS km, color, cov, in_mask, out_mask FROM graph UNION ALL SELECT reverse(translate(ck, 'ACGT', 'TGCA')), color, cov,
  ((out_mask & 1) << 3) | ((out_mask & 2) << 1) | ((out_mask & 4) >> 1) | ((out_mask & 8) >> 3), ((in_mask & 1) << 3) | ((in_mask & 2) << 1) | ((in_mask & 4) >> 1) | ((in_mask & 8) >> 3) FROM graph)""",
    "features": "features AS (SELECT l_suppkey % 5 AS chr, l_orderkey AS start, l_orderkey + CAST(l_quantity AS BIGINT) AS stop, l_orderkey * 10 + l_linenumber AS id FROM lineitem)",
    "variants": "variants AS (SELECT user_id % 5 AS chr, event_id AS pos, event_type, user_id FROM events)",
    "regions": """marks AS (SELECT DISTINCT doc_id, pos FROM seqs_k WHERE color = 2 AND ck IN (SELECT ck FROM rois)),
  runs AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM marks),
  regions AS (SELECT doc_id, min(pos) AS start, max(pos) AS stop, count(*) AS n FROM runs GROUP BY doc_id, g)""",
}
_NEEDS = {"kmers": ["seqs"], "graph": ["kmers"], "rois": ["graph"], "oriented": ["graph"], "regions": ["rois"], "truth_kmers": ["truth"]}


def sql(needs: str, body: str, more: str = "") -> str:
    """body after the definitions that it needs, and more of its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    parts = [_CTE[x] for x in order] + [more] * bool(more)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body

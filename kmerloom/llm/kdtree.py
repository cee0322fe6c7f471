"""K-d tree partitioning into shards of near equal bytes, with DataFrame operations only.

Equal texts are one group, pre-aggregated to a weight and a point of metadata. A node splits along its widest dimension
at the weighted median, found by refining histograms: each pass sums weights by digit of the key and keeps the digit
where half the weight is reached. Groups of over a hundredth of a shard are few by their definition; they go to the
lighter half and the median of the others makes up for them. Groups larger than a shard are cut into pieces by id.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.plans.runtime import cut

#: Bits of a coordinate, of a histogram's digit, and rows of a block of slots.
COORD, DIGIT, SLOTS = 31, 13, 1000
#: A group above target / BOULDER is placed as a whole before its node is split: at most shards * BOULDER groups.
BOULDER = 100


def _prefix(name: str) -> Column:
    """A string's first six bytes as a number, in code point order."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(name).cast("string"), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def _cuts(rows: DataFrame, wanted: dict[int, float]) -> dict[int, int]:
    """rows (node, key, weight) -> for each node the least key up to which the weights reach wanted[node]."""
    bits = 2 * COORD
    state = {n: (0, float(w)) for n, w in wanted.items()}
    while bits > 0:
        shift = max(0, bits - DIGIT)
        low = F.element_at(F.create_map(*[F.lit(x) for n, (lo, _) in state.items() for x in (n, lo)]), F.col("node")).cast("long")
        want = F.element_at(F.create_map(*[F.lit(x) for n, (_, w) in state.items() for x in (n, w)]), F.col("node"))
        inside = rows.where((F.col("key") >= low) & (F.col("key") < low + F.lit(1 << bits)))
        sums = inside.groupBy("node", F.shiftright(F.col("key") - low, shift).alias("digit")).agg(F.sum("weight").alias("w"))
        order = Window.partitionBy("node").orderBy("digit")
        sums = sums.withColumn("to", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        hit = sums.withColumn("_hit", F.col("to") >= want).groupBy("node").agg(
            F.min(F.when(F.col("_hit"), F.struct("digit", (F.col("to") - F.col("w")).alias("before")))).alias("first"), F.max(F.struct("digit", (F.col("to") - F.col("w")).alias("before"))).alias("end"),
        )
        for r in hit.collect():  # one row a node
            at = r["first"] or r["end"]
            lo, w = state[r["node"]]
            state[r["node"]] = lo + (at["digit"] << shift), w - at["before"]
        bits = shift
    return {n: lo for n, (lo, _) in state.items()}


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang"), depth: int = 4) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    2**depth shards of near equal bytes (law `bytes`); size is the text's UTF-8 bytes plus 1, a null text has none and counts
    as empty. Equal texts share a shard unless together they are larger than one: such a group is cut by id into pieces of
    a quarter shard. Dimensions are the size's logarithm, the columns `dims` (of a group: its least value; null lowest)
    and the id. slot numbers a shard's rows from 0 without gaps. Ties fall by a hash of the text. Repeated rows count each,
    null ids are rows as any other (spread by their place, as they are alike), an empty table gives no rows; ids are whole
    numbers, columns that are not named are not read. Histograms have at most 2**DIGIT digits a node, so a node's window
    sorts no more rows than that, whatever the input; groups on the driver are at most shards * BOULDER.
    """
    shards = 1 << depth
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.xxhash64(text).alias("hash"), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(id_col)).alias("spread"), *[_prefix(d).alias(f"d{i}") for i, d in enumerate(dims)],
    )
    rows = cut(rows, "rows")
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    target = (total or 0) / shards
    groups = rows.groupBy("hash", "crc", "size").agg(F.count("*").alias("n"), *[F.min(f"d{i}").alias(f"d{i}") for i in range(len(dims))], F.coalesce(F.min("id").cast("double"), F.lit(-1.0)).alias(f"d{len(dims)}"))
    groups = groups.withColumns({"weight": F.col("n") * F.col("size"), "dz": F.log2(F.col("size").cast("double"))})
    groups = cut(groups, "groups")
    names = ["dz", *[f"d{i}" for i in range(len(dims) + 1)]]
    spread = groups.agg(*[F.struct(F.min(d), F.max(d)) for d in names]).first()
    coords = []
    for d, (lo, hi) in zip(names, spread, strict=True):
        scale = (2**COORD - 1) / (hi - lo) if n and hi > lo else 0.0
        coords.append(F.floor((F.col(d) - F.lit(lo if n else 0.0)) * F.lit(scale)).cast("long"))
    small = groups.where(F.col("weight") <= F.lit(target / BOULDER)).select("hash", "crc", "size", "weight", *[c.alias(f"x{i}") for i, c in enumerate(coords)], F.lit(0).alias("node"))
    # at most shards * BOULDER groups are that large, and at most 5 * shards pieces come from those above a shard
    large = [(r["hash"], r["crc"], r["size"], max(1, -(-4 * r["weight"] // max(1, int(target))) if r["weight"] > target else 1)) for r in groups.where(F.col("weight") > F.lit(target / BOULDER)).collect()]
    spark = docs.sparkSession
    many = F.broadcast(spark.createDataFrame(large, "hash long, crc long, size long, many int"))
    rows = rows.join(many, ["hash", "crc", "size"], "left").withColumn("piece", F.pmod(F.xxhash64(F.lit(5), "spread"), F.col("many")).cast("int"))
    held = rows.where("many is not null").groupBy("hash", "crc", "size", "piece").agg(F.sum("size").alias("weight")).collect()  # one row a piece
    pieces = sorted(((r["hash"], r["crc"], r["size"], r["piece"], r["weight"]) for r in held), key=lambda x: (-x[4], x[0], x[3]))
    place = [0] * len(pieces)
    node = F.col("node")
    for level in range(depth):
        here = small
        facts = {r["node"]: r for r in here.groupBy("node").agg(F.sum("weight").alias("w"), *[(F.max(f"x{i}") - F.min(f"x{i}")).alias(f"r{i}") for i in range(len(coords))]).collect()}
        widest = {k: max(range(len(coords)), key=lambda i, r=r: (r[f"r{i}"], -i)) for k, r in facts.items()}
        sides: dict[int, list[float]] = {}
        for j, x in enumerate(pieces):
            halves = sides.setdefault(place[j], [0.0, 0.0])
            side = int(halves[1] < halves[0])
            halves[side] += x[4]
            place[j] = 2 * place[j] + side
        wanted = {}
        for k, r in facts.items():
            left, right = sides.get(k, [0.0, 0.0])
            wanted[k] = max(0.0, (left + right + r["w"]) / 2 - left)
        if not facts:
            continue
        key = F.coalesce(*[F.when(F.col("node") == k, F.shiftleft(F.col(f"x{i}"), COORD) + F.pmod(F.col("hash"), F.lit(1 << COORD))) for k, i in widest.items()])
        keyed = here.withColumn("key", key)
        at = _cuts(keyed, {k: max(w, 0.5) for k, w in wanted.items()})
        bound = F.coalesce(*[F.when(node == k, F.lit(v)) for k, v in at.items()])
        own = F.coalesce(*[F.when(node == k, F.shiftleft(F.col(f"x{i}"), COORD) + F.pmod(F.col("hash"), F.lit(1 << COORD))) for k, i in widest.items()])
        none = F.coalesce(*[F.when(node == k, F.lit(w <= 0)) for k, w in wanted.items()])
        small = cut(small.withColumn("_node", 2 * node + F.when(none | (own > bound), 1).otherwise(0)).drop("node").withColumnRenamed("_node", "node"), f"split{level}")
    leaf = small.select("hash", "crc", "size", F.col("node").cast("int").alias("shard"))
    hot = F.broadcast(spark.createDataFrame([(*x[:4], s) for x, s in zip(pieces, place, strict=True)], "hash long, crc long, size long, piece int, hot int"))
    placed = rows.where("many is not null").join(hot, ["hash", "crc", "size", "piece"]).select("id", "size", "crc", "hash", "spread", F.col("hot").alias("shard"))
    rest = rows.where("many is null").join(leaf, ["hash", "crc", "size"]).select("id", "size", "crc", "hash", "spread", "shard")
    every = cut(placed.union(rest).withColumn("block", F.pmod(F.xxhash64(F.lit(9), "spread", "hash"), F.lit(max(1, n // (shards * SLOTS))))), "shards")
    ends = every.groupBy("shard", "block").agg(F.count("*").alias("_n"))
    ends = ends.select("shard", "block", (F.sum("_n").over(Window.partitionBy("shard").orderBy("block")) - F.col("_n")).alias("_from"))
    nth = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "hash")) - 1
    out = every.withColumn("_nth", nth).join(ends, ["shard", "block"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("_from") + F.col("_nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

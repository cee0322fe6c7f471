"""Binary k-mer graphs (format version 6) and link tables as Spark data sources and as bytes.

A graph file is a header and records of fixed width, so a scan splits it by record ranges. k-mer words are big-endian,
coverages little-endian, one edge byte a colour.
"""

import gzip
import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format.
MAGIC, VERSION = b"CORTEX", 6
_MIRROR = [int(f"{i:04b}"[::-1], 2) for i in range(16)]


def read_header(data: bytes) -> dict:
    """k, words, colours, their facts, and where the records start. Raises ValueError on another format."""
    if data[:6] != MAGIC:
        raise ValueError("not a k-mer graph")
    version, k, words, colors = struct.unpack_from("<IIII", data, 6)
    if version != VERSION:
        raise ValueError(f"version {version} is not supported")
    at = 22
    facts = [{"color": c} for c in range(colors)]
    for f in facts:
        (f["mean_read_length"],) = struct.unpack_from("<I", data, at)
        at += 4
    for f in facts:
        (f["total_sequence"],) = struct.unpack_from("<Q", data, at)
        at += 8
    for f in facts:
        (n,) = struct.unpack_from("<I", data, at)
        f["sample_name"] = data[at + 4 : at + 4 + n].split(b"\0")[0].decode()
        at += 4 + n
    at += 16 * colors
    for f in facts:
        flags = data[at : at + 4]
        f["tip_clipping"], f["low_cov_unitigs_removed"], f["low_cov_kmers_removed"], f["cleaned_against"] = (bool(x) for x in flags)
        f["unitig_threshold"], f["kmer_threshold"], n = struct.unpack_from("<III", data, at + 4)
        f["cleaned_against_name"] = data[at + 16 : at + 16 + n].split(b"\0")[0].decode()
        at += 16 + n
    if data[at : at + 6] != MAGIC:
        raise ValueError("the header has no end mark")
    return {"k": k, "words": words, "colors": colors, "facts": facts, "start": at + 6, "width": 8 * words + 5 * colors}


def write_header(k: int, samples: list[str]) -> bytes:
    out = MAGIC + struct.pack("<IIII", VERSION, k, -(-k // 32), len(samples))
    out += struct.pack("<I", 0) * len(samples) + struct.pack("<Q", 0) * len(samples)
    for name in samples:
        out += struct.pack("<I", len(name.encode())) + name.encode()
    out += bytes(16) * len(samples)
    for _ in samples:
        out += bytes(4) + struct.pack("<III", 0, 0, 0)
    return out + MAGIC


def pack(ck: str, words: int) -> bytes:
    n = 0
    for c in ck:
        n = n << 2 | "ACGT".index(c)
    return n.to_bytes(8 * words, "big")


def unpack(raw: bytes, k: int) -> str:
    n = int.from_bytes(raw, "big")
    return "".join("ACGT"[n >> 2 * (k - 1 - i) & 3] for i in range(k))


def record(ck: str, rows: dict[int, tuple[int, int, int]], words: int, colors: int) -> bytes:
    own = [rows.get(c, (0, 0, 0)) for c in range(colors)]
    return pack(ck, words) + b"".join(struct.pack("<I", x[0]) for x in own) + bytes(_MIRROR[x[1]] << 4 | x[2] for x in own)


def records(data: bytes, h: dict) -> Iterator[tuple]:
    """(ck, color, cov, in_mask, out_mask) of whole records; colours without coverage and edges are left out."""
    for at in range(0, len(data) - h["width"] + 1, h["width"]):
        ck = unpack(data[at : at + 8 * h["words"]], h["k"])
        covs = struct.unpack_from(f"<{h['colors']}I", data, at + 8 * h["words"])
        edges = data[at + 8 * h["words"] + 4 * h["colors"] : at + h["width"]]
        for c in range(h["colors"]):
            if covs[c] or edges[c]:
                yield ck, c, covs[c], _MIRROR[edges[c] >> 4], edges[c] & 15


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, per: int):
        self.path, self.per = path, per
        with open(path, "rb") as f:
            self.header = read_header(f.read(1 << 20))
            f.seek(0, 2)
            self.count = (f.tell() - self.header["start"]) // self.header["width"]

    def partitions(self) -> list[_Range]:
        return [_Range(i, min(i + self.per, self.count)) for i in range(0, self.count, self.per)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        h, step = self.header, 65_536
        with open(self.path, "rb") as f:
            for at in range(part.start, part.stop, step):
                f.seek(h["start"] + at * h["width"])
                yield from records(f.read(min(step, part.stop - at) * h["width"]), h)


class GraphSource(DataSource):
    """spark.read.format("kmer_graph").load(path): long rows; the path is on a file system that executors mount."""

    @classmethod
    def name(cls) -> str:
        return "kmer_graph"

    def schema(self) -> str:
        return "ck string, color int, cov long, in_mask int, out_mask int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("records", "1000000")))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(GraphSource)
    return spark.read.format("kmer_graph").load(path)


def graph_records(graph: DataFrame, k: int, colors: int) -> DataFrame:
    """(ck, record): the binary records of a graph in sorted order; a file is a header and these, one after the other."""
    words = -(-k // 32)

    @F.udf("binary")
    def encode(ck: str, rows: list) -> bytes:
        return record(ck, {r["color"]: (r["cov"], r["in_mask"], r["out_mask"]) for r in rows}, words, colors)

    rows = graph.groupBy("ck").agg(F.collect_list(F.struct("color", "cov", "in_mask", "out_mask")).alias("rows"))
    return rows.select("ck", encode("ck", "rows").alias("record")).orderBy("ck")


def write_graph(graph: DataFrame, path: str, k: int, samples: list[str]) -> None:
    """One graph file, its records streamed to the driver partition by partition in sorted order."""
    with open(path, "wb") as f:
        f.write(write_header(k, samples))
        for r in graph_records(graph, k, len(samples)).toLocalIterator():
            f.write(bytes(r["record"]))


def parse_links(text: str) -> tuple[dict, list[tuple[str, list[tuple]]]]:
    """(header, [(k-mer, [(is_fw, num_kmers, num_junctions, coverages, bases)])]) of a link table, versions 2 to 4.

    The header is a JSON object, comment lines start with #; version 4 has no k-mer count in its junction lines (-1).
    """
    header, at = json.JSONDecoder().raw_decode(text.lstrip())
    version = header.get("format_version", header.get("formatVersion", 4))
    rows, out = [x for x in text.lstrip()[at:].split("\n") if x.strip() and not x.startswith("#")], []
    i = 0
    while i < len(rows):
        ck, n = rows[i].split()[:2]
        links = []
        for line in rows[i + 1 : i + 1 + int(n)]:
            p = line.split()
            if int(version) >= 4:
                links.append((p[0] == "F", -1, int(p[1]), [int(x) for x in p[2].split(",")], p[3]))
            else:
                links.append((p[0] == "F", int(p[1]), int(p[2]), [int(x) for x in p[3].split(",")], p[4]))
        out.append((ck, links))
        i += 1 + int(n)
    return header, out


def read_links(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """(ck, source, sample, junctions) of link files, one task a file (text or gzip)."""
    schema = "ck string, source string, sample string, junctions array<struct<is_fw:boolean,num_kmers:int,num_junctions:int,cov:array<int>,junctions:string>>"

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for source, content in zip(batch["path"], batch["content"]):
                raw = bytes(content)
                found = parse_links((gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode())[1]
                names = ("is_fw", "num_kmers", "num_junctions", "cov", "junctions")
                yield pd.DataFrame({"ck": [x[0] for x in found], "source": source, "sample": sample, "junctions": [[dict(zip(names, j)) for j in x[1]] for x in found]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)


def write_links(header: dict, links: list[tuple[str, list[tuple]]]) -> str:
    lines = [json.dumps(header), ""]
    for ck, own in sorted(links):
        lines.append(f"{ck} {len(own)}")
        for fw, kmers, n, cov, bases in own:
            lines.append(" ".join(["F" if fw else "R", *([str(kmers)] if kmers >= 0 else []), str(n), ",".join(map(str, cov)), bases]))
    return "\n".join(lines) + "\n"

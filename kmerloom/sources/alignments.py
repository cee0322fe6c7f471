"""Binary alignments (BAM) as a DataFrame: one task a file, blocks inflated and records read in order."""

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: letters of 4-bit bases, of CIGAR operations, and sizes of tag values.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
SCHEMA = "source string, name string, flag int, contig string, pos int, mq int, cigar string, mate_contig string, mate_pos int, length int, seq string, qual string, edits int"


def inflated(data: bytes) -> bytes:
    """The content of a file of gzip members, one after another."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def _edits(data: bytes, at: int, end: int) -> int | None:
    """The value of the NM tag."""
    while at + 3 <= end:
        name, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if name == b"NM" and kind in NUMBERS:
            return struct.unpack_from(NUMBERS[kind], data, at)[0]
        if kind in "ZH":
            at = data.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + SIZES[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            at += SIZES[kind]
    return None


def records(data: bytes) -> Iterator[tuple]:
    """(name, flag, contig, 1-based pos, mq, cigar, mate contig, mate pos, length, seq, qual, edits) of inflated BAM bytes; what has no
    place has a null contig and pos 0."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    count, names = struct.unpack_from("<i", data, at)[0], []
    at += 4
    for _ in range(count):
        n = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + n].decode())
        at += 8 + n
    while at + 4 <= len(data):
        end = at + 4 + struct.unpack_from("<i", data, at)[0]
        ref, pos, n_name, mq, _, n_ops, flag, n, mate, mate_pos, size = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
        at += 36
        name = data[at : at + n_name - 1].decode()
        at += n_name
        cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", data, at)) or "*"
        at += 4 * n_ops
        packed = data[at : at + (n + 1) // 2]
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n] or "*"
        at += (n + 1) // 2
        quality = data[at : at + n]
        qual = "*" if not n or quality[0] == 255 else "".join(chr(q + 33) for q in quality)
        yield name, flag, names[ref] if ref >= 0 else None, pos + 1, mq, cigar, names[mate] if mate >= 0 else None, mate_pos + 1, size, seq, qual, _edits(data, at + n, end)
        at = end


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of BAM files in the columns of SCHEMA. A file is one task's work, as its blocks do not tell where records begin."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"], strict=True):
                held = []
                for r in records(inflated(bytes(content))):
                    held.append((source, *r))
                    if len(held) == 50_000:
                        yield pd.DataFrame(held, columns=names).astype({"edits": "Int32"})
                        held = []
                yield pd.DataFrame(held, columns=names).astype({"edits": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, SCHEMA)

"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

A payload of bytes is stored in the ancillary part of silent MPEG-1 Layer III frames: 48 kHz mono at 224 kbit/s, 672 bytes
and 1152 samples a frame, a protected header, side information of an empty granule pair, and 576 payload bytes at its end.
An ID3v2.4 tag holds the payload's length, a first frame the Xing table. Any decoder plays the result as silence.
"""

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
#: Fixed values of the MPEG audio header: kbit/s by (MPEG-1 or not, layer) and index, and sample rates of MPEG-1.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)


@dataclass(frozen=True)
class Header:
    version: Fraction
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mode: int
    extension: int
    size: int
    samples: int

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.channels == 1 else 32) if self.version == 1 else (9 if self.channels == 1 else 17)


@functools.lru_cache(4096)
def header(word: bytes) -> Header | None:
    """The header in four bytes; None where it is not one (free-format streams included)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: Fraction(5, 2), 2: Fraction(2), 3: Fraction(1)}.get(word[1] >> 3 & 3)
    layer = {1: 3, 2: 2, 3: 1}.get(word[1] >> 1 & 3)
    at, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer is None or at in (0, 15) or rate == 3 or word[3] & 3 == 2:
        return None
    old = 1 if version == 1 else 2
    hertz = RATES[rate] // (1 if version == 1 else 2 if version == 2 else 4)
    kbit, padding = BITRATES[old, layer][at - 1], word[2] >> 1 & 1
    if layer == 1:
        size, samples = (12_000 * kbit // hertz + padding) * 4, 384
    else:
        samples = 576 if layer == 3 and old == 2 else 1152
        size = samples * kbit * 125 // hertz + padding
    return Header(version, layer, not word[1] & 1, kbit, hertz, padding, word[3] >> 6, word[3] >> 4 & 3, size, samples)


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        table.append(c)
    return table


_CRC = _crc_table()


@functools.lru_cache(4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ b]
    return c


#: Fixed values of Layer II: (subbands, bits of an allocation) of each stretch of subbands, by table.
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}


def allocation_bits(h: Header) -> list[int]:
    """The bits of each subband's allocation in a Layer II frame."""
    each = h.bitrate // h.channels
    if h.version != 1:
        name = "low"
    elif each < 56:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "b" if each >= 96 and h.rate != 48000 else "a"
    return [bits for count, bits in ALLOCATION[name] for _ in range(count)]


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        return self.value >> max(0, self.left) & ((1 << n) - 1) if self.left >= 0 else 0


def crc16_bits(value: int, n: int) -> int:
    """crc16 of the n low bits of a number, the high one first."""
    c = 0xFFFF
    for i in range(n - 1, -1, -1):
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15 ^ value >> i) & 1 else 0)
    return c


def _covered_by_layer2(data: bytes, at: int, h: Header) -> int:
    """Bits after the checksum that it covers: all allocations, and two bits of scale factor selection for each that is not 0."""
    bits = _Bits(bytes(data[at + 6 : at + min(h.size, 6 + 128)]))
    bound = 32 if h.mode != 1 else 4 * (h.extension + 1)
    total = 0
    for band, n in enumerate(allocation_bits(h)):
        for _ in range(h.channels if band < bound else 1):
            total += n + 2 * (h.channels if band >= bound else 1) * (bits.take(n) != 0)
    return total


def checksum_ok(data: bytes, at: int, h: Header) -> bool | None:
    """Whether a protected frame's checksum holds; None where it has none."""
    if not h.protected:
        return None
    stored = int.from_bytes(data[at + 4 : at + 6], "big")
    if h.layer == 3:
        return crc16(bytes(data[at + 2 : at + 4]) + bytes(data[at + 6 : at + 6 + h.side])) == stored
    if h.layer == 2:
        n = _covered_by_layer2(data, at, h)
        body = int.from_bytes(data[at + 6 : at + 6 + -(-n // 8)], "big") >> -n % 8
        return crc16_bits(int.from_bytes(data[at + 2 : at + 4], "big") << n | body, 16 + n) == stored
    bound = 32 if h.mode != 1 else 4 * (h.extension + 1)
    bits = 4 * (bound * h.channels + (32 - bound))
    return crc16(bytes(data[at + 2 : at + 4]) + bytes(data[at + 6 : at + 6 + bits // 8])) == stored


def _syncsafe(data: bytes) -> int:
    return functools.reduce(lambda n, b: n << 7 | b & 0x7F, data, 0)


def _text(data: bytes) -> str:
    kind, data = data[:1], data[1:]
    name = {b"\0": "latin-1", b"\1": "utf-16", b"\2": "utf-16-be", b"\3": "utf-8"}.get(kind, "latin-1")
    return data.decode(name, "replace").rstrip("\0")


def id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes of the tag at the start, its text frames); user frames are named TXXX:description."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    version, end = data[3], 10 + _syncsafe(data[6:10])
    at, tags, wide = 10, {}, 3 if version == 2 else 4
    if data[5] & 0x40 and version > 2:
        at += _syncsafe(data[10:14]) if version == 4 else 4 + int.from_bytes(data[10:14], "big")
    while at + 2 * wide <= min(end, len(data)) and data[at]:
        name = data[at : at + wide].decode("latin-1")
        raw = data[at + wide : at + 2 * wide]
        size = _syncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        at += 6 if version == 2 else 10
        body = bytes(data[at : at + size])
        at += size
        if name.startswith("T"):
            text = _text(body)
            if name in ("TXXX", "TXX"):
                what, _, text = text.partition("\0")
                name = f"TXXX:{what}"
            tags[name] = text
    return end + (10 if data[5] & 0x10 else 0), tags


def _id3v1(data: bytes, end: int) -> tuple[int, dict[str, str]] | None:
    """(begin, items) of an ID3v1 tag that ends at `end`."""
    if end < 128 or data[end - 128 : end - 125] != b"TAG":
        return None
    at = end - 128
    places = (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127))
    return at, {f"id3v1:{name}": data[at + a : at + b].split(b"\0")[0].decode("latin-1").strip() for name, a, b in places}


def _ape(data: bytes, end: int) -> tuple[int, dict[str, str]] | None:
    """(begin, items) of an APEv2 tag that ends at `end`; none if its size or the header that it names is not there."""
    if end < 32 or data[end - 32 : end - 24] != b"APETAGEX":
        return None
    size, count, flags = (int.from_bytes(data[end - 32 + i : end - 28 + i], "little") for i in (12, 16, 20))
    at = end - size
    begin = at - (32 if flags >> 31 else 0)
    if size < 32 or begin < 0 or flags >> 31 and data[begin : begin + 8] != b"APETAGEX":
        return None
    tags = {}
    for _ in range(count):
        if at + 8 >= end - 32:
            break
        n = int.from_bytes(data[at : at + 4], "little")
        stop = data.find(b"\0", at + 8, end)
        if stop < 0:
            break
        tags[f"ape:{data[at + 8 : stop].decode('latin-1')}"] = data[stop + 1 : stop + 1 + n].decode("utf-8", "replace")
        at = stop + 1 + n
    return begin, tags


def trailing_tags(data: bytes) -> list[tuple[int, dict[str, str]]]:
    """Where audio may end, from the first place on, and the items of the ID3v1 and APEv2 tags after it. The last bytes of a
    frame can look like a tag, so these are candidates only; the last one is the end of the data, without tags."""
    found = {len(data): {}}
    for end, tags in ((len(data), {}), _id3v1(data, len(data)) or (None, None)):
        if end is not None:
            found[end] = tags
            if ape := _ape(data, end):
                found[ape[0]] = tags | ape[1]
    return sorted(found.items())


def vbr_table(data: bytes, at: int, h: Header) -> dict | None:
    """The Xing, Info or VBRI table of the frame at `at`."""
    mark = at + 4 + (2 if h.protected else 0) + h.side
    kind = bytes(data[mark : mark + 4])
    if h.layer == 3 and kind in (b"Xing", b"Info"):
        flags, spot, out = int.from_bytes(data[mark + 4 : mark + 8], "big"), mark + 8, {"kind": kind.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[spot : spot + 4], "big")
                spot += 4
        if flags & 4:
            out["toc"] = list(data[spot : spot + 100])
            spot += 100
        if flags & 8:
            out["quality"] = int.from_bytes(data[spot : spot + 4], "big")
        return out
    mark = at + 36
    if h.layer == 3 and bytes(data[mark : mark + 4]) == b"VBRI":
        size, frames = (int.from_bytes(data[mark + a : mark + a + 4], "big") for a in (10, 14))
        entries, scale, wide = (int.from_bytes(data[mark + a : mark + a + 2], "big") for a in (18, 20, 22))
        toc = [scale * int.from_bytes(data[mark + 26 + i * wide : mark + 26 + (i + 1) * wide], "big") for i in range(entries)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": toc}
    return None


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    first: Header | None = None
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    duration: Fraction = Fraction(0)
    skipped: int = 0
    checked: int = 0
    broken: int = 0

    @property
    def seconds(self) -> list[int]:
        """The offset of the first frame that starts at or after each whole second."""
        if not self.offsets:
            return []
        each = Fraction(self.first.samples, self.first.rate)
        return [self.offsets[-(-s * each.denominator // each.numerator)] for s in range(int((len(self.offsets) - 1) * each) + 1)]


def parse(data: bytes) -> Stream:
    """All frames of a stream. A header counts if the next one follows where its size says, or the data end there;
    otherwise the search goes on at the next byte, so damage costs the damaged frames only. Tables are not audio. Trailing
    tags count only after the last whole frame: a frame that reaches past their place to another frame or end is a frame."""
    out = Stream()
    at, out.tags = id3v2(data)
    ends = trailing_tags(data)
    locked = False
    while True:
        end = ends[0][0]
        h = header(bytes(data[at : at + 4]))
        same = h and (out.first is None or (h.version, h.layer, h.rate) == (out.first.version, out.first.layer, out.first.rate))
        if same and len(ends) > 1 and at + h.size > end:
            after = header(bytes(data[at + h.size : at + h.size + 4]))
            if at + h.size in (x for x, _ in ends[1:]) or after and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate):
                ends.pop(0)
                continue
        if at + 4 > end:
            break
        if not same or at + h.size > end:
            found, locked = data.find(b"\xff", at + 1, end), False
            out.skipped += (found if found > 0 else end) - at
            at = found if found > 0 else end
            continue
        if not locked and at + h.size < end:
            after = header(bytes(data[at + h.size : at + h.size + 4]))
            if after is None or (after.version, after.layer, after.rate) != (h.version, h.layer, h.rate):
                out.skipped += 1
                at += 1
                continue
        locked = True
        if out.first is None:
            out.first, out.table = h, vbr_table(data, at, h)
            if out.table:
                at += h.size
                continue
        ok = checksum_ok(data, at, h)
        out.checked += ok is not None
        out.broken += ok is False
        out.offsets.append(at)
        out.sizes.append(h.size)
        out.samples += h.samples
        at += h.size
    if at < end:
        out.skipped += end - at
    out.tags |= ends[0][1]
    if out.first:
        out.duration = Fraction(out.samples, out.first.rate)
    return out


def padded(text: bytes) -> bytes:
    """text and bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


_HEAD = bytes((0xFF, 0xFA, 0xC4, 0xC0))
_SIZE = header(_HEAD).size
_FILL = _HEAD + crc16(_HEAD[2:] + bytes(17)).to_bytes(2, "big") + bytes(_SIZE - 6 - UNIT)


def _sync(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes, length: int) -> bytes:
    """The stored form of a padded payload, `length` of whose bytes are its content."""
    count = len(payload) // UNIT
    body = b"\3length\0%d" % length
    frame = b"TXXX" + _sync(len(body)) + b"\0\0" + body
    total = (count + 1) * _SIZE
    toc = bytes(min(255, 256 * ((count * i // 100 + 1) * _SIZE) // total) for i in range(100))
    xing = bytes((0xFF, 0xFB, 0xC4, 0xC0)) + bytes(17) + b"Info" + (7).to_bytes(4, "big") + count.to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    frames = b"".join(_FILL + payload[i * UNIT : (i + 1) * UNIT] for i in range(count))
    return b"ID3\4\0\0" + _sync(len(frame)) + frame + xing.ljust(_SIZE, b"\0") + frames


def read_payload(data: bytes, stream: Stream) -> bytes:
    return b"".join(data[a + max(0, n - UNIT) : a + n] for a, n in zip(stream.offsets, stream.sizes, strict=True))


def feature(s: Stream) -> str:
    seek = hashlib.sha256(",".join(map(str, s.seconds)).encode()).hexdigest()[:16]
    h, d = s.first, s.duration
    about = f"mpeg{h.version} layer{h.layer} {h.rate}Hz {h.channels}ch {h.bitrate}k" if h else "none"
    return f"{about} frames={len(s.offsets)} samples={s.samples} seconds={d.numerator}/{d.denominator} crc={s.checked - s.broken}/{s.checked} table={(s.table or {}).get('kind')}:{(s.table or {}).get('frames')} skipped={s.skipped} tags={len(s.tags)} seek={seek}"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column("media"):
            s = parse(x.as_py() or b"")
            out.append((s.duration.numerator, s.duration.denominator, len(s.offsets), s.samples, s.checked, s.broken, s.skipped, list(s.tags.items()), (s.table or {}).get("kind"), (s.table or {}).get("frames"), s.seconds, feature(s)))
        types = [pa.int64()] * 7 + [pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        names = ["duration_num", "duration_den", "frames", "samples", "checked", "broken", "skipped", "tags", "table_kind", "table_frames", "seek", "feature"]
        cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], names=["id", *names])


def describe(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per row of MPEG audio bytes: exact duration as a fraction of a second, counts of frames, samples, checked and
    broken checksums and skipped bytes, tags, the variable-bitrate table, seek offsets (of each second's first frame), feature.

    Null and empty bytes, and bytes without a frame, have no frames, duration 0 and no offsets. Ids pass through as longs,
    repeated rows repeat, an empty table gives no rows, other columns are not read.
    """
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    schema = "id long, duration_num long, duration_den long, frames long, samples long, checked long, broken long, skipped long, tags map<string,string>, table_kind string, table_frames long, seek array<long>, feature string"
    return rows.mapInArrow(_described, schema).withColumnRenamed("id", id_col)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            data = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([encode(padded(x), len(x)) for x in data], pa.binary())], names=["id", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each whole text as MPEG audio bytes; a null text is empty. Ids are whole numbers; null ones and repeated rows
    pass through, an empty table gives no rows, other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoded, "id long, media binary").withColumnRenamed("id", id_col)


_DIGESTS = {
    "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(),
    "feature": pa.string(), "duration_num": pa.int64(), "duration_den": pa.int64(), "frames": pa.int64(), "checked": pa.int64(), "broken": pa.int64(), "seek": pa.list_(pa.int64()),
}


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column("media"):
            media = x.as_py()
            if media is None:
                out.append((None,) * len(_DIGESTS))
                continue
            s = parse(media)
            back = read_payload(media, s)
            length = s.tags.get("TXXX:length", "")
            n = int(length) if length.isascii() and length.isdigit() and int(length) <= len(back) else None
            out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), s.duration.numerator, s.duration.denominator, len(s.offsets), s.checked, s.broken, s.seconds))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(_DIGESTS.values()))], names=["id", *_DIGESTS])


def payload_digests(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Digests of what store_texts stored, read back from its bytes, with the exact duration (a fraction of a second), counts of
    frames and of checked and broken checksums, and the offset of each second's first frame.

    Null media give nulls; bytes that store_texts did not make have a null n_bytes, and as payload the ends of their frames.
    Ids are whole numbers, null ones and repeated rows pass through, an empty table gives no rows, other columns are not read.
    """
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    kinds = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return rows.mapInArrow(_digested, "id long, " + ", ".join(f"{c} {kinds[t]}" for c, t in _DIGESTS.items())).withColumnRenamed("id", id_col)

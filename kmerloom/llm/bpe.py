"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over bytes cuts texts where their content says, so passages that documents share give equal chunks. A
chunk is encoded once for each Python worker and its ids are kept in a store of bounded bytes. Chunks may cut words, so
every join is repaired: the last whole word before it, what lies between and the first whole word after it are encoded again,
and the ids of both words must come out as their chunks have them. Then each two neighbouring tokens of the spliced ids come from one
encoding, which makes them the encoding of the whole. Where the ids disagree, the two chunks are encoded as one, and so on
until the joins agree or the whole text is one chunk. (Encoding each chunk once for the whole cluster would need an exchange of
all texts; reuse within a worker needs none.)
"""

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import _BYTE, _INVERSE, _POWER, U, mix

#: Bytes of the rolling window, of a chunk on average, of text in work at a time, and of the store of chunks; units held.
WINDOW, CHUNK, SLICE, STORE, UNITS = 16, 1024, 1 << 20, 24 << 20, 400_000
#: Ids decoded at a time.
IDS = 1 << 16
_WHITE = (" ", "\n", "\t", "\r")
#: Plain text is Latin letters, digits, ASCII signs but the apostrophe, and white space, without control strings: the pattern
#: of this kind of tokenizer splits it into runs of letters, single digits and runs of signs, whatever stands around them.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SIGNS = "!-&(-/:-@\\[-`{-~"
_NOT_PLAIN = re.compile(f"[^ \\n\\t\\r0-9{_LATIN}{_SIGNS}]|<\\|")
_UNIT = re.compile(f"[{_LATIN}]+|[0-9]|[{_SIGNS}]+")


def _cuts(data: bytes) -> list[int]:
    """Where chunks end: positions whose last WINDOW bytes hash to 0 in ten bits, moved to the start of a character."""
    out, n = [], len(data)
    raw = np.frombuffer(data, np.uint8)
    piece = len(_POWER) - 1
    for at in range(0, n, piece - WINDOW):
        part = raw[at : at + piece]
        if len(part) <= WINDOW:
            break
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(_BYTE[part] * _POWER[: len(part)], out=sums[1:])
        rolled = mix((sums[WINDOW:] - sums[:-WINDOW]) * _INVERSE[: len(part) - WINDOW + 1])
        out += (np.flatnonzero(rolled % U(CHUNK) == 0) + (at + WINDOW)).tolist()
    cuts = []
    for x in out:
        while x < n and data[x] & 0xC0 == 0x80:
            x += 1
        if 0 < x < n and (not cuts or x > cuts[-1]):
            cuts.append(x)
    return cuts


_HEAD = re.compile("[^ \\n\\t\\r]*[ \\n\\t\\r]+[^ \\n\\t\\r]+(?=[ \\n\\t\\r])")


def _white_before(text: str, end: int) -> int:
    return max(text.rfind(w, 0, end) for w in _WHITE)


def _edges(text: str) -> tuple[int, int, int, int] | None:
    """Places in a chunk: where its first, perhaps partial word ends, where the whole word after it ends, where the white space
    before the last whole word begins, and where that word ends. None if there are no two such words."""
    found = _HEAD.match(text)
    if not found:
        return None
    first = min(i for i in (text.find(w) for w in _WHITE) if i >= 0)
    end = _white_before(text, len(text))
    while text[end - 1] in _WHITE:
        end -= 1
    begin = _white_before(text, end)
    while begin > 0 and text[begin - 1] in _WHITE:
        begin -= 1
    return (first, found.end(), begin, end) if begin >= found.end() else None


def chunks(text: str, held: dict | None = None) -> list[str]:
    """The content-defined chunks of a text; one without two whole words is one with its neighbour."""
    data = text.encode("utf-8", "surrogatepass")
    out: list[str] = []
    open_: list[str] = []
    at = 0
    for end in [*_cuts(data), len(data)]:
        piece = data[at:end].decode("utf-8", "surrogatepass")
        at = end
        open_.append(piece)
        if any(w in piece for w in _WHITE):
            whole = piece if len(open_) == 1 else "".join(open_)
            open_ = [whole]
            if (held is not None and whole in held) or _edges(whole):
                out.append(whole)
                open_ = []
    if any(open_):
        if out:
            open_.insert(0, out.pop())
        out.append("".join(open_))
    return out


@dataclass(frozen=True)
class Tok:
    """A tokenizer and what was found of it at load: whether chunks may be joined (pure BPE without dropout), whether plain text
    may go by units, the suffix of tokens that end words, and whether decoding has no decoder of its own."""

    lib: object
    joins: bool
    plain: bool
    suffix: str | None
    bare: bool


@functools.lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.lru_cache(4)
def checked(path: str) -> Tok:
    """The tokenizer, with what its file and a probe of it allow."""
    lib = tokenizer(path)
    about = json.loads(lib.to_str())
    model = about["model"]
    joins = model.get("type") == "BPE" and not model.get("dropout")
    found = Tok(lib, joins, False, model.get("end_of_word_suffix") or None, about.get("decoder") is None)
    if not joins:
        return found
    # every two plain characters beside each other, in and between words, must come out as their units do
    letters = [chr(i) for i in (*range(32, 127), *range(0xC0, 0x100), 9, 10, 13)]
    letters = [x for x in letters if not _NOT_PLAIN.search(x)]
    probe = "".join(f"{x}{y} {y}z{x}{y}" for x in letters for y in letters).replace("<|", "< |")
    units = _UNIT.findall(probe.lower())
    ids: dict[str, list[int]] = {x: e.ids for x, e in zip(set(units), lib.encode_batch_fast(list(set(units)), add_special_tokens=False), strict=True)}
    whole = lib.encode(probe, add_special_tokens=False).ids
    return Tok(lib, joins, [i for x in units for i in ids[x]] == whole, found.suffix, found.bare)


@dataclass(frozen=True)
class Chunk:
    """A chunk's text and ids (little-endian bytes). `head` and `tail` are its texts up to the end of the first whole word and from
    the white space before the last one; of these, the bytes of ids of both, and the ids of the whole words."""

    text: str
    ids: bytes
    head: str = ""
    tail: str = ""
    head_size: int = 0
    tail_size: int = 0
    after: bytes = b""
    before: bytes = b""

    @property
    def size(self) -> int:
        return 2 * len(self.text) + len(self.ids) + 500


class Store:
    """Encoded chunks by their text, the oldest going when the bytes are used up.

    Plain text is encoded by its units (letters, a digit, signs), of which at most UNITS are held; units that are not held
    are encoded together. Any other text is encoded by the library as it is.
    """

    def __init__(self, limit: int = STORE):
        self.held: dict[str, Chunk] = {}
        self.used, self.limit = 0, limit
        self.units: dict[str, bytes] = {}
        #: Joins whose ids agreed, and chunks that were encoded as one because they did not.
        self.agreed, self.widened = 0, 0

    def learn(self, tok: Tok, wanted: set[str]) -> None:
        letters = [x for x in wanted if x.isalpha()] if tok.suffix else []
        for at in range(0, len(letters), 8192):
            some = letters[at : at + 8192]
            ids = np.array(tok.lib.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(_last(tok)[ids]) + 1
            if len(ends) == len(some):  # each word ends in the one token that a word can end in
                raw, low = ids.tobytes(), 0
                for x, high in zip(some, (ends * 4).tolist(), strict=True):
                    self.units[x] = raw[low:high]
                    low = high
        left = [x for x in wanted if x not in self.units]
        for x, e in zip(left, tok.lib.encode_batch_fast(left, add_special_tokens=False), strict=True):
            self.units[x] = np.array(e.ids, "<u4").tobytes()

    def by_units(self, tok: Tok, texts: list[str]) -> dict[str, bytes]:
        """The ids of plain texts."""
        split = [_UNIT.findall(x.lower()) for x in texts]
        if len(self.units) > UNITS:
            self.units = {}
        self.learn(tok, set().union(*split) - self.units.keys())
        find = self.units.__getitem__
        return {x: b"".join(map(find, units)) for x, units in zip(texts, split, strict=True)}

    def _of(self, text: str) -> bytes:
        return b"".join(self.units[x] for x in _UNIT.findall(text.lower()))

    def get(self, tok: Tok, texts: list[str]) -> list[Chunk]:
        new = [x for x in dict.fromkeys(texts) if x not in self.held]
        plain = [x for x in new if tok.plain and not _NOT_PLAIN.search(x)]
        got: dict[str, Chunk] = {}
        for x, ids in self.by_units(tok, plain).items():
            if edges := _edges(x):
                a, b, c, d = edges
                after, before = self._of(x[a:b]), self._of(x[c:d])
                got[x] = Chunk(x, ids, x[:b], x[c:], len(self._of(x[:a])) + len(after), len(before) + len(self._of(x[d:])), after, before)
            else:
                got[x] = Chunk(x, ids)
        other = [x for x in new if x not in got]
        for x, e in zip(other, tok.lib.encode_batch(other, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            if edges := _edges(x):
                at = np.array([o[0] for o in e.offsets], np.int64)
                a, b, c, d = (4 * int(np.searchsorted(at, i)) for i in edges)
                raw = ids.tobytes()
                got[x] = Chunk(x, raw, x[: edges[1]], x[edges[2] :], b, len(raw) - c, raw[a:b], raw[c:d])
            else:
                got[x] = Chunk(x, ids.tobytes())
        out = [self.held[x] if x in self.held else got[x] for x in texts]
        for x, chunk in got.items():
            self.held[x] = chunk
            self.used += chunk.size
        while self.used > self.limit:
            self.used -= self.held.pop(next(iter(self.held))).size
        return out

    def windows(self, tok: Tok, texts: list[str]) -> list[bytes]:
        """The ids of the texts around joins."""
        some = list(dict.fromkeys(texts))
        plain = [x for x in some if tok.plain and not _NOT_PLAIN.search(x)]
        got = self.by_units(tok, plain)
        other = [x for x in some if x not in got]
        for x, e in zip(other, tok.lib.encode_batch_fast(other, add_special_tokens=False), strict=True):
            got[x] = np.array(e.ids, "<u4").tobytes()
        return [got[x] for x in texts]

    def agree(self, left: Chunk, ids: bytes, right: Chunk) -> bool:
        """Whether both whole words of a join have the ids of their chunks, with none of them shared."""
        return bool(left.before and right.after) and len(ids) >= len(left.before) + len(right.after) and ids.startswith(left.before) and ids.endswith(right.after)

    def joined(self, tok: Tok, parts: list[Chunk], found: list[bytes]) -> bytes:
        """The ids of a text from its chunks and the ids around their joins."""
        parts, found = list(parts), list(found)
        at = 0
        while at < len(parts) - 1:
            if self.agree(parts[at], found[at], parts[at + 1]):
                self.agreed += 1
                at += 1
                continue
            self.widened += 1
            parts[at : at + 2] = self.get(tok, [parts[at].text + parts[at + 1].text])
            del found[at]
            if at + 1 < len(parts):
                found[at] = self.windows(tok, [parts[at].tail + parts[at + 1].head])[0]
            if at:
                at -= 1
                found[at] = self.windows(tok, [parts[at].tail + parts[at + 1].head])[0]
        out = []
        for i, x in enumerate(parts):
            out.append(x.ids[x.head_size if i else 0 : len(x.ids) - (x.tail_size if i < len(parts) - 1 else 0)])
            if i < len(parts) - 1:
                out.append(found[i])
        return b"".join(out)


_ENDS: dict[int, np.ndarray] = {}


def _last(tok: Tok) -> np.ndarray:
    """Which ids are tokens that end a word."""
    if id(tok.lib) not in _ENDS:
        found = np.zeros(tok.lib.get_vocab_size(with_added_tokens=True) + 1, bool)
        found[[i for x, i in tok.lib.get_vocab().items() if x.endswith(tok.suffix)]] = True
        _ENDS[id(tok.lib)] = found
    return _ENDS[id(tok.lib)]


@functools.lru_cache(4)
def _store(path: str) -> Store:
    return Store()


def encode(path: str, texts: list[str], store: Store | None = None) -> list[np.ndarray]:
    """The ids of each text, by chunk reuse; by the library, text for text, if the tokenizer does not allow joins."""
    tok, store = checked(path), store or _store(path)
    if not tok.joins:
        return [np.array(tok.lib.encode(x, add_special_tokens=False).ids, "<u4") for x in texts]
    cut = [chunks(x, store.held) for x in texts]
    flat = iter(store.get(tok, [x for own in cut for x in own]))
    parts = [[next(flat) for _ in own] for own in cut]
    around = iter(store.windows(tok, [a.tail + b.head for own in parts for a, b in zip(own, own[1:])]))
    return [np.frombuffer(store.joined(tok, own, [next(around) for _ in own[1:]]), "<u4") for own in parts]


def decode(path: str, ids: np.ndarray) -> Iterator[str]:
    """The decoded text in parts: without a decoder in the file, tokens join with a space; with one, all ids go through it at once."""
    tok = checked(path)
    step = IDS if tok.bare else max(1, len(ids))
    for at in range(0, len(ids), step):
        part = tok.lib.decode(ids[at : at + step].tolist(), skip_special_tokens=False)
        yield part if at == 0 else " " + part


def _encoded(path: str, keep: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("text")]
            cols: list[list] = [[], [], [], [], []]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                    size += len(texts[end])
                    end += 1
                for ids in encode(path, texts[at:end]):
                    whole, back = hashlib.sha256(), []
                    for part in decode(path, ids):
                        whole.update(part.encode("utf-8", "surrogatepass"))
                        if keep:
                            back.append(part)
                    for c, x in zip(cols, (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), whole.hexdigest(), ids.astype(np.int32) if keep else None, "".join(back) if keep else None), strict=True):
                        c.append(x)
                at = end
            types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())
            arrays = [pa.array(x, t) for x, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays[: 5 if keep else 3]], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if keep else 4])

    return kernel


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256; with keep also ids, decoded.

    A null text is empty and has no ids. Control strings of the tokenizer inside a text are found as the library finds them.
    Texts are whole, whatever their length; null ids and repeated rows pass through, ids are whole numbers, an empty table gives
    no rows, other columns are not read. path is the tokenizer file, on every executor; one that is not plain BPE is used text
    by text, without chunks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return rows.mapInArrow(_encoded(path, keep), schema).withColumnRenamed("id", id_col)



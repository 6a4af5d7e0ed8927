"""Byte-level BPE by a sentencepiece model written directly from the rank file.

The rank file is the whole vocabulary; nothing is trained. Every byte is given a printable character of its own, a token
becomes the piece of its bytes' characters with minus its rank as the score, and normalisation is switched off. The
library's BPE then merges the best-scored neighbours first, which is the rank file's order. A pre-token that is itself a
token is taken whole, as the rank file's own library does.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts

#: Entries of a worker's cache of encoded pre-tokens; it starts anew when full. Longer pre-tokens aren't kept.
CACHE_ENTRIES, CACHE_CHARS = 150_000, 48
#: What this worker process keeps from task to task: a Coder for each vocabulary.
WORKER: dict[str, Coder] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """A printable character for each byte: U+0100 onwards, away from spaces and from the library's own mark."""
    return [chr(0x100 + b) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protocol buffer field: a varint or a length-delimited value."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; one more piece, at the end, stands for the unknown."""
    chars = byte_characters()
    order = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in order] != list(range(len(order))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must count from 0 without a gap and hold every single byte")
    score = lambda x: _varint(2 << 3 | 5) + struct.pack("<f", x)
    pieces = [_field(1, "".join(chars[b] for b in token).encode()) + score(-float(rank)) for token, rank in order]
    pieces.append(_field(1, b"<unk>") + score(0.0) + _field(3, 2))
    # trainer: BPE (2) without byte fallback; ids of unknown, begin, end, padding. normaliser: identity, no prefix, spaces as they are
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(order)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


def pattern_of(source: str) -> regex.Pattern:
    r"""The splitting pattern; its \s and \S as Unicode's White_Space, which leaves out U+001C to U+001F."""
    inside = {r"[^\s": r"[^\p{White_Space}", r"\S": r"\P{White_Space}", r"\s": r"\p{White_Space}"}
    for a, b in inside.items():
        source = source.replace(a, b)
    return regex.compile(source)


class Coder:
    """Encodes and decodes in one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.ranks, self.find = ranks, pattern_of(pattern).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        chars = byte_characters()
        # latin-1 makes a character of each byte, this moves it to the byte's own
        self.shift = {b: c for b, c in enumerate(chars)}
        self.cache: dict[str, tuple[int, ...]] = {}
        # one object for each id, which all of the cache shares
        self.numbers = list(range(len(self.tokens)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.find(t) for t in texts]
        cache, whole, numbers = self.cache, self.ranks, self.numbers
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        new = list(set().union(*cut) - cache.keys())
        for at in range(0, len(new), 4096):
            some = [(p, p.encode()) for p in new[at : at + 4096]]
            cache.update((p, (numbers[whole[b]],)) for p, b in some if b in whole)
            rest = [(p, b) for p, b in some if b not in whole]
            ids = self.sp.encode([b.decode("latin-1").translate(self.shift) for _, b in rest], num_threads=1)
            cache.update((p, tuple(map(numbers.__getitem__, i))) for (p, _), i in zip(rest, ids, strict=True))
        get = cache.__getitem__
        out = [list(chain.from_iterable(map(get, x))) for x in cut]
        for p in new:
            if len(p) > CACHE_CHARS:
                del cache[p]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _coder(spark: SparkSession, ranks_path: str, pattern: str):
    ranks = read_ranks(ranks_path)
    shared, key = spark.sparkContext.broadcast((ranks, pattern)), hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    def get() -> Coder:
        if key not in WORKER:
            WORKER[key] = Coder(*shared.value)
        return WORKER[key]

    return get


def encode(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """keep and ids (array of int) of every row's whole text; null counts as empty and has no ids.

    With decoded also the bytes that the ids decode to, in the same pass, as decode() gives them in one of its own.

    No shuffle. Repeated rows are encoded each; extra columns are ignored unless kept, and kept ones named ids or decoded
    give way to the results; an empty table gives an empty result. A text of any length is one row of ids. Special strings inside texts are ordinary text.
    """
    get = _coder(spark, ranks_path, pattern)
    fields = [("ids", pa.list_(pa.int32()), "array<int>")] + [("decoded", pa.binary(), "binary")] * decoded

    def work(texts: list[str]) -> list[list]:
        ids = get().encode(texts)
        return [ids, list(map(get().decode, ids))] if decoded else [ids]

    return map_texts(docs, list(keep), text, fields, work, get, 2 << 20)


def decode(spark: SparkSession, encoded: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids in column into; null ids give no bytes, an id out of range is an error."""
    tokens = spark.sparkContext.broadcast([t for t, _ in sorted(read_ranks(ranks_path).items(), key=lambda x: x[1])])
    schema = encoded.drop(into).schema.add(into, "binary")

    def run(batches):
        get = tokens.value.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(part.schema.get_field_index(ids)).to_pylist()
                columns = [c for c in part.schema.names if c != into]
                arrays = [part.column(part.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([b"".join(map(get, x or ())) for x in lists], type=pa.binary())], names=[*columns, into])

    return encoded.mapInArrow(run, schema)


def digests(coded: DataFrame) -> DataFrame:
    """n_tokens, and SHA-256 of the decimal ids joined by commas and of the decoded bytes, in place of ids and decoded."""
    return coded.select(
        *[c for c in coded.columns if c not in ("ids", "decoded")],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

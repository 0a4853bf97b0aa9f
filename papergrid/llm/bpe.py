"""Byte-level BPE encoding and decoding through a sentencepiece model that is serialised straight from a rank vocabulary.

Each rank's bytes become a piece of printable characters, one per byte, scored by
its negative rank, so that sentencepiece joins the pair of lowest rank first, the
leftmost of equals, just as the ranks ask for. The model has identity
normalisation; piece numbers are the ranks, the unknown piece comes after them.
Texts are first parted by the vocabulary's pattern; each part that is a token
already is taken as it is, any other is encoded by itself. Decoding maps ids back
to pieces and pieces back to bytes, so it is exact for any text.

Ids are packed as little-endian unsigned 32-bit integers (``ids``, binary), the
form in which training reads them; ``unpack`` gives an array. Null and empty texts
have no ids; special tokens are never made. Texts are encoded whole, however long.
Rows that repeat are encoded alike, columns with clashing names stay (the new ones
must be named otherwise), an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import map_arrow
from .common import as_binary, load

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Parts of a text that a worker remembers, and their longest; bounds its memory.
CACHE_PARTS, CACHE_CHARS = 200_000, 48
#: Bytes of text that are worked on at once.
CHUNK = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def byte_characters() -> list[str]:
    """A printable character for each byte: its own where Latin-1 has one that is no space, else the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [base64.b64decode(a) for a, _ in sorted(pairs, key=lambda p: int(p[1]))]
    if sorted(int(r) for _, r in pairs) != list(range(len(tokens))):
        raise ValueError("ranks have gaps")
    return tokens


def _field(number: int, payload: bytes | int | float) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(payload, float):
        return varint(number << 3 | 5) + struct.pack("<f", payload)
    if isinstance(payload, int):
        return varint(number << 3) + varint(payload)
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: the pieces in the order of rank, the unknown piece last, BPE, no normalisation."""
    chars = byte_characters()
    spelt = lambda t: "".join(chars[b] for b in t).encode()
    out = [_field(1, _field(1, spelt(t)) + _field(2, -float(r))) for r, t in enumerate(tokens)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))  # type UNKNOWN
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))  # model_type BPE, vocab_size, unk_id
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, spaces kept and not escaped
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes bytes; one per Python worker."""

    def __init__(self, vocabulary: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens = read_ranks(vocabulary)
        self.ids = {t: struct.pack("<I", r) for r, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.split = regex.compile(pattern).findall
        self.spelling = dict(enumerate(byte_characters()))
        self.cache: dict[str, bytes] = {}

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of parts that aren't remembered; those of short parts are from now on."""
        found, rest = {}, []
        for part in parts:
            known = self.ids.get(part.encode())
            if known is None:
                rest.append(part)
            else:
                found[part] = known
        spelt = [part.encode().decode("latin-1").translate(self.spelling) for part in rest]
        for part, ids in zip(rest, self.model.encode(spelt, num_threads=1) if spelt else ()):
            found[part] = struct.pack(f"<{len(ids)}I", *ids)
        self.cache.update((p, i) for p, i in found.items() if len(p) <= CACHE_CHARS)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        parted = [self.split(t) for t in texts]
        unknown = set().union(*parted).difference(self.cache)
        if len(self.cache) + len(unknown) > CACHE_PARTS:
            self.cache.clear()
            unknown = set().union(*parted)
        new = self._learn(unknown)
        get = self.cache.get
        return [b"".join([get(p) or new[p] for p in parts]) for parts in parted]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(packed) // 4}I", packed)))


@functools.lru_cache(2)
def _codec(vocabulary: str, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def _mapped(df: DataFrame, keep: list[str], source: Column, names: list[str], work) -> DataFrame:
    """The columns ``keep`` and binary columns that ``work`` makes of another, some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for batch in batches:
            column, at = batch.column(batch.num_columns - 1), 0
            while at < len(column):
                some, size = [], 0
                while at + len(some) < len(column) and size < CHUNK:
                    some.append(column[at + len(some)].as_py() or b"")
                    size += len(some[-1])
                new = [pa.array(x, pa.binary()) for x in f(some)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(some)) for c in batch.columns[:-1]), *new], names=[*batch.schema.names[:-1], *names])
                at += len(some)

    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, T.BinaryType()) for n in names)])
    return map_arrow(df.select(*keep, source.alias("__source")), run, schema)


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, vocabulary: str | None = None, pattern: str | None = None, decoded_col: str | None = None) -> DataFrame:
    """The columns ``keep`` (default: all), and the ids of the text, packed. ``vocabulary`` is a path that every executor has.

    With ``decoded_col`` the ids are decoded again at once, by the same worker, which then holds one vocabulary.
    """
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def work():
        codec = _codec(vocabulary, pattern)

        def both(some: list[bytes]) -> list[list[bytes]]:
            ids = codec.encode([raw.decode() for raw in some])
            return [ids, [codec.decode(x) for x in ids]] if decoded_col else [ids]

        return both

    keep = df.columns if keep is None else keep
    return _mapped(df, keep, as_binary(text_col), [ids_col, *([decoded_col] if decoded_col else [])], work)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` and the bytes that the ids stand for; null ids give no bytes."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def work():
        codec = _codec(vocabulary, pattern)
        return lambda some: [[codec.decode(packed) for packed in some]]

    return _mapped(df, df.columns, F.col(ids_col), [out_col], work)


def unpack(ids: Column) -> Column:
    """Packed ids as an array of integers."""
    n = F.floor(F.octet_length(ids) / 4).cast("int")
    one = lambda i, k: F.conv(F.hex(F.substring(ids, (i - 1) * 4 + k, F.lit(1))), 16, 10).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: one(i, F.lit(1)) + one(i, F.lit(2)) * 256 + one(i, F.lit(3)) * 65_536))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(load(spark, sf_dir, "documents"), keep=["doc_id"], decoded_col="decoded")
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLES = {}

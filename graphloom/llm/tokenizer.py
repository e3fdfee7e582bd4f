"""Encoding of the whole corpus with a public byte-level BPE vocabulary (problem 6).

A sentencepiece BPE model is serialised straight from the vocabulary file, nothing is trained: every token becomes one
piece of byte-mapped characters whose score is its negative rank, so that sentencepiece's best-score-first merging is
the lowest-rank-first merging of the vocabulary; normalisation is identity.  A text is cut into the pre-tokens of the
vocabulary's pattern; pre-tokens not seen before by the worker are mapped to the pieces' alphabet and encoded together,
kept apart by the one mapped byte that UTF-8 never has.  That separator has no piece of its own: it comes back as the
unknown id and ends a pre-token.
Decoding is the inverse mapping.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text; very
long texts are encoded whole.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import spread

VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = "\udcff"  # becomes byte FF, which no UTF-8 text holds


def vocabulary_path(spark: SparkSession) -> str:
    """The setting graphloom.tokenizer.path, else the installed public file."""
    if path := spark.conf.get("graphloom.tokenizer.path", None):
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ids."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in tokens] != list(range(len(tokens))):
        raise ValueError(f"{path}: ranks have gaps")
    return [t for _, t in tokens]


def byte_alphabet() -> list[str]:
    """A visible character for every byte: itself where printable, else the next free one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def field(number: int, value: bytes | int | float | bool) -> bytes:
    """One protobuf field."""
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3) + varint(int(value))


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model; its unknown piece follows the last token."""
    alphabet = byte_alphabet()
    normal, unknown, bpe = 1, 2, 2
    pieces = [field(1, "".join(alphabet[b] for b in t).encode()) + field(2, float(-rank)) + field(3, normal) for rank, t in enumerate(tokens)]
    pieces.append(field(1, "<unk>".encode()) + field(2, 0.0) + field(3, unknown))
    trainer = field(3, bpe) + field(4, len(pieces)) + field(24, False) + field(40, len(tokens)) + field(41, b"") + field(42, b"")
    normaliser = field(1, b"identity") + field(2, b"") + field(3, False) + field(4, False) + field(5, False)
    return b"".join(field(1, p) for p in pieces) + field(2, trainer) + field(3, normaliser)


class Encoder:
    """Encodes lists of texts; made once per Python worker."""

    def __init__(self, model: bytes, room: int = 400_000):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = self.processor.unk_id()
        self.findall = regex.compile(PATTERN).findall
        alphabet = byte_alphabet()
        self.table = {b: alphabet[b] for b in range(255)} | {255: "\n"}
        self.inverse = {c: b for b, c in enumerate(alphabet)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.room = room

    def mapped(self, text: str) -> str:
        return text.encode("utf-8", "surrogateescape").decode("latin-1").translate(self.table)

    def learn(self, pretokens: list[str]) -> None:
        """Encode unseen pre-tokens in one call and remember their ids."""
        whole = self.processor.encode(self.mapped(SEPARATOR.join(pretokens)), num_threads=1)
        ids: list[int] = []
        found: list[tuple[int, ...]] = []
        for i in whole:
            if i == self.unknown:
                found.append(tuple(ids))
                ids.clear()
            else:
                ids.append(i)
        self.known.update(zip(pretokens, [*found, tuple(ids)], strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.room:  # bounds the worker's memory; ids are then found again
            self.known.clear()
        cut = [self.findall(t) for t in texts]
        if new := list(set().union(*cut) - self.known.keys()):
            self.learn(new)
        ids = self.known.__getitem__
        return [np.fromiter(chain.from_iterable(map(ids, p)), np.int32) for p in cut]

    def decode(self, ids: list[int]) -> str:
        joined = "".join(self.processor.id_to_piece([int(i) for i in ids])) if len(ids) else ""
        return bytes(self.inverse[c] for c in joined).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def encoded(texts: DataFrame, key: str = "doc_id", text: str = "text", counts_only: bool = False, step: int = 64) -> DataFrame:
    """(key, ids array<int>), or (key, n_tokens int) where only the counts are wanted."""
    spark = texts.sparkSession
    # Bounded by the vocabulary (about a megabyte), not by the data.
    model = spark.sparkContext.broadcast(model_bytes(read_ranks(vocabulary_path(spark))))
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model.value)
        for batch in batches:
            column = batch.column("text")
            for at in range(0, batch.num_rows, step):
                rows = [t or "" for t in column.slice(at, step).to_pylist()]
                ids = enc.encode(rows)
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                if counts_only:
                    value = pa.array(sizes, pa.int32())
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    value = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, step), value], names=["key", "value"])

    rows = spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")))
    value = "int" if counts_only else "array<int>"
    return rows.mapInArrow(run, f"key {kind}, value {value}").toDF(key, "n_tokens" if counts_only else "ids")


def decoded(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, decoded) of rows (key, ids): the texts that the ids stand for."""
    spark = rows.sparkSession
    model = spark.sparkContext.broadcast(model_bytes(read_ranks(vocabulary_path(spark))))
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([enc.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())], names=["key", "decoded"])

    return rows.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, decoded string").toDF(key, "decoded")

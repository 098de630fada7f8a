"""Byte-level BPE by way of a sentencepiece model that is written straight from the ranks.

Each token of a rank file becomes a sentencepiece BPE piece whose id is its rank
and whose score is the negative rank, so the best-scored merge is the merge of
the lowest rank. Bytes are mapped to printable characters, one for each byte, and
the normaliser leaves text alone. Every match of the split pattern (a pre-token) is
encoded by itself; decoding maps ids to pieces and pieces back to bytes.

Null texts count as empty: no ids, and the hash of nothing. Repeated rows give
repeated rows. Extra columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reach

#: Pre-tokens whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, extra = [], 0
    for byte in range(256):
        if byte in own:
            table.append(chr(byte))
        else:
            table.append(chr(256 + extra))
            extra += 1
    return table


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ranks, which must run from 0 without gaps."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protocol-buffer field: length-delimited, 32-bit float or varint."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece ModelProto of a byte-level vocabulary; piece ids are ranks, the unknown piece comes last."""
    character = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        out += _field(1, _field(1, "".join(character[b] for b in token)) + _field(2, float(-rank)) + _field(3, 1))
    unknown = "⁇unknown"
    out += _field(1, _field(1, unknown) + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1) + _field(45, unknown)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Codec:
    """Encodes to ids and decodes ids, for one worker."""

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.character = {byte: c for byte, c in enumerate(byte_characters())}
        byte = {c: b for b, c in self.character.items()}
        names = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size() - 1)]
        self.token = [bytes(byte[c] for c in name) for name in names]
        self.rank = {name: k for k, name in enumerate(names)}
        self.known: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        """Ids of pre-tokens not seen yet, as little-endian 32-bit integers."""
        mapped = [t.encode().decode("latin-1").translate(self.character) for t in new]
        for token, text, ids in zip(new, mapped, self.pieces.encode(mapped, num_threads=1)):
            whole = self.rank.get(text)  # a pre-token that is a token is that token, whatever the merges make
            self.known[token] = struct.pack(f"<{len(ids)}I", *ids) if whole is None else struct.pack("<I", whole)

    def encode(self, text: str) -> bytes:
        parts = self.split(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        if new := [t for t in dict.fromkeys(parts) if t not in known]:
            self.learn(new)
        return b"".join(map(known.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of each text as little-endian unsigned 32-bit integers."""
    reach(docs.sparkSession)
    model = serialise(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [codec.encode(t.as_py() or "") for t in part.column("text")]
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text_bytes): ids back to the bytes they stand for; null ids give null."""
    reach(encoded.sparkSession)
    model = serialise(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if (ids := x.as_py()) is None else codec.decode(ids) for x in part.column("ids")]
                yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text_bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text_bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids again, and digest both, in one pass that keeps no ids.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256.
    """
    reach(docs.sparkSession)
    model = serialise(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, hashes, back = [], [], []
                for text in part.column("text"):
                    ids = codec.encode(text.as_py() or "")
                    counts.append(len(ids) // 4)
                    hashes.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.record_batch([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

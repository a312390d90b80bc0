"""Byte-level BPE by a sentencepiece model that is serialised straight from a table of ranks.

Each byte is mapped to one printable character, so each vocabulary entry is a piece of such characters
whose score is the negative rank: sentencepiece, which merges the adjacent pair of the highest score
first, then merges as the ranks ask. Normalisation is the identity and white space isn't escaped.
Pre-tokens are encoded one by one and decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import BoundedCache, in_parts, keyed_text


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary by rank. The file is part of an installed library, so each machine has it."""
    with open(path, "rb") as f:
        by_rank = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [by_rank[i] for i in range(len(by_rank))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces 1..n of type NORMAL in order of rank, then one UNKNOWN."""
    letters = byte_alphabet()
    pieces = b"".join(_field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-rank))) for rank, token in enumerate(vocabulary))
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(vocabulary) + 1) + _field(24, 0) + _field(40, len(vocabulary))
    # model_type BPE, vocab_size, no white space prefix, unk_id; bos, eos and pad are off (-1).
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one vocabulary, for one worker."""

    def __init__(self, vocabulary: list[bytes], pattern: str, cache_limit: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(vocabulary))
        self.letters = dict(enumerate(byte_alphabet()))
        byte_of = {letter: b for b, letter in self.letters.items()}
        # each piece of the model by the inverse of the byte map
        self.bytes_of = [bytes(map(byte_of.__getitem__, self.model.IdToPiece(i))) for i in range(len(vocabulary))]
        self.find = regex.compile(pattern).findall
        self.cache = BoundedCache(self._piece, cache_limit)

    def _piece(self, token: str) -> bytes:
        ids = self.model.encode(token.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def byte_bpe(vocabulary_path: str, pattern: str) -> ByteBpe:
    """One for a worker, which outlives a task."""
    return ByteBpe(read_ranks(vocabulary_path), pattern)


def encode_decode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (array<int>), decoded (binary); a null text is empty and has no ids.

    With digests_only, ids and decoded are replaced by their sha256 (ids_sha256, decoded_sha256). Whole
    texts are encoded, of any length; repeated rows give repeated rows.
    """

    def run(batches):
        bpe = byte_bpe(vocabulary_path, pattern)
        for batch in in_parts(batches, 1):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            decoded = [bpe.decode(i) for i in ids]
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            if digests_only:
                columns = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (ids, decoded)]
            else:
                columns = [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *columns], schema.fieldNames())

    given = keyed_text(docs, id_col, text_col)
    kinds = "ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded binary"
    schema = StructType.fromDDL(f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, {kinds}")
    return given.mapInArrow(run, schema)

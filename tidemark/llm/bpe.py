"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary.

Bytes are mapped to one character each, every vocabulary entry becomes a piece scored by its negative rank, and the
normaliser does nothing; the best-scored merge first is then the lowest rank first. Pre-tokens, the matches of the
pattern, are encoded one by one, distinct ones once; ids are decoded by looking up the bytes of each.

Defined cases: a null text counts as empty and has no ids; special tokens don't exist, their strings are ordinary text;
repeated rows stay; extra columns stay, and columns named like an added one are replaced. The model, about 1 MB, goes
with the task. Memory is that of a few MB of text and its distinct pre-tokens, or of the longest text.
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

from tidemark.llm.shared import add_columns, documents

#: Pre-tokens whose ids are remembered from one slice to the next.
REMEMBERED = 100_000
_CHARACTERS = [chr(0x100 + b) for b in range(256)]
_BY_LATIN1 = {b: c for b, c in enumerate(_CHARACTERS)}


def vocabulary(path: str) -> list[bytes]:
    """The entries of a rank file, by rank."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or not {bytes([b]) for b in range(256)} <= ranks.keys():
        raise ValueError(f"{path}: ranks must be 0, 1, ... and every byte must have one")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes are length-delimited, floats 32-bit, ints varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; piece 0 is unknown, piece r + 1 has rank r."""
    bpe, normal, unknown = 2, 1, 2
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for rank, token in enumerate(tokens):
        piece = "".join(map(_CHARACTERS.__getitem__, token)).encode()
        pieces.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, normal)))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1)
    # no character map, no space in front, spaces neither removed nor escaped
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class _Index(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``of`` of a flat array, end to end, and where each ends."""
    size = length[of]
    end = np.cumsum(size)
    at = np.repeat(start[of] - (end - size), size)
    return flat[at + np.arange(len(at))], end


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.find = regex.compile(pattern).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.forget()

    def forget(self) -> None:
        self.index = _Index()
        self.ids, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's end)"""
        if len(self.index) > REMEMBERED:
            self.forget()
        known = len(self.index)
        found = [np.fromiter(map(self.index.__getitem__, self.find((t or b"").decode())), np.int64) for t in texts]
        new = list(self.index)[known:]
        if new:
            coded = self.processor.encode([t.encode().decode("latin-1").translate(_BY_LATIN1) for t in new], num_threads=1)
            self.size = np.concatenate([self.size, np.fromiter(map(len, coded), np.int64, len(coded))])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(coded), np.int32) - 1])
        ids, end = gather(self.ids, np.cumsum(self.size) - self.size, self.size, np.concatenate(found) if found else np.zeros(0, np.int64))
        last = np.cumsum([len(f) for f in found])
        return ids, np.concatenate([[0], end])[last]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, where each text's end)"""
        data, end = gather(self.bytes, self.start, self.length, ids)
        return data, np.concatenate([[0], end])[ends]


@lru_cache(2)
def _codec(model: bytes, tokens: tuple[bytes, ...], pattern: str) -> Codec:
    return Codec(model, list(tokens), pattern)


def _offsets(ends: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], ends]), pa.int32())


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, _offsets(ends).buffers()[1], pa.py_buffer(np.ascontiguousarray(data))])


def default_vocabulary() -> tuple[str, str]:
    """(path, pattern) of the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, decode: bool = False) -> DataFrame:
    """Each row with ``ids``, array<int>, and with ``decode`` also ``decoded``, the bytes that these stand for."""
    usual = default_vocabulary() if path is None or pattern is None else ("", "")
    tokens = tuple(vocabulary(path or usual[0]))
    shipped = docs.sparkSession.sparkContext.broadcast((model_bytes(list(tokens)), tokens, pattern or usual[1]))

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        codec = _codec(*shipped.value)
        ids, ends = codec.encode(texts)
        out = pa.ListArray.from_arrays(_offsets(ends), pa.array(ids, pa.int32()))
        return [out, _binary(*codec.decode(ids, ends))] if decode else [out]

    return add_columns(docs, text, "ids array<int>, decoded binary" if decode else "ids array<int>", work)


def id_slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of runs of at most ``most`` ids, or of one row."""
    end, row = np.cumsum(np.asarray(column.value_lengths().fill_null(0), np.int64)), 0
    while row < len(end):
        held = end[row - 1] if row else 0
        to = max(row + 1, int(np.searchsorted(end, held + most, "right")))
        yield row, column.slice(row, to - row)
        row = to


def decode_ids(docs: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Each row with ``decoded``, the bytes that its ids stand for; null ids stand for none."""
    tokens = tuple(vocabulary(path or default_vocabulary()[0]))
    shipped = docs.sparkSession.sparkContext.broadcast((model_bytes(list(tokens)), tokens, "."))

    def work(rows: pa.Array) -> list[pa.Array]:
        size = np.asarray(rows.value_lengths().fill_null(0), np.int64)
        return [_binary(*_codec(*shipped.value).decode(np.asarray(rows.flatten(), np.int64), np.cumsum(size)))]

    return add_columns(docs, ids, "decoded binary", work, id_slices)


def token_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with the count and digest of its ids and the digest of what they decode to."""
    coded = encode_texts(docs.select("doc_id", text), text, decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))

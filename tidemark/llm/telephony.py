"""Telephony audio in binary columns: mu-law, A-law and IMA ADPCM in WAV files, decoded and stored as resampled PCM.

Companded samples are expanded by 256-entry tables. ADPCM is decoded step by step within a block, each step for the
blocks of all files of a batch at once. PCM is 16 bits, one channel, resampled linearly.

Defined cases: a null file gives nulls; an empty data chunk gives empty PCM; a last ADPCM block that isn't whole is left
out; a file that can't be read, as it isn't a WAV file of these formats or is damaged, gives nulls and the reason in
``error``, and read_wav() raises ValueError; repeated rows stay; extra columns stay, and columns named like an added one are replaced. Memory is
about thirty times a batch of a few MB, or the longest file.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import add_columns, documents

RATE, STORED_RATE = 8_000, 16_000
#: Samples a second that are read.
RATES = (1_000, 768_000)
#: WAV format tags.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
#: An ADPCM block: 4 bytes of header (first sample, step index, 0), then BLOCK_DATA bytes of two 4-bit codes, low first.
BLOCK_HEAD, BLOCK_DATA = 4, 192
PAYLOAD_UNIT = 192

# Fixed values of the IMA ADPCM format: step sizes and step index changes.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
     157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411,
     1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
     11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, size = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(segment == 0, size + 8, size + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of equally long blocks, a row each: the header's sample and two of each data byte."""
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(head[:, 2].astype(np.int32), len(STEPS) - 1)
    data = blocks[:, BLOCK_HEAD:].T
    out = np.empty((1 + 2 * len(data), len(blocks)), np.int16)
    out[0] = value
    for i, column in enumerate(data):
        for half, code in enumerate((column & 15, column >> 4)):
            step = STEPS[index]
            change = step >> 3
            change += np.where(code & 4, step, 0)
            change += np.where(code & 2, step >> 1, 0)
            change += np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + INDEX_STEP[code], 0, len(STEPS) - 1)
            out[1 + 2 * i + half] = value
    return out.T


@dataclass
class Wav:
    tag: int
    rate: int
    data: bytes
    block: int = 1


def write_wav(wav: Wav) -> bytes:
    data = wav.data
    bits, block, more, facts = (4, wav.block, struct.pack("<HH", 2, 1 + 2 * (wav.block - BLOCK_HEAD)), 1 + 2 * (wav.block - BLOCK_HEAD)) if wav.tag == ADPCM else (16, 2, b"", 0) if wav.tag == PCM else (8, 1, struct.pack("<H", 0), 1)
    samples = len(data) // block * facts
    a_second = wav.rate * block // facts if wav.tag == ADPCM else wav.rate * block
    fmt = struct.pack("<HHIIHH", wav.tag, 1, wav.rate, a_second, block, bits) + more
    fact = b"" if wav.tag == PCM else b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(file: bytes) -> Wav:
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        found.setdefault(name, file[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    if b"fmt " not in found or b"data" not in found:
        raise ValueError("a WAV file needs the chunks fmt and data")
    if len(found[b"fmt "]) < 16:
        raise ValueError("the chunk fmt ends early")
    tag, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    if channels != 1 or tag not in (PCM, ALAW, MULAW, ADPCM):
        raise ValueError(f"format {tag} with {channels} channels isn't supported")
    if not RATES[0] <= rate <= RATES[1]:
        raise ValueError(f"{rate} samples a second aren't supported")
    if tag == ADPCM and block <= BLOCK_HEAD:
        raise ValueError(f"ADPCM blocks of {block} bytes have no samples")
    if tag == PCM and len(found[b"data"]) % 2:
        raise ValueError("PCM ends in half a sample")
    return Wav(tag, rate, found[b"data"], block)


def decode(wavs: list[Wav]) -> list[np.ndarray]:
    """16-bit samples of each file; ADPCM blocks of the same size are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(wavs)
    by_block: dict[int, list[int]] = {}
    for i, w in enumerate(wavs):
        if w.tag == ADPCM:
            by_block.setdefault(w.block, []).append(i)
        else:
            out[i] = np.frombuffer(w.data, "<i2") if w.tag == PCM else TABLES[w.tag][np.frombuffer(w.data, np.uint8)]
    for block, members in by_block.items():
        size = [len(wavs[i].data) // block for i in members]
        blocks = np.frombuffer(b"".join(wavs[i].data[: n * block] for i, n in zip(members, size, strict=True)), np.uint8).reshape(-1, block)
        samples, at = decode_adpcm(blocks), 0
        for i, n in zip(members, size, strict=True):
            out[i] = samples[at : at + n].reshape(-1)
            at += n
    return out


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation; the last sample is held."""
    if rate == to or not len(samples):
        return samples
    if to == 2 * rate:
        out = np.empty(2 * len(samples), np.int16)
        out[::2] = samples
        out[1:-1:2] = (samples[:-1].astype(np.int32) + samples[1:]) >> 1
        out[-1] = samples[-1]
        return out
    at = np.minimum(np.arange(len(samples) * to // rate) * (rate / to), len(samples) - 1)
    return np.rint(np.interp(at, np.arange(len(samples)), samples)).astype(np.int16)


def features(pcm: np.ndarray) -> str:
    """Number of samples, peak, mean square, zero crossings and checksum of the PCM."""
    wide = pcm.astype(np.int32)
    square = int(np.dot(wide.astype(np.float64), wide) // max(1, len(pcm)))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"samples={len(pcm)} peak={int(np.abs(wide).max(initial=0))} square={square} crossings={crossings} crc={zlib.crc32(np.ascontiguousarray(pcm).tobytes())}"


def pack(payload: bytes) -> Wav:
    """Bytes as stored samples, losslessly: companded bytes as they are, or ADPCM codes in blocks; which, the bytes decide."""
    tag = (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]
    if tag != ADPCM:
        return Wav(tag, RATE, payload)
    blocks = np.zeros((-(-len(payload) // BLOCK_DATA), BLOCK_HEAD + BLOCK_DATA), np.uint8)
    blocks[:, BLOCK_HEAD:] = np.frombuffer(payload.ljust(len(blocks) * BLOCK_DATA, b" "), np.uint8).reshape(-1, BLOCK_DATA)
    return Wav(tag, RATE, blocks.tobytes(), BLOCK_HEAD + BLOCK_DATA)


def unpack(wav: Wav) -> bytes:
    """The bytes that pack() stored, read from the file's data."""
    if wav.tag != ADPCM:
        return wav.data
    whole = len(wav.data) // wav.block * wav.block
    return np.frombuffer(wav.data[:whole], np.uint8).reshape(-1, wav.block)[:, BLOCK_HEAD:].tobytes()


def readable(file: bytes | None) -> tuple[Wav | None, str | None]:
    """(the file, None), or (None, why it can't be read); neither for a null."""
    if file is None:
        return None, None
    try:
        return read_wav(file), None
    except ValueError as error:
        return None, str(error)


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % PAYLOAD_UNIT if text else PAYLOAD_UNIT)


def store_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row with ``n_bytes`` of its text and ``media``, the WAV file that holds the padded text."""

    def work(values: list[bytes | None]) -> list[pa.Array]:
        files = [write_wav(pack(pad(v or b""))) for v in values]
        return [pa.array([len(v or b"") for v in values], pa.int64()), pa.array(files, pa.binary())]

    return add_columns(docs, text, "n_bytes long, media binary", work)


def decode_media(files: DataFrame, media: str = "media", rate: int = STORED_RATE) -> DataFrame:
    """Each row with ``payload``, the stored bytes, ``pcm``, a WAV file of PCM at ``rate``, its ``feature``s, and ``error``."""

    def work(values: list[bytes | None]) -> list[pa.Array]:
        read = [readable(v) for v in values]
        wavs = [w for w, _ in read]
        samples = iter(decode([w for w in wavs if w]))
        pcm = [resample(next(samples), w.rate, rate) if w else None for w in wavs]
        return [
            pa.array([unpack(w) if w else None for w in wavs], pa.binary()),
            pa.array([write_wav(Wav(PCM, rate, p.tobytes())) if p is not None else None for p in pcm], pa.binary()),
            pa.array([features(p) if p is not None else None for p in pcm], pa.string()),
            pa.array([e for _, e in read], pa.string()),
        ]

    return add_columns(files, media, "payload binary, pcm binary, feature string, error string", work)


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = decode_media(store_media(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    return heard.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )


def op2_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of it: sizes and digests of the payloads."""
    return op2_telephony(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


OP2_SQL = """
with doc as (select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, '')))::bigint as n_bytes from documents),
padded as (select *, case when n_bytes = 0 then 192 else (192 - n_bytes % 192) % 192 end as pad from doc)
select doc_id, n_bytes, n_bytes + pad as payload_bytes, sha256(text || repeat(' ', pad)) as payload_sha256 from padded
"""

"""Substring dedup by level-wise doubling.

A window of ``min_words`` words is repeated if its word sequence also starts anywhere else, in the same text or another.
Levels of growing length find all repeated windows: runs of about a quarter of ``min_words`` come first, and only those
that are repeated are extended to twice that length, and so on, until ``min_words`` is reached or no candidate survives.

What a window is extended from depends on its own words alone (the run with the least hash among its first-level runs,
then the double-length run that holds it), so equal windows take the same way through the levels and none is missed,
while neighbouring windows share a first-level run and few of them are compared.

Texts are dealt evenly into chunks and stored once. At each level a chunk sends its distinct run hashes, sorted, to hash-
range buckets and gets back one bit for each: whether it was seen twice. A passage that a third of all texts holds is thus
one hash a chunk, and texts themselves are not shuffled again. After the first level a chunk's rows and windows that are left
are written as sequences of places, with the hashes of their few second-level runs, so that level reads no texts, and whole
windows are hashed in the rows that are left alone.

Defined cases: a null text has no words and an empty kept text; texts shorter than a window lose nothing; repeated rows
are copies of each other like any two texts; extra columns stay, and columns named like an added one are replaced. Two
windows are taken as equal if 64-bit hashes are equal at every level. Memory is that of one chunk or of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import documents, map_batches, shuffle_parts, steady, stored, stored_by, text_bytes
from tidemark.llm.words import Words, window_hashes

MIN_WORDS = 35
#: Text bytes of a chunk, and chunks whose hashes meet in one bucket.
CHUNK_BYTES = 3 << 20
CHUNKS_A_BUCKET = 16

_SENT = "bucket long, chunk long, hashes binary, twice binary"
_REPLY = "chunk long, bucket long, bits binary"
_LEFT = "chunk long, rows binary, windows binary, seeds binary, hashes binary"


def doubling(min_words: int) -> list[int]:
    """Lengths of the levels: each at most twice the one before, the last is min_words."""
    return [-(-min_words // 4), -(-min_words // 2), min_words] if min_words >= 4 else [min_words]


def runs(windows: np.ndarray, seed: np.ndarray, lengths: list[int], level: int) -> np.ndarray:
    """For each window, the start of the run that stands for it at a level; seed: that at the first one."""
    if level == len(lengths) - 1:
        return windows
    left = lengths[level] - lengths[0]
    return np.where(seed - windows >= left, seed - left, seed)


def first_level(texts: list[bytes | None], lengths: list[int]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, windows, the first-level run of each, hashes of all runs by place)"""
    words = Words(texts)
    windows = np.flatnonzero(words.window_starts(lengths[-1]))
    of_runs = window_hashes(words.hashes(), lengths[0])
    return words, windows, least(of_runs, lengths[-1] - lengths[0] + 1)[windows], of_runs


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbours, the first of equals."""
    if len(x) < width:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(x)), 1

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[a] <= x[b], a, b)

    while 2 * size <= width:
        at = lesser(at[:-size], at[size:])
        size *= 2
    return lesser(at[: len(at) - (width - size)], at[width - size :]) if size < width else at


def ranges(distinct: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes."""
    if not len(distinct):
        return []
    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return [(int(bucket[lo]), int(lo), int(hi)) for lo, hi in zip(cut, [*cut[1:], len(bucket)], strict=True)]


def answered(hashes: np.ndarray, replies: pa.Table, buckets: int) -> np.ndarray:
    """Which of the hashes that a chunk sent were seen twice."""
    distinct, which = np.unique(hashes, return_inverse=True)
    repeated, got = np.zeros(len(distinct), bool), dict(zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist(), strict=True))
    for bucket, lo, hi in ranges(distinct, buckets):
        if bits := got.get(bucket):
            repeated[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
    return repeated[which]


def _sent(chunk: int, hashes: np.ndarray, buckets: int) -> dict[str, pa.Array]:
    distinct, times = np.unique(hashes, return_counts=True)
    parts = ranges(distinct, buckets)
    return {
        "bucket": pa.array([b for b, _, _ in parts], pa.int64()),
        "chunk": pa.array([chunk] * len(parts), pa.int64()),
        "hashes": pa.array([distinct[lo:hi].tobytes() for _, lo, hi in parts], pa.binary()),
        "twice": pa.array([np.packbits(times[lo:hi] > 1).tobytes() for _, lo, hi in parts], pa.binary()),
    }


def _texts(docs: pa.Table, text: str) -> list[bytes | None]:
    return docs.column(text).cast(pa.large_binary()).to_pylist()


def _send_first(text: str, lengths: list[int], buckets: int):
    def send(docs: pa.Table) -> pa.Table:
        _, _, seed, of_runs = first_level(_texts(docs, text), lengths)
        return pa.table(_sent(docs.column("_td_chunk")[0].as_py(), of_runs[np.unique(seed)] if len(seed) else of_runs[:0], buckets))

    return send


def _send_kept(buckets: int):
    """The hashes that were written with what is left of a chunk."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield pa.record_batch(_sent(batch.column(0)[row].as_py(), np.frombuffer(batch.column(4)[row].as_py(), np.uint64), buckets))

    return send


def _send_last(text: str, min_words: int, buckets: int):
    """The hashes of the whole windows that are left, from the texts that have any."""

    def send(docs: pa.Table, state: pa.Table) -> pa.Table:
        if not docs.num_rows or not state.num_rows:
            return pa.table(_sent(0, np.zeros(0, np.uint64), buckets))
        _, windows, hashes = whole_windows(docs, state, text, min_words)
        return pa.table(_sent(docs.column("_td_chunk")[0].as_py(), hashes, buckets))

    return send


def whole_windows(docs: pa.Table, state: pa.Table, text: str, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with windows, windows as places among these rows' words, their hashes)"""
    rows, windows = unpack(state.column("rows")[0].as_py(), 1), unpack(state.column("windows")[0].as_py(), 1)
    h = Words(docs.column(text).take(pa.array(rows)).cast(pa.large_binary()).to_pylist()).hashes()
    return rows, windows, window_hashes(h, min_words)[windows]


def pack(values: np.ndarray, step: int) -> bytes:
    """Sequences of equal steps, as the first value and the length of each."""
    if not len(values):
        return b""
    first = np.concatenate([[0], np.flatnonzero(np.diff(values) != step) + 1])
    return np.stack([values[first], np.diff(np.append(first, len(values)))]).astype(np.int32).tobytes()


def unpack(packed: bytes, step: int) -> np.ndarray:
    value, length = np.frombuffer(packed, np.int32).reshape(2, -1).astype(np.int64)
    end = np.cumsum(length)
    return np.repeat(value - step * (end - length), length) + step * np.arange(end[-1] if len(end) else 0)


def _left(chunk: int, rows: np.ndarray, windows: np.ndarray, seed: np.ndarray, hashes: np.ndarray) -> pa.Table:
    some = [chunk] if len(windows) else []
    packed = {"rows": pack(rows, 1), "windows": pack(windows, 1), "seeds": pack(seed, 0), "hashes": hashes.tobytes()}
    return pa.table({"chunk": pa.array(some, pa.int64()), **{n: pa.array([x for _ in some], pa.binary()) for n, x in packed.items()}})


_NONE = np.zeros(0, np.int64)


def _keep_first(text: str, lengths: list[int], buckets: int):
    """Of a chunk the rows with windows whose first-level run is repeated, these windows, and hashes of their next runs."""

    def keep(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows or not replies.num_rows:
            return _left(0, _NONE, _NONE, _NONE, _NONE)
        words, windows, seed, of_runs = first_level(_texts(docs, text), lengths)
        starts = np.unique(seed)
        alive = np.zeros(len(words.doc) + 1, bool)
        alive[starts[answered(of_runs[starts], replies, buckets)]] = True
        left = alive[seed]
        windows, seed = windows[left], seed[left]
        hashes = window_hashes(words.hashes(), lengths[1])[np.unique(runs(windows, seed, lengths, 1))] if len(lengths) > 2 and len(windows) else _NONE
        # places among the words of the rows that are left
        rows, which = np.unique(words.doc[windows], return_inverse=True)
        size = np.diff(words.first)[rows]
        shift = (np.cumsum(size) - size - words.first[rows])[which]
        return _left(docs.column("_td_chunk")[0].as_py(), rows, windows + shift, seed + shift, hashes)

    return keep


def _keep_next(lengths: list[int], buckets: int):
    """The same for the second level, from what was kept at the first; texts aren't read."""

    def keep(state: pa.Table, replies: pa.Table) -> pa.Table:
        if not state.num_rows or not replies.num_rows:
            return _left(0, _NONE, _NONE, _NONE, _NONE)
        windows, seed = unpack(state.column("windows")[0].as_py(), 1), unpack(state.column("seeds")[0].as_py(), 0)
        run = runs(windows, seed, lengths, 1)
        good = np.unique(run)[answered(np.frombuffer(state.column("hashes")[0].as_py(), np.uint64), replies, buckets)]
        left = np.isin(run, good)
        return _left(state.column("chunk")[0].as_py(), unpack(state.column("rows")[0].as_py(), 1), windows[left], seed[left], _NONE)

    return keep


def _meet(table: pa.Table) -> pa.Table:
    sent = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)) for x, h in zip(table.column("twice").to_pylist(), sent, strict=True)]
    hashes, repeated = np.concatenate(sent), np.concatenate(twice).astype(bool)
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    rows, at = [], 0
    for chunk, bucket, h in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), sent, strict=True):
        bits = repeated[at : at + len(h)]
        at += len(h)
        if bits.any():
            rows.append({"chunk": chunk, "bucket": bucket, "bits": np.packbits(bits).tobytes()})
    return pa.Table.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())]))


def cut_words(words: Words, drop: np.ndarray) -> list[bytes]:
    """The texts' words that aren't dropped, joined by one space."""
    kept = ~drop
    step = np.zeros(len(words.buf) + 2, np.int8)
    step[words.start[kept]] += 1
    step[words.end[kept] + 1] -= 1
    inside = np.cumsum(step[: len(words.buf)], dtype=np.int8).astype(bool)
    out = words.buf.copy()
    out[words.end[kept]] = 0x20
    out = out[inside].tobytes()
    size = np.zeros(len(words.doc) + 1, np.int64)
    np.cumsum(np.where(kept, words.end - words.start + 1, 0), out=size[1:])
    edge = size[words.first]
    return [out[lo : max(lo, hi - 1)] for lo, hi in zip(edge[:-1], edge[1:], strict=True)]


def _finish(text: str, lengths: list[int], buckets: int, fields: list[str], schema: pa.Schema):
    min_words = lengths[-1]

    def finish(docs: pa.Table, found: pa.Table) -> pa.Table:
        """``found`` has the row of what is left of the chunk, and the replies to its last hashes."""
        words = Words(_texts(docs, text) if docs.num_rows else [])
        step = np.zeros(len(words.doc) + 1, np.int32)
        state = found.filter(found.column("windows").is_valid())
        if state.num_rows:
            if len(lengths) > 1:
                rows, windows, hashes = whole_windows(docs, state, text, min_words)
                windows = windows[answered(hashes, found.filter(found.column("bits").is_valid()), buckets)]
            else:
                rows, windows = unpack(state.column("rows")[0].as_py(), 1), unpack(state.column("windows")[0].as_py(), 1)
            size = np.diff(words.first)[rows]
            end = np.cumsum(size)
            of = np.searchsorted(end, windows, "right")
            windows = windows - (end - size)[of] + words.first[rows][of]
            step[windows] += 1
            step[windows + min_words] -= 1
        drop = np.cumsum(step[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(drop)])[words.first]
        columns = [docs.column(f) for f in fields] + [
            pa.array(np.diff(words.first), pa.int64()),
            pa.array(np.diff(removed), pa.int64()),
            pa.array(cut_words(words, drop), pa.binary()).cast(pa.string()),
        ]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return finish


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Each row with ``n_words``, ``n_removed`` and ``kept_text``: the words that no repeated window covers, by one space."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, lengths = docs.sparkSession, doubling(min_words)
    chunks = max(1, -(-text_bytes(docs, text) // chunk_bytes))
    buckets = -(-chunks // CHUNKS_A_BUCKET)
    parts = max(shuffle_parts(spark), -(-chunks // 16))
    added = T.StructType.fromDDL("n_words long, n_removed long, kept_text string")
    fields = [f for f in docs.schema.fields if f.name.lower() not in {a.name for a in added.fields} and f.name != "_td_chunk"]
    docs = steady(docs.select(*[F.col(f"`{f.name}`") for f in fields]))
    # rows are dealt by their place, so that equal rows aren't one chunk
    place = F.xxhash64(F.lit("chunk"), F.monotonically_increasing_id())
    dealt = stored_by(docs.select(*[F.col(f"`{f.name}`") for f in fields], F.pmod(place, F.lit(chunks)).alias("_td_chunk")), "_td_chunk", parts)
    short = dealt.select("_td_chunk", text)
    by_chunk = short.groupBy("_td_chunk")

    def answers(sent: DataFrame) -> DataFrame:
        return stored(sent.groupBy("bucket").applyInArrow(_meet, _REPLY))

    replies = answers(by_chunk.applyInArrow(_send_first(text, lengths, buckets), _SENT))
    state = stored(by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(_keep_first(text, lengths, buckets), _LEFT))
    if len(lengths) > 1:
        replies = answers(map_batches(state, _send_kept(buckets), _SENT))
        state = stored(state.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_keep_next(lengths, buckets), _LEFT))
        found = state.unionByName(answers(by_chunk.cogroup(state.groupBy("chunk")).applyInArrow(_send_last(text, min_words, buckets), _SENT)), True)
    else:
        found = state.withColumn("bits", F.lit(None).cast("binary"))
    out = T.StructType([*fields, *added.fields])
    finish = _finish(text, lengths, buckets, [f.name for f in fields], to_arrow_schema(out))
    return dealt.groupBy("_td_chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, out)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


#: The same in DuckDB's SQL, for unique ids.
OP1_SQL = r"""
with doc as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
win as (
  select doc_id, i, array_to_string(words[i:i + 34], ' ') as said
  from (select doc_id, words, unnest(range(1, len(words) - 33)) as i from doc)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by said) as n from win) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as i from again),
word as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from doc),
kept as (
  select w.doc_id, string_agg(w.word, ' ' order by w.i) as said, count(*) as n
  from word w left join gone g on w.doc_id = g.doc_id and w.i = g.i where g.i is null group by w.doc_id)
select d.doc_id, len(d.words)::bigint as n_words, (len(d.words) - coalesce(k.n, 0))::bigint as n_removed,
  sha256(coalesce(k.said, '')) as kept_sha256
from doc d left join kept k on d.doc_id = k.doc_id
"""

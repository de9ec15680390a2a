"""Near duplicates by ProbMinHash, banding and verification.

Shingles are five consecutive words, weighted by how often they occur in a text. The similarity is the probability
Jaccard index of the weighted shingles, which for texts without a repeated shingle is the plain Jaccard index.

Signatures: each shingle's arrivals are a Poisson process with its weight as rate, each arrival falls to a random
register, and a register keeps the shingle that came first. Shingles stop when their next arrival is later than the last
register's first, so a text takes little more than one arrival a shingle. Two registers agree with the probability that
is the similarity. Five registers make a band, 32 bands a signature: two texts at the threshold meet in no band with a
probability of 3e-6.

Texts with the same words are one candidate, the one with the least id. In each bucket of a band the candidates are
compared with two leaders, the least id and the one with the least hash; pairs at or above the threshold, found by the
exact similarity of whole texts, are links, and components of links are classes. What a bucket still holds in several
classes is compared across the classes, so no link between classes is lost and a class isn't compared within itself.
Pairs are dropped before texts are read whose signatures agree in under ``SURELY_LESS`` of the registers; a pair at the
threshold does with a probability of 1e-6.

Comparing across classes: tasks take many buckets of up to ``BLOCK`` texts, with signatures alone. A bucket with few pairs
left gives these pairs. One with many, a crowd of texts just below the threshold, would give a number of pairs that grows
with its square; its texts go to a task instead, and only links come out. A larger bucket is split before that, without
losing a link, by how its texts differ from one of them (``split_crowds``), until its parts are small.

Defined cases: texts of one to four words have one shingle, all their words; texts without words, null ones too, and rows
with a null id are classes of their own; an id that repeats stands for all of its rows, whatever their texts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.graph import components
from tidemark.llm.shared import documents, map_batches, stored
from tidemark.llm.words import Words, mix, pair_hash, slices, window_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
SURELY_LESS = 0.65
#: Rows of a bucket that a task holds at once, and pairs a row beyond which a bucket counts as crowded.
BLOCK, PAIRS_A_ROW = 1024, 2
SEED = 11
#: A text's distinct shingles, sorted, and how often each occurs.
Shingles = tuple[np.ndarray, np.ndarray]


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times) of the distinct shingles of each text, by text and hash."""
    h, n = words.hashes(), np.diff(words.first)
    at = np.flatnonzero(words.window_starts(SHINGLE))
    of, value = [words.doc[at]], [window_hashes(h, SHINGLE)[at]]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n == k)
        of.append(short)
        value.append(window_hashes(h, k)[words.first[short]] if len(short) else np.zeros(0, np.uint64))
    of, value = np.concatenate(of), np.concatenate(value)
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return of[first], value[first], np.diff([*first, len(of)])


def signatures(of: np.ndarray, value: np.ndarray, times: np.ndarray, texts: int, registers: int = BANDS * ROWS, seed: int = SEED) -> np.ndarray:
    """ProbMinHash: a row of registers a text, 0 where it has no shingle."""
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    now, i = np.zeros(len(value)), 0
    of = of.astype(np.int64)
    while len(value):
        draw = mix(value ^ mix(np.full(1, (seed << 32) + i, np.uint64)))
        now = now - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / times
        register = of * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, register, now)
        won = first[register] == now
        winner[register[won]] = value[won]
        # early termination: what arrives after all registers are taken can't win
        left = now < first.reshape(-1, registers).max(axis=1)[of]
        of, value, times, now, i = of[left], value[left], times[left], now[left], i + 1
    return winner.reshape(-1, registers)


def bands(signature: np.ndarray) -> np.ndarray:
    """A key for each band."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        key = pair_hash(key, parts[:, :, i])
    return key


def similarity(a: Shingles, b: Shingles) -> float:
    """Probability Jaccard index of two (sorted hashes, times): sum over d of 1 / sum over e of max(x[e]/x[d], y[e]/y[d])."""
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    if (a[1] == 1).all() and (b[1] == 1).all():
        return len(shared) / (len(a[0]) + len(b[0]) - len(shared))
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    rest_x, rest_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(y / x)
    x, y = x[order], y[order]
    # for d, the e with a ratio y/x up to d's are larger on the side of x
    below, above = np.cumsum(x), y.sum() - np.cumsum(y)
    return float((1 / ((rest_x + below) / x + (rest_y + above) / y)).sum())


def signed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, key, bands, bytes``: a 128-bit key of the words, the band keys, and a byte of each register; texts with words only."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in slices(batch.column(1)):
                words = Words(texts)
                some = np.flatnonzero(np.diff(words.first))
                h, place = words.hashes(), (np.arange(len(words.doc)) - words.first[words.doc]).astype(np.uint64)
                start = words.first[some]
                sums = [np.add.reduceat(pair_hash(h, place, salt), start) if len(some) else np.zeros(0, np.uint64) for salt in (1, 2)]
                registers = signatures(*shingles(words), len(texts))[some]
                small = (mix(registers.copy()) >> np.uint64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(texts)).take(pa.array(some)),
                        pa.array([bytes(k) for k in np.stack(sums, 1).view("V16")[:, 0]], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(bands(registers).reshape(-1).view(np.int64))),
                        pa.array([bytes(s) for s in small], pa.binary()),
                    ],
                    names=["id", "key", "bands", "bytes"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.where(F.col(id_col).isNotNull()).select(id_col, text), sign, f"id {id_type}, key binary, bands array<long>, bytes binary")


def alike(pairs: DataFrame, unique: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree in SURELY_LESS of the registers or more."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for i in (2, 3))
            good = pa.array((x == y).sum(axis=1) >= SURELY_LESS * BANDS * ROWS)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    id_type = pairs.schema["a"].dataType.simpleString()
    brief = unique.select("rep", "bytes")
    both = pairs.select("a", "b").join(brief.toDF("a", "bytes_a"), "a").join(brief.toDF("b", "bytes_b"), "b")
    return map_batches(both.select("a", "b", "bytes_a", "bytes_b"), agree, f"a {id_type}, b {id_type}")


def _both(left: pa.Array, right: pa.Array) -> Iterator[tuple[int, Shingles, Shingles]]:
    """(row, shingles of one text, shingles of the other) of each row, a slice of texts at a time."""
    n, carried = len(left), None
    both = pa.concat_arrays([left, right]).take(pa.array(np.stack([np.arange(n), np.arange(n) + n], 1).reshape(-1)))
    for row, part in slices(both):
        if row % 2:
            part, row = [carried, *part], row - 1
        carried = part.pop() if len(part) % 2 else None
        of, value, times = shingles(Words(part))
        edge = np.searchsorted(of, np.arange(len(part) + 1))
        sets = [(value[lo:hi], times[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
        for i in range(0, len(sets), 2):
            yield (row + i) // 2, sets[i], sets[i + 1]


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose whole texts are as similar as the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, x, y in _both(batch.column(2), batch.column(3)):
                good[i] = similarity(x, y) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    id_type = pairs.schema["a"].dataType.simpleString()
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return map_batches(pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b"), compare, f"a {id_type}, b {id_type}")


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many registers each row of x agrees with each row of y."""
    return np.stack([(row == y).sum(axis=1) for row in x]) if len(x) else np.zeros((0, len(y)), int)


def _candidates(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each bucket in a unit: (its rows, i, j) of the pairs across classes that may be similar."""
    bucket = np.asarray(rows.column("bucket").to_numpy())
    order = np.argsort(bucket, kind="stable")
    root = np.unique(np.array(rows.column("root").to_pylist()), return_inverse=True)[1]
    small = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    edges = np.flatnonzero(np.diff(bucket[order], prepend=bucket[order[:1]] - 1, append=bucket[order[-1:]] + 1))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        at = order[lo:hi]
        good = (root[at][:, None] != root[at]) & (_agreement(small[at], small[at]) >= SURELY_LESS * BANDS * ROWS)
        yield at, *np.nonzero(np.triu(good, 1))


def _sift(id_type: pa.DataType, pairs_a_row: int):
    """Pairs of the buckets that have few; of the others the bucket with a null pair."""

    def sift(rows: pa.Table) -> pa.Table:
        rep, bucket, a, b, crowd = rows.column("rep"), rows.column("bucket"), [], [], []
        for at, i, j in _candidates(rows):
            if len(i) > pairs_a_row * len(at):
                crowd.append(bucket[int(at[0])].as_py())
            else:
                a.append(at[i])
                b.append(at[j])
        first, second = (rep.take(pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64))) for x in (a, b))
        none = pa.nulls(len(crowd), id_type)
        one, other = (pa.concat_arrays([*x.chunks, none]) for x in (first, second))
        return pa.table({"a": one, "b": other, "bucket": pa.array([None] * len(first) + crowd, pa.int64())})

    return sift


def _crowd(id_type: pa.DataType, threshold: float):
    """Links across the classes of crowded buckets, no more than it takes to join them."""

    def link(rows: pa.Table) -> pa.Table:
        of, value, times = shingles(Words(rows.column("text").cast(pa.large_binary()).to_pylist()))
        edge = np.searchsorted(of, np.arange(rows.num_rows + 1))
        size, plain = np.diff(edge), np.ones(rows.num_rows, bool)
        plain[of[times > 1]] = False
        shingle, which, common = np.unique(value, return_inverse=True, return_counts=True)
        dense = np.cumsum(common > 1) - 1
        a, b = [], []
        for at, i, j in _candidates(rows):
            place = np.full(rows.num_rows, -1)
            place[at] = np.arange(len(at))
            mine = np.flatnonzero((place[of] >= 0) & (common[which] > 1))
            row, column = place[of[mine]], dense[which[mine]]
            used, column = np.unique(column, return_inverse=True)
            shared = np.zeros((len(at), len(at)), np.float32)
            for lo in range(0, len(used), 4096):
                part = np.zeros((len(at), min(4096, len(used) - lo)), np.float32)
                inside = (column >= lo) & (column < lo + 4096)
                part[row[inside], column[inside] - lo] = 1
                shared += part @ part.T
            parent = list(range(len(at)))

            def top(x: int, parent: list[int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            n = size[at]
            both = plain[at[i]] & plain[at[j]]
            near = np.where(both, shared[i, j] / (n[i] + n[j] - shared[i, j]) >= threshold - 1e-6, True)
            for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
                if top(x) == top(y):
                    continue
                sets = [(value[edge[k] : edge[k + 1]], times[edge[k] : edge[k + 1]]) for k in (at[x], at[y])]
                if similarity(*sets) >= threshold:
                    parent[top(x)] = top(y)
                    a.append(at[x])
                    b.append(at[y])
        rep = rows.column("rep")
        return pa.table({"a": rep.take(pa.array(a, pa.int64())), "b": rep.take(pa.array(b, pa.int64()))})

    return link


def difference(x: Shingles, pivot: Shingles, threshold: float) -> tuple[float, bool, bool, int, np.ndarray]:
    """(similarity to the pivot, both plain, odd, how many of the differences have to be looked at, the differences).

    A difference is a shingle that x has more or fewer times than the pivot. Of a link between texts x and y, one of which
    is no link of the pivot, both have some difference in common, unless one of them is odd: in the race that similarity is
    the odds of, x and y often have the same winner and the pivot another one; then x and y both have more of the winner
    or both have less of the pivot's, or one has more of a shingle that the pivot has too. ``odd`` is if the odds of that
    last case are more than what x is short of the threshold allows.

    If all texts are plain, without a shingle twice, counts say how many differences they share: of d differences of a text
    that isn't linked to the pivot more than t / (1 + t) * d with another such text and half of what it has beyond those
    of a link with a linked one; of a linked text's d more than t / (1 + t) * d. So all but that many less one suffice.
    """
    every = np.union1d(x[0], pivot[0])
    mine, theirs = np.zeros(len(every)), np.zeros(len(every))
    mine[np.searchsorted(every, x[0])] = x[1]
    theirs[np.searchsorted(every, pivot[0])] = pivot[1]
    alike, more = similarity(x, pivot), mine > theirs
    differs = np.concatenate([every[more], mix(~every[mine < theirs])])
    plain = bool((x[1] == 1).all() and (pivot[1] == 1).all())
    risen = np.flatnonzero(more & (theirs > 0))
    doubt = sum(mine[d] / mine.sum() - 1 / np.maximum(mine / mine[d], theirs / theirs[d]).sum() for d in risen)
    odd = doubt > 0 and (alike >= threshold or 2 * doubt >= threshold - alike)
    n, share = len(differs), threshold / (1 + threshold)
    look = n - int(np.floor(share * n - 1e-9)) if n else 0
    if alike < threshold:
        beyond = (1 + threshold) * n - (1 - threshold) * (len(x[0]) + len(pivot[0]))
        look = max(look, n - int(np.ceil(beyond / 2 - 1e-9)) + 1)
    return alike, plain, odd, min(n, look), differs


def split_crowds(crowds: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links ``a, b``, smaller buckets ``bucket, rep``) of large buckets ``bucket, rep, pivot``: exact, and linear in rows.

    Each text is compared with its bucket's pivot. What is then left to find has a difference from the pivot in common and
    meets in a bucket of that difference; rare differences come first, and those that are enough for a link to be found are
    taken. Differences of one text or of linked texts alone are left out. Odd texts are compared with the whole bucket.
    """
    name = crowds.schema["rep"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [difference(x, pivot, threshold) for _, x, pivot in _both(batch.column(3), batch.column(4))]
            ends = np.cumsum([0, *(len(f[4]) for f in found)])
            flat = np.concatenate([np.zeros(0, np.uint64), *(f[4] for f in found)]).view(np.int64)
            columns = [pa.array([f[0] >= threshold for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.bool_()), pa.array([bool(f[2]) for f in found], pa.bool_()), pa.array([f[3] for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["bucket", "rep", "pivot", "linked", "plain", "odd", "look", "differs"])

    said = texts.select(F.col("id").alias("rep"), "text")
    both = crowds.join(said, "rep").join(said.toDF("pivot", "pivot_text"), "pivot").select("bucket", "rep", "pivot", "text", "pivot_text")
    seen = stored(map_batches(both, compare, f"bucket long, rep {name}, pivot {name}, linked boolean, plain boolean, odd boolean, look int, differs array<long>"))
    links = seen.where("linked and rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    plain = seen.groupBy("bucket").agg(F.min("plain").alias("all_plain"))
    each = seen.select("bucket", "rep", "linked", F.explode("differs").alias("differs"))
    asked = each.groupBy("bucket", "differs").agg(F.count(F.lit(1)).alias("n"), F.min("linked").alias("linked")).where("n > 1 and not linked").drop("linked")
    own = Window.partitionBy("bucket", "rep")
    ranked = each.drop("linked").join(asked, ["bucket", "differs"]).withColumn("nth", F.row_number().over(own.orderBy("n", "differs"))).withColumn("shared", F.count(F.lit(1)).over(own))
    enough = F.when(F.col("all_plain"), F.col("look")).otherwise(F.size("differs"))
    sizes = seen.join(plain, "bucket").select("bucket", "rep", (enough - F.size("differs")).alias("spare"))
    looked = stored(ranked.join(sizes, ["bucket", "rep"]).where("nth <= shared + spare").select("bucket", "differs", "rep"))
    # differences that the same texts have, as neighbours in a text do, make one bucket
    same = looked.groupBy("bucket", "differs").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who")).where("n > 1")
    finer = looked.join(same, ["bucket", "differs"]).select(F.xxhash64("n", "who").alias("bucket"), "rep").distinct()
    odd = seen.where("odd").select("bucket", F.col("rep").alias("odd")).join(seen.select("bucket", "rep"), "bucket").where("odd <> rep")
    pairs = odd.select(F.least("odd", "rep").alias("a"), F.greatest("odd", "rep").alias("b")).distinct()
    return stored(links.unionByName(verified(pairs, texts, threshold))), stored(finer)


def across_classes(placed: DataFrame, links: DataFrame, unique: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` between members of a bucket that are in different classes, found from ``links``; placed: bucket, rep, root."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, name = to_arrow_type(placed.schema["rep"].dataType), placed.schema["rep"].dataType.simpleString()
    found, buckets, level = [], [], 0
    while True:
        several = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("bucket", "n")
        rest = stored(placed.join(several, "bucket"))
        buckets.append(rest.where(F.col("n") <= BLOCK).drop("n"))
        large = rest.where(F.col("n") > BLOCK)
        if large.isEmpty():
            break
        if level:
            pivots = large.groupBy("bucket").agg(F.min_by("rep", F.xxhash64("rep")).alias("pivot"))
            crowds = large.join(pivots, "bucket").select("bucket", "rep", "pivot")
        else:
            # buckets of different bands that have the same largest class are split as one
            pivots = large.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("pivot"))
            crowds = large.join(pivots, "bucket").select(F.xxhash64("pivot").alias("bucket"), "rep", "pivot").distinct()
        more, finer = split_crowds(crowds, texts, threshold)
        found.append(more)
        if not level:
            roots = stored(components(links.unionByName(more)).withColumnRenamed("id", "rep"))
        placed, level = stored(finer.join(roots, "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))), level + 1
    rest = stored(reduce(DataFrame.unionByName, buckets))
    shards = max(1, -(-rest.count() // (2 * BLOCK)))
    rest = rest.withColumn("unit", F.pmod(F.xxhash64("bucket"), F.lit(shards))).join(unique.select("rep", "bytes"), "rep")
    sifted = stored(rest.groupBy("unit").applyInArrow(_sift(id_type, PAIRS_A_ROW), f"a {name}, b {name}, bucket long"))
    pairs = sifted.where("bucket is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found.append(stored(verified(pairs, texts, threshold)))
    crowded = sifted.where("bucket is not null").select("bucket").distinct()
    if not crowded.isEmpty():
        full = rest.join(crowded, "bucket", "left_semi").withColumn("unit", F.col("bucket")).join(texts.withColumnRenamed("id", "rep"), "rep")
        found.append(stored(full.groupBy("unit").applyInArrow(_crowd(id_type, threshold), f"a {name}, b {name}")))
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, class_id``: a row for each row of docs; class_id is the least id of the class, null for a null id."""
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    if repeated.isEmpty():
        return _classes(docs, threshold, id_col, text)
    # an id with several texts ties their classes; rows are numbered once, in a table that is written
    rows = stored(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")))
    classes = _classes(rows, threshold, "row", "text").withColumnRenamed("id", "row")
    of = stored(rows.select("id", "row").join(classes, "row"))
    first = of.groupBy("id").agg(F.min("class_id").alias("a"))
    tied = components(of.join(first, "id").select("a", F.col("class_id").alias("b")).distinct())
    top = of.join(tied.withColumnRenamed("id", "class_id"), "class_id", "left").select("id", F.coalesce("root", "class_id").alias("root"))
    least = top.groupBy("root").agg(F.min("id").alias("class_id"))
    whole = top.join(least, "root").select("id", "class_id").distinct()
    return docs.select(F.col(id_col).alias("id")).join(whole, "id", "left").select("id", "class_id")


def _classes(docs: DataFrame, threshold: float, id_col: str, text: str) -> DataFrame:
    """The same, of docs whose ids don't repeat."""
    rows = stored(signed(docs, id_col, text))
    unique = rows.groupBy("key").agg(F.min("id").alias("rep"), F.min_by(F.struct("bands", "bytes"), "id").alias("sign"))
    unique = stored(unique.select("key", "rep", "sign.*"))
    copies = rows.select("id", "key").join(unique.select("key", "rep"), "key").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    met = unique.select("rep", F.explode("bands").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("one"), F.min_by("rep", F.xxhash64("rep")).alias("two")).where("n > 1").drop("n")
    met = stored(met.join(shared, "bucket").select("bucket", "rep", "one", "two"))
    wanted = met.select(F.col("rep").alias("id")).distinct()
    texts = stored(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi"))
    pairs = met.select(F.explode(F.array_distinct(F.array("one", "two"))).alias("leader"), "rep").where("leader <> rep").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()
    links = stored(verified(alike(pairs, unique), texts, threshold))
    roots = components(links).withColumnRenamed("id", "rep")
    placed = stored(met.select("bucket", "rep").join(roots, "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root")))
    links = links.unionByName(across_classes(placed, links, unique, texts, threshold))
    whole = components(links.unionByName(copies))
    own = docs.select(F.col(id_col).alias("id"))
    return own.join(whole, "id", "left").select("id", F.coalesce("root", "id").alias("class_id"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id")

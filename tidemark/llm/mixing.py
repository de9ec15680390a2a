"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

Sources in code-point order (null last) get weights in turn and share the size of the whole. A source's target stops at
``cap`` times its size, and what is above goes to the others by weight. Each document of a source is due the same number
of copies, target / size: the whole part is taken outright, the fraction is rounded.

Fractions are rounded in pairs. Words of probability mass move from one document to the other, in a direction drawn so
that both keep their expected copies, until one of them is taken or left; the other goes on with what is left, so the
words that a source is due never change on the way. Pairs are folded within groups of about GROUP documents of a source,
the group's one unsettled document goes to the next level, and so on up a tree of groups until each source has one left,
which is drawn alone. A source's taken words differ from its target by less than one document.

Draws are hashes of the ids and the seed, so reruns agree. Defined cases: a null or empty text has size 0 and is never
drawn; a source of size 0 has target 0; a null source is a source; repeated rows are drawn each for itself; an empty
table gives no rows. Sources are ranked in one task, from one row a source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import documents, steady, stored

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20
#: Documents folded together, and sources that may be broadcast; more are joined by a shuffle.
GROUP = 256
#: Bits of a row's place within a block of equal rows.
BLOCK_BITS = 16
BROADCAST_SOURCES = 10_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size`` with ``target``: least(cap * size, level * weight), level so that targets sum to all sizes.

    Going up in cap * size / weight, a source is capped as long as the level that the rest would have is above its own
    ratio; that level rises up to the first source that isn't capped and falls from there, so it is the largest of them.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))) + 1)
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    full = F.lit(cap) * F.col("source_size")
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    return (
        sources.withColumn("weight", weight)
        .withColumn("ratio", full / F.col("weight"))
        .withColumn("level", level)
        .withColumn("target", F.least(full.cast("double"), F.max("level").over(everything) * F.col("weight")))
        .drop("weight", "ratio", "level")
    )


def _fold(units: str, unit_type: str, seed: int, level: int) -> str:
    """SQL: the units of a group, folded in pairs, as struct(carry, out): the unsettled one, and (id, n, size, bit) of the others."""

    def unit(x: str, p: str) -> str:
        return f"named_struct('id', {x}.id, 'n', {x}.n, 'size', {x}.size, 'p', greatest(0D, least(1D, {p})))"

    def step(settled: str, bit: int, other: str, p: str) -> str:
        return f"named_struct('carry', {unit(other, p)}, 'out', array_append(acc.out, named_struct('id', {settled}.id, 'n', {settled}.n, 'size', {settled}.size, 'bit', {bit})))"

    i, j = "acc.carry", "x"
    gain, lose = f"least({i}.size * (1 - {i}.p), {j}.size * {j}.p)", f"least({i}.size * {i}.p, {j}.size * (1 - {j}.p))"
    draw = f"shiftrightunsigned(xxhash64({seed}, {level}, {i}.id, {i}.n, {j}.id, {j}.n), 11) * {2.0**-53!r}D"
    return f"""aggregate({units},
        named_struct('carry', cast(null as {unit_type}), 'out', cast(array() as array<{unit_type.replace("p:double", "bit:int")}>)),
        (acc, x) -> case when acc.carry is null then named_struct('carry', x, 'out', acc.out) else
            element_at(transform(array(named_struct('gain', {gain}, 'lose', {lose}, 'draw', {draw})), m -> case
                when m.draw * (m.gain + m.lose) < m.lose then case
                    when {i}.size * (1 - {i}.p) <= {j}.size * {j}.p then {step(i, 1, j, f"{j}.p - m.gain / {j}.size")}
                    else {step(j, 0, i, f"{i}.p + m.gain / {i}.size")} end
                when {i}.size * {i}.p <= {j}.size * (1 - {j}.p) then {step(i, 0, j, f"{j}.p + m.lose / {j}.size")}
                else {step(j, 1, i, f"{i}.p - m.lose / {i}.size")} end), 1) end)"""


def numbered(rows: DataFrame, keys: list[str], place: str, name: str) -> DataFrame:
    """Rows with ``name``, 1, 2, ... among those of equal keys; ``place`` tells all rows apart.

    Equal rows are numbered in blocks of their places and the counts of the blocks before are added, so that very many of
    them aren't one task's.
    """
    block, before, own = f"{name}_block", f"{name}_before", [f"{name}_key{i}" for i in range(len(keys))]
    rows = rows.withColumn(block, F.shiftright(place, BLOCK_BITS))
    counts = rows.groupBy(*keys, block).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0))).where(F.col(before) > 0).toDF(*own, f"{block}_", before)
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip([*keys, block], [*own, f"{block}_"], strict=True)])
    nth = F.row_number().over(Window.partitionBy(*keys, block).orderBy(place)) + F.coalesce(before, F.lit(0))
    return rows.join(counts, on, "left").withColumn(name, nth.cast("int")).drop(block, before, f"{block}_", *own)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row a document: ``id, key, source, size, source_size, target, copies, taken``; key is a hash of source and text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sized = stored(docs.select(F.col(id_col).alias("id"), F.xxhash64(source, text).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"), F.monotonically_increasing_id().alias("place")))
    sources = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("members")), weights, cap))
    sized = numbered(sized, ["id", "key"], "place", "n").drop("place")
    due = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    sources = sources.withColumn("base", F.floor(due).cast("int")).withColumn("p", due - F.col("base")).withColumn("groups", F.ceil(F.col("members") / GROUP))
    bounds = sources.agg(F.count(F.lit(1)).alias("sources"), F.max("groups").alias("groups")).first()
    # every source of ``sized`` is in ``sources``
    side = F.broadcast(sources) if bounds["sources"] <= BROADCAST_SOURCES else sources
    rows = sized.alias("d").join(side.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).drop(F.col("s.source"))
    open_, keys = (F.col("size") > 0) & (F.col("p") > 0), ["source", "source_size", "target", "base"]
    settled = [rows.where(~open_).select("id", "key", *keys, "size", F.lit(0).alias("bit"))]
    unit_type = f"struct<id:struct<id:{id_type},key:bigint>,n:int,size:double,p:double>"
    level, groups = 0, bounds["groups"] or 1
    units = rows.where(open_).select(*keys, F.pmod(F.xxhash64("id", "key", "n", F.lit(seed)), "groups").alias("gid"), F.struct(F.struct("id", "key").alias("id"), "n", F.col("size").cast("double").alias("size"), "p").alias("unit"))
    while True:
        # large documents first: the small ones that follow settle them
        ordered = F.sort_array(F.collect_list(F.struct((-F.col("unit.size")).alias("down"), F.xxhash64("unit.id", "unit.n", F.lit(seed)).alias("tie"), F.col("unit").alias("unit"))))
        folded = units.groupBy(*keys, "gid").agg(ordered.alias("units")).withColumn("done", F.expr(_fold("transform(units, y -> y.unit)", unit_type, seed, level))).select(*keys, "gid", "done")
        folded = stored(folded)
        settled.append(folded.select(*keys, F.explode("done.out").alias("o")).select("o.id.id", "o.id.key", *keys, F.col("o.size").cast("long").alias("size"), F.col("o.bit").alias("bit")))
        units = folded.select(*keys, F.floor(F.col("gid") / GROUP).alias("gid"), F.col("done.carry").alias("unit"))
        if groups <= 1:
            break
        level, groups = level + 1, -(-groups // GROUP)
    last = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("unit.id")), 11) * 2.0**-53 < F.col("unit.p")
    settled.append(units.select("unit.id.id", "unit.id.key", *keys, F.col("unit.size").cast("long").alias("size"), last.cast("int").alias("bit")))
    copies = F.least(F.col("base") + F.col("bit"), F.lit(cap))
    return reduce(DataFrame.unionByName, settled).select("id", "key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: each row of docs as many times as it has copies, columns as they are."""
    mixed = mix_sources(docs, id_col=id_col, source=source, text=text, **options)
    # equal rows differ by one copy at most: how many the least have, and how many have one more
    least = mixed.groupBy(F.col("id").alias("_td_id"), F.col("key").alias("_td_key")).agg(F.min("copies").alias("_td_least"), F.max("copies").alias("_td_most"), F.sum("copies").alias("_td_sum"), F.count(F.lit(1)).alias("_td_rows"))
    copies = stored(least.withColumn("_td_more", F.col("_td_sum") - F.col("_td_least") * F.col("_td_rows")).where("_td_most > 0").select("_td_id", "_td_key", "_td_least", "_td_more"))
    keyed = steady(docs).withColumns({"_td_own": F.xxhash64(source, text), "_td_place": F.monotonically_increasing_id()})
    joined = keyed.join(copies, F.col(id_col).eqNullSafe(F.col("_td_id")) & (F.col("_td_own") == F.col("_td_key")))
    taken = joined.where("_td_more = 0").withColumn("_td_n", F.col("_td_least"))
    if not copies.where("_td_more > 0").isEmpty():
        some = numbered(joined.where("_td_more > 0"), ["_td_id", "_td_key"], "_td_place", "_td_nth")
        some = some.withColumn("_td_n", F.col("_td_least") + (F.col("_td_nth") <= F.col("_td_more")).cast("int")).drop("_td_nth")
        taken = taken.unionByName(some)
    taken = taken.where("_td_n > 0")
    return taken.withColumn("_td_n", F.explode(F.sequence(F.lit(1), F.col("_td_n")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of it: sizes and targets."""
    return mix_sources(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 3).alias("target"))


OP10_SQL = r"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
total as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::integer] as weight from total),
level as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by 3 * source_size / weight, source nulls last rows between current row and unbounded following) as level from ranked),
target as (select source, source_size, least(3.0::double * source_size, max(level) over () * weight) as target from level)
select s.doc_id, s.size, t.source_size, round(t.target, 3) as target
from sized s join target t on s.source is not distinct from t.source
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")

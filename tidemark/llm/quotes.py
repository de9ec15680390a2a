"""Quotation linking for conversations.

A line's quote level is the number of ``>`` marks in front of it. Quoted lines are normalised (marks and outer white space
off, inner white space to one space, lower case) and hashed; a quoted line comes from the last earlier message of the
same conversation that has the same line as its own text. A line without one is looked for by its passage, so that quotes
wrapped anew and quoted parts of a line are found too: consecutive lines of one level are joined to a passage, and its
windows of WINDOW words (the passage, if it is shorter) looked up among those of own passages, each from the last earlier
message that has it. The line comes from the message that most windows touching it come from, the later one of a tie, if
at least half of them come from anywhere; else, if shorter than a window, from the last message that says it within a line.

A message replies to the message that most of its lines of the lowest linked level come from, the later one of a tie;
without a link, to the message one turn before; else to none. Its own text is what remains without quoted lines and
without the line that announces them (``... wrote:``).

Lines and windows are matched by ordered passes over a conversation's equal ones, not by pairs; what nobody quotes is left
out of it before, and windows are made only of conversations with a line that is not found whole. Conversations without a
quote mark are not taken apart at all.

Defined cases: a null text counts as empty; a message without quotes keeps its text as it is; a null conv_id or turn takes
no part in linking and has no reply_to; repeated rows are kept and share their result; of messages that share conversation
and turn, reply_to names the turn; extra columns are not read. Conversations are assembled in parts of PART places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import map_batches, stored

#: Turns of a part of an assembled conversation, of a block of equal lines, and of a conversation that a task orders.
PART, BLOCK, LONGEST = 200, 1000, 100_000
WINDOW = 4
MARKS = r"^(?:[ \t]*>)+"
ANNOUNCES = r"(?i)^.{0,200}\b(wrote|writes|said)\s*:\s*$"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normal(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"^\s+|\s+$", "")), r"\s+", " "))


def lines(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, text, place, line, level, hash`` of each line."""
    split = messages.select("conv_id", "turn", "text", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line"))
    return split.withColumn("level", level(F.col("line"))).withColumn("norm", normal(F.col("line"))).withColumn("hash", F.when(F.col("norm") != "", F.xxhash64("norm"))).drop("norm")


def own_text(text: str) -> Column:
    """The text without quoted lines, the lines that announce them, and outer blank lines; unchanged without quotes."""
    parts = F.split(F.col(text), "\n")

    def stays(line: Column, i: Column) -> Column:
        after = F.coalesce(F.get(parts, i + 1), F.lit(""))
        return ~line.rlike(MARKS) & ~(line.rlike(ANNOUNCES) & after.rlike(MARKS))

    cut = F.regexp_replace(F.array_join(F.filter(parts, stays), "\n"), r"^\s*\n|\s+$", "")
    return F.when(F.exists(parts, lambda line: line.rlike(MARKS)), cut).otherwise(F.coalesce(F.col(text), F.lit("")))


def _window(words: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "big", signed=True)


def _passages(found: list[dict]) -> Iterator[tuple[int, list[dict], list[str], list[int]]]:
    """(level, lines, words, each word's line in lines) of each run of consecutive lines of one level."""
    for depth, run in groupby(found, key=lambda line: line["level"]):
        run = list(run)
        words = [(word, i) for i, line in enumerate(run) for word in line["norm"].split(" ") if word]
        yield depth, run, [w for w, _ in words], [i for _, i in words]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of quoted passages, once for each line without a source that they touch."""
    for batch in batches:
        for message in batch.to_pylist():
            missing, rows = set(message["missing"]), []
            for depth, run, words, where in _passages(message["lines"]):
                if not depth or not words:
                    continue
                size = min(WINDOW, len(words))
                for at in range(len(words) - size + 1):
                    hashed = _window(words[at : at + size])
                    rows += [(run[i], depth, False, size, hashed) for i in set(where[at : at + size]) if run[i]["hash"] in missing]
                for line in run:
                    alone = line["norm"].split(" ")
                    if line["norm"] and line["hash"] in missing and len(alone) < size:
                        rows.append((line, depth, True, len(alone), _window(alone)))
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": message["conv_id"], "turn": message["turn"], "m": message["m"], "place": line["place"], "level": depth, "alone": alone, "size": size, "window": hashed} for line, depth, alone, size, hashed in rows],
                _ASKED,
            )


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct windows of the sizes asked for of a message's own passages."""
    for batch in batches:
        for message in batch.to_pylist():
            own = [words for depth, _, words, _ in _passages(message["lines"]) if not depth]
            for size in message["sizes"]:
                hashes = {_window(words[at : at + size]) for words in own for at in range(len(words) - size + 1)}
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array([message[c]] * n, t) for c, t in (("conv_id", pa.int64()), ("turn", pa.int64()))] + [pa.array([size] * n, pa.int32()), pa.array(list(hashes), pa.int64())], schema=_SAID)


_SAID = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("size", pa.int32()), ("window", pa.int64())])
_ASKED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("m", pa.int64()), ("place", pa.int32()), ("level", pa.int32()), ("alone", pa.bool_()), ("size", pa.int32()), ("window", pa.int64())])


def _last_said(asked: DataFrame, said: DataFrame, keys: list[str]) -> DataFrame:
    """The rows asked with ``source``, the last turn before theirs at which the same keys are said, or null.

    Equal lines of a conversation are walked in blocks of turns, and the last turn of the blocks before is added, so a line
    that a long conversation has in every message isn't one task's.
    """
    # at one turn what is said comes after what is quoted, so that a message doesn't quote itself
    both = asked.withColumn("says", F.lit(0)).unionByName(said.withColumn("says", F.lit(1)), True).withColumn("block", F.floor(F.col("turn") / BLOCK))
    turn = F.when(F.col("says") == 1, F.col("turn"))
    within = Window.partitionBy(*keys, "block").orderBy("turn", "says").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*keys, "block").agg(F.max(turn).alias("end"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("earlier", F.last("end", True).over(before)).drop("end")
    found = both.withColumn("inside", F.last(turn, True).over(within)).where("says = 0").join(ends, [*keys, "block"])
    return found.withColumn("source", F.coalesce("inside", "earlier")).drop("says", "block", "inside", "earlier")


def link_passages(messages: DataFrame, missing: DataFrame) -> DataFrame:
    """``conv_id, turn, source, n, level`` of each quoted line of ``missing`` (conv_id, turn, hash) whose passage is found."""
    line = F.split(F.coalesce("text", F.lit("")), "\n")
    parts = F.transform(line, lambda x, i: F.struct(i.alias("place"), level(x).alias("level"), normal(x).alias("norm"), F.xxhash64(normal(x)).alias("hash")))
    each = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.xxhash64("text").alias("m"), parts.alias("lines"))
    of = missing.groupBy("conv_id", "turn").agg(F.collect_set("hash").alias("missing"))
    types = "conv_id long, turn long, m long, place int, level int, alone boolean, size int, window long"
    asked = stored(map_batches(each.join(of, ["conv_id", "turn"]), _asked, types))
    sizes = asked.groupBy("conv_id").agg(F.collect_set("size").alias("sizes"))
    keys = ["conv_id", "size", "window"]
    said = map_batches(each.join(sizes, "conv_id"), _said, "conv_id long, turn long, size int, window long")
    found = _last_said(asked, said.join(asked.select(*keys).distinct(), keys, "left_semi"), keys)
    line = ["conv_id", "turn", "m", "place", "level"]
    by = found.groupBy(*line, "alone", "source").agg(F.count(F.lit(1)).alias("k"))
    by = by.groupBy(*line, "alone").agg(F.sum("k").alias("all"), F.sum(F.when(F.col("source").isNotNull(), F.col("k"))).alias("hit"), F.max_by("source", F.when(F.col("source").isNotNull(), F.struct("k", "source"))).alias("source"))
    return by.where("2 * hit >= all").groupBy(*line).agg(F.max_by("source", ~F.col("alone")).alias("source")).select("conv_id", "turn", "source", F.lit(1).cast("long").alias("n"), "level")


def link_quotes(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, source, lines, level``: how many quoted lines of a message come from the message at turn ``source``."""
    known = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", "text")
    # conversations without a quote mark have nothing to link
    quoting = known.where(F.col("text").rlike(r"(^|\n)[ \t]*>")).select("conv_id").distinct()
    known = known.join(quoting, "conv_id", "left_semi").distinct()
    each = stored(lines(known).where("hash is not null").drop("text", "line"))
    quoted = each.where("level > 0").groupBy("conv_id", "turn", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("level"))
    asked = quoted.select("conv_id", "hash").distinct()
    said = each.where("level = 0").select("conv_id", "turn", "hash").distinct().join(asked, ["conv_id", "hash"], "left_semi")
    found = stored(_last_said(quoted, said, ["conv_id", "hash"]))
    links, missing = found.where("source is not null"), found.where("source is null").select("conv_id", "turn", "hash")
    if not missing.isEmpty():
        links = links.select("conv_id", "turn", "source", "n", "level").unionByName(link_passages(known, missing))
    return links.groupBy("conv_id", "turn", "source").agg(F.sum("n").alias("lines"), F.min("level").alias("level"))


def link_conversations(messages: DataFrame) -> DataFrame:
    """A row a message: ``conv_id, turn, role, reply_to, n_quoted, n_linked, text`` without quotes; order by conv_id, turn."""
    links = link_quotes(messages)
    parent = links.groupBy("conv_id", "turn").agg(F.sum("lines").alias("n_linked"), F.max_by("source", F.struct(-F.col("level"), "lines", "source")).alias("parent"))
    there = messages.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before")).where("conv_id is not null and before is not null").distinct()
    quoted = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: line.rlike(MARKS))).cast("long")
    rows = messages.select("conv_id", "turn", "role", "text").join(parent, ["conv_id", "turn"], "left").join(there, ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", "role", F.coalesce("parent", "before").alias("reply_to"), quoted.alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), own_text("text").alias("text"))


def _threads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for conversation in batch.to_pylist():
            answers = {}
            for turn, to in sorted((m["turn"], m["reply_to"]) for m in conversation["turns"] if m["reply_to"] is not None):
                answers.setdefault(to, []).append(turn)
            ahead, order = sorted((m["turn"] for m in conversation["turns"] if m["reply_to"] is None), reverse=True), []
            while ahead:
                order.append(ahead.pop())
                ahead += reversed(answers.get(order[-1], []))
            n = len(order)
            yield pa.RecordBatch.from_arrays([pa.array([conversation["conv_id"]] * n, pa.int64()), pa.array(order, pa.int64()), pa.array(range(n), pa.int64())], names=["conv_id", "turn", "place"])


def long_threads(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, place`` of conversations of any length, by joins alone.

    A walk around each tree of replies goes into a message, through its replies and out of it again; each step's follower is
    known from the message's neighbours. Followers' followers are looked up until all walks have ended, which doubles the
    steps each time, and a message's place is the number of messages that the walk has still to go into, from the end.
    """
    siblings = Window.partitionBy("conv_id", "reply_to").orderBy("turn")
    known = turns.withColumn("next", F.lead("turn").over(siblings))
    first = turns.where("reply_to is not null").groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    known = stored(known.join(first, ["conv_id", "turn"], "left"))
    into = known.select("conv_id", "turn", F.lit(False).alias("out"), F.coalesce("child", "turn").alias("to"), F.col("child").isNull().alias("to_out"), F.lit(1).cast("long").alias("ahead"))
    out = known.select("conv_id", "turn", F.lit(True).alias("out"), F.coalesce("next", "reply_to").alias("to"), F.col("next").isNull().alias("to_out"), F.lit(0).cast("long").alias("ahead"))
    steps = stored(into.unionByName(out))
    while not steps.where("to is not null").isEmpty():
        further = steps.select("conv_id", F.col("turn").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("then"), F.col("to_out").alias("then_out"), F.col("ahead").alias("more"))
        steps = steps.join(further, ["conv_id", "to", "to_out"], "left")
        steps = stored(steps.select("conv_id", "turn", "out", F.col("then").alias("to"), F.coalesce("then_out", "to_out").alias("to_out"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead")))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    return steps.where("not out").join(sizes, "conv_id").select("conv_id", "turn", (F.col("size") - F.col("ahead")).alias("place"))


def reply_order(linked: DataFrame) -> DataFrame:
    """Each message with ``place``, from 0, in its conversation's reply order: after a message what replies to it, with all
    replies to that, before the next of the same parent; by turn among the replies to one message.

    Messages of one turn share a place; without conversation or turn it is null. A task holds the turns, not the texts, of
    conversations of up to LONGEST turns; longer ones are placed by joins.
    """
    turns = stored(linked.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("reply_to").cast("long")).distinct())
    long_ = stored(turns.groupBy("conv_id").count().where(F.col("count") > LONGEST).select("conv_id"))
    short = turns.join(long_, "conv_id", "left_anti")
    places = map_batches(short.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "reply_to")).alias("turns")), _threads, "conv_id long, turn long, place long")
    if not long_.isEmpty():
        places = places.unionByName(long_threads(turns.join(long_, "conv_id", "left_semi")))
    return linked.join(places, ["conv_id", "turn"], "left").select("conv_id", "place", "turn", "role", "reply_to", "text")


def assembled(ordered: DataFrame, part: int = PART) -> DataFrame:
    """``conv_id, part, messages``: the rows of reply_order() as arrays of up to ``part`` places; those without a place left out."""
    message = F.struct("place", "turn", "role", "reply_to", "text")
    placed = ordered.where("place is not null").distinct()
    return placed.groupBy("conv_id", F.floor(F.col("place") / part).alias("part")).agg(F.sort_array(F.collect_list(message)).alias("messages"))


def mailed(messages: DataFrame) -> DataFrame:
    """Messages as a mail client would send them: on top of each the lines of the message two turns before, quoted."""
    old = messages.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("old"))
    quoted = F.concat(F.lit("On that day they wrote:\n> "), F.regexp_replace("old", "\n", "\n> "), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return messages.join(old, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.coalesce(quoted, "text").alias("text"))


def op6_reply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(op6_quotation_links(spark, sf_dir))


def op6_mailed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that quotes give, on the same conversations with quotes put in front of the messages."""
    return link_conversations(mailed(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op6_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same in DuckDB's SQL.
OP6_SQL = r"""
with msg as (select distinct conv_id, turn, text from conversations where conv_id is not null and turn is not null),
split as (
  select conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) as line from msg),
line as (
  select conv_id, turn, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) as level,
    lower(regexp_replace(regexp_replace(regexp_replace(line, '^(?:[ \t]*>)+', ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) as norm
  from split),
each as (select * from line where norm <> ''),
quoted as (select conv_id, turn, norm, count(*) as n, min(level) as level from each where level > 0 group by all),
found as (
  select q.conv_id, q.turn, q.n, q.level, max(s.turn) as source
  from quoted q join (select distinct conv_id, turn, norm from each where level = 0) s
    on q.conv_id = s.conv_id and q.norm = s.norm and s.turn < q.turn
  group by q.conv_id, q.turn, q.norm, q.n, q.level),
links as (select conv_id, turn, source, sum(n) as n, min(level) as level from found group by conv_id, turn, source),
parent as (
  select conv_id, turn, sum(n)::bigint as n_linked, first(source order by level, n desc, source desc) as parent
  from links group by conv_id, turn),
own as (
  select *, string_split(coalesce(text, ''), chr(10)) as parts from conversations)
select m.conv_id, m.turn, m.role, coalesce(p.parent, b.turn) as reply_to,
  len(list_filter(m.parts, lambda x: regexp_matches(x, '^(?:[ \t]*>)+'))) as n_quoted,
  coalesce(p.n_linked, 0)::bigint as n_linked,
  case when len(list_filter(m.parts, lambda x: regexp_matches(x, '^(?:[ \t]*>)+'))) = 0 then coalesce(m.text, '')
    else regexp_replace(array_to_string(list_filter(m.parts, lambda x, i: not regexp_matches(x, '^(?:[ \t]*>)+')
      and not (regexp_matches(x, '(?i)^.{0,200}\b(wrote|writes|said)\s*:\s*$') and regexp_matches(coalesce(m.parts[i + 1], ''), '^(?:[ \t]*>)+'))), chr(10)),
      '^\s*\n|\s+$', '', 'g') end as text
from own m
left join parent p on m.conv_id = p.conv_id and m.turn = p.turn
left join (select distinct conv_id, turn from conversations) b on m.conv_id = b.conv_id and m.turn = b.turn + 1
"""

OP6_ORDER_SQL = f"""
with recursive linked as ({OP6_SQL}),
step as (select distinct conv_id, turn, reply_to from linked where conv_id is not null and turn is not null),
thread as (
  select conv_id, turn, [turn] as path from step where reply_to is null
  union all
  select s.conv_id, s.turn, list_append(t.path, s.turn) from step s join thread t on s.conv_id = t.conv_id and s.reply_to = t.turn),
placed as (select conv_id, turn, row_number() over (partition by conv_id order by path) - 1 as place from thread)
select l.conv_id, p.place, l.turn, l.role, l.reply_to, l.text
from linked l left join placed p on l.conv_id = p.conv_id and l.turn = p.turn
"""

OP6_MAILED_SQL = """
with mail as (
  select m.conv_id, m.turn, m.role, case when o.text is null then m.text
    else 'On that day they wrote:' || chr(10) || '> ' || replace(o.text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || coalesce(m.text, '') end as text
  from conversations m left join conversations o on m.conv_id = o.conv_id and m.turn = o.turn + 2),
""" + OP6_SQL.strip().removeprefix("with ").replace("conversations", "mail")

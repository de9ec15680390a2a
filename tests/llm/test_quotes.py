import random
from collections import Counter

import duckdb
import pytest

from tests.llm.helpers import rows_of
from tidemark.llm import quotes
from tidemark.llm.quotes import OP6_ORDER_SQL, OP6_SQL, assembled, link_conversations, link_quotes, mailed, op6_reply_order, reply_order

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "Hello there\nHow is  it?"),
    (1, 1, "assistant", "On Monday user wrote:\n> Hello there\n\nHi!"),
    (1, 2, "user", "> > hello   there\n> Hi!\nBye"),
    (1, 3, "user", "> How is it?\n>> nothing\nfine > ok"),
    (1, 4, "x", None),
    (1, 4, None, ""),
    (2, 0, "user", "> x"),
    (2, 2, "u", "y"),
    (None, 1, "u", "> z"),
    (3, None, "u", "> z\nq"),
    (1, 2, "user", "> > hello   there\n> Hi!\nBye"),
    (4, 0, "u", "a\na"),
    (4, 1, "u", "a"),
    (4, 2, "u", ">a\n>a\nb\n"),
    (4, 3, "u", "> b\n> a\n> a\nsaid:\n\nc"),
    (5, 0, "u", "w " * 20_000 + "\nend"),
    (5, 1, "u", "> " + "w " * 20_000 + "\nreply"),
]


@pytest.fixture
def messages(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_same_as_sql(messages):
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", ROWS)
    want = con.sql(OP6_SQL)
    assert rows_of(link_conversations(messages), *want.columns) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_blocks_of_turns(messages, spark, monkeypatch, block):
    """The last earlier turn that says a line, over any blocks."""
    monkeypatch.setattr(quotes, "BLOCK", block)
    rng = random.Random(block)
    said = [["".join(rng.choice("abc")) for _ in range(rng.randint(0, 3))] for _ in range(30)]
    asked = [["".join(rng.choice("abcd")) for _ in range(rng.randint(0, 2))] for _ in range(30)]
    rows = [(7, t, "u", "\n".join([*(f"> {x}" for x in asked[t]), *said[t]])) for t in range(30)]
    want = Counter()
    for t, lines in enumerate(asked):
        for line in lines:
            earlier = [u for u in range(t) if line in said[u]]
            if earlier:
                want[7, t, earlier[-1]] += 1
    got = {(r.conv_id, r.turn, r.source): r.lines for r in link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_mailed_replies_link_to_what_they_quote(spark):
    rows = [(c, t, "u", f"talk {c} about {t}\nand more {t * 7} of it") for c in range(3) for t in range(9)]
    got = link_conversations(mailed(spark.createDataFrame(rows, SCHEMA))).collect()
    assert all((r.reply_to, r.n_linked, r.text) == (r.turn - 2, 2, rows[r.conv_id * 9 + r.turn][3]) for r in got if r.turn >= 2) and len(got) == 27


def test_links_and_texts(messages):
    by = {(r.conv_id, r.turn): r for r in link_conversations(messages.dropDuplicates(["conv_id", "turn"])).collect()}
    assert (by[1, 1].reply_to, by[1, 1].text) == (0, "Hi!")
    assert (by[1, 2].reply_to, by[1, 2].n_linked, by[1, 2].text) == (1, 2, "Bye")
    assert (by[1, 3].reply_to, by[1, 3].n_quoted, by[1, 3].n_linked, by[1, 3].text) == (0, 2, 1, "fine > ok")
    assert by[1, 4].reply_to == 3 and by[2, 0].reply_to is None and by[2, 2].reply_to is None
    assert by[4, 2].reply_to == 1  # the last earlier message with the line
    assert by[5, 1].reply_to == 0 and by[5, 1].text == "reply"


def test_a_message_does_not_quote_itself_or_later_ones(spark):
    rows = [(1, 0, "u", "> later\nsame\n> same"), (1, 1, "u", "later")]
    assert link_quotes(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_a_quote_wrapped_anew_and_part_of_a_line(spark):
    long_ = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, 0, "a", "aaa bbb ccc ddd"),
        (1, 1, "b", "something else"),
        (1, 2, "a", "> aaa bbb\n> ccc ddd\nyes"),
        (2, 0, "a", f"hi\n{long_}\nbye"),
        (2, 1, "b", "no"),
        (2, 2, "a", "\n".join(f"> > {' '.join(long_.split()[i : i + 7])}" for i in range(3, 50, 7)) + "\n> no\nfine"),
        (2, 3, "b", "> word20 word21  WORD22\nwhat?"),
        (2, 4, "b", "> never said before by anyone\n> word21 word20\nwhat?"),
        (3, 0, "a", "one two three"),
        (3, 1, "b", "four five six"),
        (3, 2, "c", "x"),
        (3, 3, "a", "> two three\n> four five\n> five six"),
        (4, 0, "a", "> a b c\nwrap this long\nline again"),
        (4, 1, "b", "none"),
        (4, 2, "a", "> wrap this\n> long line\n> again\n\nok"),
        (5, 0, "u", "> p q r s\nmine\n> late words"),
        (5, 1, "u", "first p q r s said late words"),
    ]
    by = {(r.conv_id, r.turn): (r.reply_to, r.n_quoted, r.n_linked) for r in link_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert by[1, 2] == (0, 2, 2)
    assert by[2, 2] == (1, 8, 8)  # the lowest level decides
    assert by[2, 3] == (0, 1, 1) and by[2, 4] == (3, 2, 0)
    assert by[3, 3] == (1, 3, 3)
    assert by[4, 2] == (0, 3, 3)
    assert by[5, 0] == (None, 2, 0)  # neither its own nor a later text


def test_assembled_in_reply_order(messages):
    parts = assembled(reply_order(link_conversations(messages)), part=3).where("conv_id = 1").orderBy("part").collect()
    assert [[m.turn for m in p.messages] for p in parts] == [[0, 1, 2], [3, 4, 4]]
    for p in parts:
        assert all(m.reply_to is None or m.reply_to < m.turn for m in p.messages)


def test_registered_reply_order(spark, tmp_path, monkeypatch):
    # 3 answers 0 and 5 answers 1, over more turns than a part has
    rows = [(9, i, "u", f"text {i}") for i in range(450)]
    rows[3], rows[5] = (9, 3, "u", "> text 0\nmine"), (9, 5, "u", "> text 1\nyours")
    rows += ROWS
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op6_reply_order(spark, str(tmp_path))
    order = [(r.turn, r.text) for r in got.where("conv_id = 9").orderBy("place").collect()]
    assert [t for t, _ in order] == [0, 1, 2, *range(5, 450), 3, 4] and order[3][1] == "yours"
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.sql(OP6_ORDER_SQL)
    expected = sorted(want.fetchall(), key=repr)
    assert rows_of(got, *want.columns) == expected
    monkeypatch.setattr(quotes, "LONGEST", 3)
    assert rows_of(op6_reply_order(spark, str(tmp_path)), *want.columns) == expected


def test_extra_columns_and_empty_table(messages):
    from pyspark.sql import functions as F

    wide = messages.withColumns({n: F.lit(9) for n in ("level", "hash", "line", "source", "n", "place", "before", "parent")})
    assert rows_of(link_conversations(wide), "conv_id", "turn", "text") == rows_of(link_conversations(messages), "conv_id", "turn", "text")
    assert link_conversations(messages.limit(0)).count() == 0

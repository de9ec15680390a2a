"""Documents that have every odd case, and brute-force counterparts."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def word(n, first="w"):
    """A word of letters for each number."""
    return first + "".join(chr(97 + n // 26**k % 26) for k in range(5 if n >= 26**3 else 3))


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    vocabulary = [word(i) for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + "." * (i % 9 == 8) for i in range(n))

    base, passage, long_ = prose(120), prose(60), prose(6000)
    rows = [
        (1, base, "en", "b", len(base)),
        (2, base, "en", "a", len(base)),
        (3, base.replace(f"{base.split()[60]} ", "x "), "en", None, 5),
        (4, f"{prose(40)} {passage} {prose(40)}", None, "a", None),
        (5, f"{prose(90)}\n{passage}\t{prose(9)}", "en", "a", 9),
        (6, None, None, None, None),
        (7, "", "en", "a", 0),
        (8, " \n\t ", "en", "b", 4),
        (9, "one", "en", "b", 3),
        (10, "one two three", "en", "b", 13),
        (11, "one two three", "en", "c", 13),
        (12, long_, "en", "c", len(long_)),
        (13, "z" * 50_000, "en", "c", 50_000),
        (14, "same line here\n" * 40, "en", "c", 600),
        (15, "ab#$ " * 80, "en", "c", 400),
        (16, "ünïcödé 日本語 😀 " * 30, "xx", "é", 400),
        (17, prose(200), "en", "a", 1),
        (17, prose(200), "en", "a", 1),
        (None, prose(80), "en", "a", 1),
        (18, f"{prose(30)} {base}", "en", "b", 7),
    ]
    return [*rows, rows[4], rows[4]]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def clashing(docs):
    """Extra columns, some named like columns that operators add."""
    from pyspark.sql import functions as F

    names = ("n_words", "kept", "score", "ids", "decoded", "media", "payload", "kept_text", "size", "target", "key", "bands", "root", "id", "n")
    return docs.withColumns({n: F.lit(f"mine {n}") for n in names}).withColumn("extra", F.array(F.lit(1)))


def empty(docs):
    return docs.limit(0)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

"""Quality rules as weak supervision.

Each rule looks at one statistic of a text and votes good in a usual range, bad beyond wider bounds, and abstains between.
Expectation-maximisation over the vote patterns of the whole corpus estimates the share of good texts and, for each rule,
how often it says good of good texts and bad of bad texts when it votes; an abstention tells nothing, and votes are taken
as independent given the class. A text is kept if the posterior probability that it is good is at least one half, so a
rule that often says bad of texts that all others find good loses its weight, and one that speaks up where others do gains.

The estimate starts from beliefs that also count as ``BELIEF`` votes a rule (and texts, for the share), whatever the size
of the corpus: good texts rarely get a bad vote, bad ones get some. That is what tells the classes apart by name; apart
from it nothing bounds what the corpus says. There are at most 3 ** 12 patterns, so the driver gets 531,441 counts at most.

Texts that fail the base rules (fewer than 50 words, or over half of the words in repeated 3-word windows) are rejected
outright and don't take part in the estimate.

Defined cases: a null text has no words and fails the base rules; a corpus without a passing text needs no estimate;
repeated rows count each; extra columns stay, and columns named like an added one are replaced. Equality of 3-word
windows and of words is that of 64-bit hashes. Batches are cut to a few MB, so memory is that of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import add_columns, documents, map_batches
from tidemark.llm.words import Words, mix, slices, window_hashes

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

#: Rule: (statistic, good from, good to, bad below, bad above); None for no bound.
RULES = {
    "symbols": ("symbols a word", None, 0.02, None, 0.1),
    "marked_words": ("share of words with a symbol", None, 0.02, None, 0.1),
    "letters": ("share of letters", 0.9, None, 0.8, None),
    "digits": ("share of digits", None, 0.05, None, 0.2),
    "word_length": ("characters a word", 3.5, 7.0, 2.5, 10.0),
    "longest_word": ("longest word", None, 30, None, 60),
    "upper": ("share of upper case", None, 0.1, None, 0.3),
    "shouts": ("shouts a word", None, 0.05, None, 0.2),
    "sentences": ("sentence ends a word", 0.02, 0.25, 0.002, 0.5),
    "repeats": ("share of repeated windows", None, 0.1, None, 0.3),
    "duplicate_lines": ("share of repeated lines", None, 0.1, None, 0.3),
    "variety": ("distinct words by root of words", 4.0, None, 2.5, None),
}
#: Beliefs before the corpus is seen: the share of good texts, the share of votes on good texts that say good, and of votes
#: on bad texts that say bad; and how many votes, or texts, they count as.
SHARE, GOOD_RIGHT, BAD_RIGHT, BELIEF = 0.8, 0.98, 0.3, 20.0
ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes string, p_good double, kept boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
# other bytes than ASCII belong to letters, as far as a rule of thumb goes
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[edges])


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, of these the ones equal to an earlier line)"""
    lines = [x for x in text.split(b"\n") if x.strip(b"\x20\x09\x0a\x0b\x0c\x0d")]
    return len(lines), len(lines) - len(set(lines))


def statistics(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Counts of each text, as arrays."""
    w = Words(texts)
    n, place = np.diff(w.first), w.text_start
    place = np.minimum(place, len(w.buf))
    inside = ~w.space
    lines = np.array([duplicate_lines(t) for t in w.texts], np.int64).reshape(-1, 2)
    words = w.hashes()
    h = window_hashes(words, 3)
    ok = w.window_starts(3)
    at = np.flatnonzero(ok)
    _, which, times = np.unique(mix(h[at] + mix(w.doc[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    again = at[times[which] > 1]
    step = np.zeros(len(w.doc) + 3, np.int32)
    step[again] += 1
    step[again + 3] -= 1
    repeated = np.cumsum(step)[: len(w.doc)] > 0
    size = w.end - w.start
    longest = np.zeros(len(n), np.int64)
    some = np.flatnonzero(n)
    if len(some):
        longest[some] = np.maximum.reduceat(size, w.first[some])
    marked = np.add.reduceat(_SYMBOL[w.buf], w.start) > 0 if len(w.start) else np.zeros(0, bool)
    distinct = np.bincount(w.doc[np.unique(mix(words + mix(w.doc.astype(np.uint64))), return_index=True)[1]], minlength=len(n))
    return {
        "n_words": n,
        "n_marked": _sums(marked, w.first),
        "n_distinct": distinct,
        "n_letters": _sums(_LETTER[w.buf] & ((w.buf & 0xC0) != 0x80), place),
        "n_digits": _sums(_DIGIT[w.buf], place),
        "n_ends": _sums(_END[w.buf], place),
        "longest": longest,
        "word_chars": _sums(inside & ((w.buf & 0xC0) != 0x80), place),
        "n_symbols": _sums(_SYMBOL[w.buf], place),
        "n_lines": lines[:, 0],
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": _sums(repeated, w.first),
        "n_shouts": _sums(_SHOUT[w.buf], place),
        "n_upper": _sums(_UPPER[w.buf], place),
    }


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])


def votes(s: dict[str, np.ndarray], rules: dict = RULES) -> list[str]:
    """A letter a rule: + good, - bad, 0 abstains."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    value = {
        "symbols a word": s["n_symbols"] / words,
        "share of words with a symbol": s["n_marked"] / words,
        "share of letters": s["n_letters"] / chars,
        "share of digits": s["n_digits"] / chars,
        "characters a word": s["word_chars"] / words,
        "longest word": s["longest"],
        "share of upper case": s["n_upper"] / chars,
        "shouts a word": s["n_shouts"] / words,
        "sentence ends a word": s["n_ends"] / words,
        "share of repeated windows": s["n_repeat_words"] / words,
        "share of repeated lines": s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        "distinct words by root of words": s["n_distinct"] / np.sqrt(words),
    }

    def letter(x: np.ndarray, low: float | None, high: float | None, under: float | None, over: float | None) -> np.ndarray:
        good = (x >= (-np.inf if low is None else low)) & (x <= (np.inf if high is None else high))
        bad = (x < (-np.inf if under is None else under)) | (x > (np.inf if over is None else over))
        return np.where(bad, "-", np.where(good, "+", "0"))

    return ["".join(x) for x in np.array([letter(value[rule[0]], *rule[1:]) for rule in rules.values()]).T]


@dataclass
class Estimate:
    """What the corpus says: the share of good texts, and of each rule how often a vote on a good or a bad text is right."""

    share: float
    good_right: np.ndarray
    bad_right: np.ndarray
    rounds: int = 0

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability that a text of each pattern is good."""
        plus, minus = (np.array([[c == mark for c in p] for p in patterns], float).reshape(len(patterns), len(self.good_right)) for mark in "+-")
        return self._posterior(plus, minus)

    def _posterior(self, plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
        odds = np.log(self.share / (1 - self.share)) + plus @ np.log(self.good_right / (1 - self.bad_right)) + minus @ np.log((1 - self.good_right) / self.bad_right)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(patterns: dict[str, int], rules: int = len(RULES), rounds: int = 2000) -> Estimate:
    """Expectation-maximisation from the counts of the vote patterns, until no posterior moves by 1e-10."""
    now = Estimate(SHARE, np.full(rules, GOOD_RIGHT), np.full(rules, BAD_RIGHT))
    if not patterns:
        return now
    keys = sorted(patterns)
    count = np.array([patterns[k] for k in keys], float)
    plus, minus = (np.array([[c == mark for c in k] for k in keys], float) for mark in "+-")
    p = now._posterior(plus, minus)
    for i in range(1, rounds + 1):
        good, bad = count * p, count * (1 - p)
        now = Estimate(
            float((good.sum() + BELIEF * SHARE) / (count.sum() + BELIEF)),
            (good @ plus + BELIEF * GOOD_RIGHT) / (good @ (plus + minus) + BELIEF),
            (bad @ minus + BELIEF * BAD_RIGHT) / (bad @ (plus + minus) + BELIEF),
            i,
        )
        before, p = p, now._posterior(plus, minus)
        if np.abs(p - before).max() < 1e-10:
            break
    return now


def vote_patterns(docs: DataFrame, text: str = "text", rules: dict = RULES) -> dict[str, int]:
    """How many texts that pass the base rules have each vote pattern; at most 3 ** rules patterns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                s = statistics(texts)
                found = np.array(votes(s, rules))[~base_failed(s)]
                pattern, times = np.unique(found, return_counts=True)
                yield pa.record_batch({"votes": pa.array(pattern.tolist(), pa.string()), "n": pa.array(times, pa.int64())})

    rows = map_batches(docs.select(text), count, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    return {r["votes"]: r["n"] for r in rows}


def score_quality(docs: DataFrame, text: str = "text", rules: dict = RULES, only_kept: bool = False) -> DataFrame:
    """Each row with its counts, votes, posterior ``p_good`` and ``kept``; with only_kept, the rows kept, as they came."""
    patterns = vote_patterns(docs, text, rules)
    estimate = fit(patterns, len(rules))
    known = sorted(patterns)
    posterior = dict(zip(known, estimate.posterior(known).tolist(), strict=True))

    def judge(texts: list[bytes | None]) -> list[np.ndarray]:
        s = statistics(texts)
        failed, cast = base_failed(s), votes(s, rules)
        p = np.where(failed, 0.0, [posterior[v] if v in posterior else float(estimate.posterior([v])[0]) for v in cast])
        counts = [s[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return [*counts, failed, np.array(cast, object), p, ~failed & (p >= 0.5)]

    if not only_kept:
        types = (*[pa.int64()] * 5, pa.bool_(), pa.string(), pa.float64(), pa.bool_())
        return add_columns(docs, text, ADDED, lambda texts: [pa.array(x, t) for x, t in zip(judge(texts), types, strict=True)])
    where = docs.columns.index(text)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in slices(batch.column(where)):
                yield batch.slice(row, len(texts)).filter(pa.array(judge(texts)[-1]))

    return map_batches(docs, sift, docs.schema)


def op8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of it: the counts and the base rules."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


OP8_SQL = r"""
with doc as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
line as (select doc_id, unnest(string_split(text, chr(10))) as line from doc),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from line where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
win as (select doc_id, i, array_to_string(words[i:i + 2], ' ') as said from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from doc)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, said) as n from win) where n > 1),
repeated as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from again) group by doc_id),
counts as (
  select d.doc_id, len(d.words)::bigint as n_words, coalesce(list_sum(list_transform(d.words, lambda w: length(w))), 0)::bigint as word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(u.n_dup_lines, 0)::bigint as n_dup_lines, coalesce(r.n_repeat_words, 0)::bigint as n_repeat_words
  from doc d left join dup u on d.doc_id = u.doc_id left join repeated r on d.doc_id = r.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir).select("doc_id", "text")).drop("text")

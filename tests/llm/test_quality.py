from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import clashing, empty, odd_docs, odd_rows, rows_of, word, words
from tidemark.llm.quality import BAD_RIGHT, BELIEF, GOOD_RIGHT, RULES, SHARE, fit, op8_quality_rules, score_quality, statistics, vote_patterns


def brute(text):
    w, text = words(text), text or ""
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_counts_match_brute_force(spark):
    rows = [*odd_rows(), (30, "a b c\nx\na b c\n a b c\n\nx\n", None, None, None), (31, "a a a a", None, None, None), (32, "x # <tag>|$", None, None, None)]
    docs = spark.createDataFrame(rows, odd_docs(spark).schema)
    got = rows_of(score_quality(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for r in rows:
        n = brute(r[1])
        want.append((r[0], *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert got == sorted(want, key=repr)


def prose(i, n=80):
    return " ".join(word((i * 31 + j * 17) % 997 * 80 + j) + "." * (j % 9 == 8) for j in range(n))


def brute_votes(text):
    w, text = words(text), text or ""
    n, chars, symbols, dup_lines, again = brute(text)
    joined, lines, per = "".join(w), [x for x in text.split("\n") if words(x)], max(n, 1)

    def share(test):
        return sum(map(test, joined)) / max(chars, 1)

    value = {
        "symbols": symbols / per,
        "marked_words": sum(bool(set(x) & set("#*$%&|<>")) for x in w) / per,
        "letters": share(lambda c: not c.isascii() or c.isalpha()),
        "digits": share(lambda c: c in "0123456789"),
        "word_length": chars / per,
        "longest_word": max((len(x.encode()) for x in w), default=0),
        "upper": share(lambda c: c.isascii() and c.isupper()),
        "shouts": sum(c in "!?" for c in joined) / per,
        "sentences": sum(c in ".!?" for c in joined) / per,
        "repeats": again / per,
        "duplicate_lines": dup_lines / max(len(lines), 1),
        "variety": len(set(w)) / per**0.5,
    }

    def vote(x, low, high, under, over):
        if under is not None and x < under or over is not None and x > over:
            return "-"
        return "+" if (low is None or x >= low) and (high is None or x <= high) else "0"

    return "".join(vote(value[name], *rule[1:]) for name, rule in RULES.items())


def brute_kept(texts, rounds=60):
    """Whether each text passes the base rules and is more likely good, by the plain estimate."""
    passed, votes = [], [brute_votes(t) for t in texts]
    for t in texts:
        n = brute(t)
        passed.append(n[0] >= 50 and 100 * n[4] <= 50 * n[0])
    counts = Counter(v for v, ok in zip(votes, passed, strict=True) if ok)
    p = slow_fit(counts, len(RULES), rounds)
    return [ok and p[v] >= 0.5 for v, ok in zip(votes, passed, strict=True)]


def test_kept_matches_brute_force(spark):
    texts = [r[1] for r in odd_rows()] + [prose(i) for i in range(30)] + [prose(i).replace("a", "#") for i in range(5)] + [prose(i).replace(".", "!!?") for i in range(4)] + [f"{prose(i)} {'z' * 90}" for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.kept, r.votes) for r in score_quality(docs).select("doc_id", "kept", "votes").collect())
    assert got == [(i, k, brute_votes(t)) for i, (k, t) in enumerate(zip(brute_kept(texts), texts, strict=True))]
    assert 30 < sum(k for _, k, _ in got) < len(texts) - 10


def test_symbols_are_rejected_and_prose_is_kept(spark):
    rows = [(i, prose(i)) for i in range(60)] + [(100 + i, prose(i).replace(" ", "*** ")) for i in range(6)] + [(200, prose(1, 30)), (201, prose(2).upper().replace(" ", "!! "))]
    kept = {r.doc_id for r in score_quality(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").collect()}
    assert kept == set(range(60))


def test_only_kept_returns_rows_as_they_came(spark):
    docs = clashing(odd_docs(spark))
    out, scored = score_quality(docs, only_kept=True), score_quality(docs).where("kept")
    assert out.columns == docs.columns and out.where("kept <> 'mine kept'").count() == 0
    assert rows_of(out, "doc_id", "text") == rows_of(scored, "doc_id", "text")


def test_patterns_leave_out_failed_texts(spark):
    docs = odd_docs(spark)
    patterns = vote_patterns(docs)
    assert sum(patterns.values()) == score_quality(docs).where("not base_failed").count()
    assert all(len(p) == len(RULES) for p in patterns)


def planted(right_good, right_bad, n=20_000, share=0.7, silent=0.2, seed=3):
    """(vote patterns, classes) of texts whose rules vote independently and are right as often as stated."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < share
    right = rng.random((n, len(right_good))) < np.where(good[:, None], right_good, right_bad)
    letters = np.where(rng.random(right.shape) < silent, "0", np.where(right == good[:, None], "+", "-"))
    return ["".join(x) for x in letters], good


def slow_fit(counts, rules, rounds):
    """The same estimate a text pattern, a rule and a vote at a time."""
    share, right = SHARE, {"+": [GOOD_RIGHT] * rules, "-": [BAD_RIGHT] * rules}

    def good_odds(pattern):
        good, bad = share, 1 - share
        for j, vote in enumerate(pattern):
            if vote != "0":
                good *= right["+"][j] if vote == "+" else 1 - right["+"][j]
                bad *= right["-"][j] if vote == "-" else 1 - right["-"][j]
        return good / (good + bad)

    for _ in range(rounds):
        p = {k: good_odds(k) for k in counts}
        share = (sum(n * p[k] for k, n in counts.items()) + BELIEF * SHARE) / (sum(counts.values()) + BELIEF)
        right = {
            vote: [
                (sum(n * weight(p[k]) for k, n in counts.items() if k[j] == vote) + BELIEF * belief)
                / (sum(n * weight(p[k]) for k, n in counts.items() if k[j] != "0") + BELIEF)
                for j in range(rules)
            ]
            for vote, belief, weight in (("+", GOOD_RIGHT, lambda x: x), ("-", BAD_RIGHT, lambda x: 1 - x))
        }
    return {k: good_odds(k) for k in counts}


def test_the_estimate_equals_a_plain_one():
    assert fit({}).rounds == 0
    for seed in range(4):
        rng = np.random.default_rng(seed)
        votes, _ = planted(rng.uniform(0.6, 0.95, 5), rng.uniform(0.4, 0.9, 5), 400, seed=seed)
        counts = Counter(votes)
        estimate = fit(counts, 5)
        want = slow_fit(counts, 5, estimate.rounds)
        assert estimate.posterior(list(counts)) == pytest.approx([want[k] for k in counts], abs=1e-9)


def test_planted_accuracies_are_recovered():
    right_good, right_bad = np.array([0.6, 0.8, 0.95] * 4), np.array([0.95, 0.6, 0.8] * 4)
    votes, good = planted(right_good, right_bad)
    estimate = fit(Counter(votes))
    assert abs(estimate.share - 0.7) < 0.05
    assert np.abs(estimate.good_right - right_good).max() < 0.05 and np.abs(estimate.bad_right - right_bad).max() < 0.05
    kept = estimate.posterior(votes) >= 0.5
    all_pass = np.array(["-" not in v for v in votes])
    assert (kept == good).mean() > 0.95 > 0.6 > (all_pass == good).mean()
    # texts with a bad vote are kept, and some without one are not
    assert (kept & ~all_pass).sum() > 1000


def test_a_rule_that_is_often_wrong_loses_its_weight():
    n = len(RULES)
    rest = "0" * (n - 3)
    # the first rule says bad of a fifth of the texts that the others find good; two others agree on the bad ones
    counts = {"+++" + rest: 8000, "-++" + rest: 2000, "---" + rest: 300, "+--" + rest: 700, "++-" + rest: 30, "+00" + rest: 60}
    estimate = fit(counts)
    p = dict(zip(counts, estimate.posterior(list(counts)), strict=True))
    assert p["-++" + rest] > 0.5 > p["+--" + rest] and p["---" + rest] < 0.5 < p["+00" + rest]
    assert estimate.posterior(["+0-" + rest])[0] < 0.5 < estimate.posterior(["-0+" + rest])[0]
    assert abs(estimate.good_right[0] - 0.8) < 0.02


def test_few_texts_and_one_sided_corpora():
    n = len(RULES)
    good, silent, one, three = "+" * n, "0" * n, "-" + "+" * (n - 1), "---" + "+" * (n - 3)
    assert fit({good: 1}).posterior([good])[0] > 0.5 > fit({three: 1}).posterior([three])[0]
    p = fit({good: 9000, silent: 100, one: 30, three: 600}).posterior([good, silent, one, three])
    assert p[0] > p[2] > 0.5 > p[3] and p[1] > 0.5
    assert fit({three: 1000}).posterior([three])[0] < 0.5 < fit({good: 1000}).posterior([good])[0]


def test_statistics_match_brute_force():
    texts = [r[1] for r in odd_rows()] + ["A1 b2! #c d. E? d\n x", "Ünï 12 ab", "one one #"]
    s = statistics([t.encode() if t is not None else None for t in texts])
    for i, t in enumerate(texts):
        w = words(t)
        joined = "".join(w)
        assert s["longest"][i] == max((len(x.encode()) for x in w), default=0)
        assert s["n_distinct"][i] == len(set(w)) and s["n_marked"][i] == sum(bool(set(x) & set("#*$%&|<>")) for x in w)
        assert s["n_letters"][i] == sum(c.isascii() and c.isalpha() or not c.isascii() for c in joined)
        assert s["n_digits"][i] == sum(c in "0123456789" for c in joined) and s["n_ends"][i] == sum(c in ".!?" for c in joined)


def test_gibberish_and_many_symbols_are_no_plain_prose(spark):
    def token(i, j, n=40):
        return "".join(chr(97 + (i * 7 + j * 11 + k * (j + 3)) % 26) for k in range(n - 2)) + f"{j:02}"

    long_ = [(100, " ".join(token(0, j) for j in range(60)))]
    marks = [(200, prose(3).replace("a", "#"))]
    rows = [(i, prose(i)) for i in range(60)] + long_ + marks
    scored = {r.doc_id: r for r in score_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not scored[100].base_failed and scored[100].votes.count("-") >= 2 and scored[200].votes.count("-") >= 2
    assert {i for i, r in scored.items() if r.kept} == set(range(60))


@pytest.mark.parametrize("part", ["none", "null"])
def test_empty_table_and_null_texts(spark, part):
    docs = odd_docs(spark)
    docs = empty(docs) if part == "none" else docs.where("text is null")
    assert score_quality(docs).where("kept").count() == 0


def test_query_covers_all_rows(spark, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert op8_quality_rules(spark, str(tmp_path)).count() == len(odd_rows())

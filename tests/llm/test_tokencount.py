import random
import time

import numpy as np
import pytest

from tests.llm.helpers import clashing, empty, odd_docs, odd_rows, words
from tidemark.llm import tokencount
from tidemark.llm.tokencount import MARK, UNKNOWN, Unigram, count_tokens, read_pieces


def brute(word, pieces):
    worst = min(pieces.values()) - UNKNOWN
    best, longest = [(0.0, 0)], max(map(len, pieces))
    for i in range(1, len(word) + 1):
        ways = [(best[i - 1][0] + worst, best[i - 1][1] - len(word[i - 1].encode()))]
        ways += [(best[j][0] + pieces[word[j:i]], best[j][1] - 1) for j in range(max(0, i - longest), i) if word[j:i] in pieces]
        best.append(max(ways))
    return -best[-1][1]


@pytest.fixture(scope="module")
def pieces():
    return read_pieces()


def test_counts_match_brute_force(pieces):
    rng = random.Random(1)
    some = [p for p in pieces if len(p) < 6]
    tokens = {MARK + "".join(rng.choice(some) for _ in range(rng.randint(0, 5))) for _ in range(400)}
    tokens |= {MARK + "".join(chr(rng.choice([rng.randint(33, 126), rng.randint(0xA0, 0x2FF), 0x65E5, 0x1F600])) for _ in range(rng.randint(1, 30))) for _ in range(200)}
    tokens = sorted(tokens | {MARK, MARK + "x" * 3000})
    assert Unigram(pieces).counts(tokens).tolist() == [brute(t, pieces) for t in tokens]


def test_words_without_a_space(pieces):
    rng = random.Random(4)
    alphabets = ["etaoinshrdlu", "的一是不了人我在有他这中大来上国", "ab\U0001f600é日", "xyz0123456789+/"]
    tokens = [MARK + "".join(rng.choice(alphabets[i % 4]) for _ in range(rng.choice([47, 48, 49, 200, 2000]))) for i in range(24)]
    model = Unigram(pieces)
    assert model.counts(tokens).tolist() == [brute(t, pieces) for t in tokens] == [model._alone(t) for t in tokens]


def test_a_megabyte_without_a_space(pieces):
    rng = random.Random(5)
    token = MARK + "".join(rng.choice("ABCDEFGHabcdefghijkl0123+/") for _ in range(1 << 20))
    model, began = Unigram(pieces), time.process_time()
    n = model.counts([token])[0]
    assert time.process_time() - began < 15 and len(token) / 4 < n < len(token)


def test_remembered_words(pieces, monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 40)
    model, rng = Unigram(pieces), random.Random(6)
    vocabulary = [MARK + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    hashes = np.unique(np.array([rng.randrange(1 << 64) for _ in vocabulary], np.uint64))
    for _ in range(12):
        some = np.sort(np.array(rng.sample(range(len(hashes)), 25)))
        got = model.remembered(hashes[some], lambda at, some=some: [vocabulary[some[i]] for i in at])
        assert got.tolist() == model.counts([vocabulary[i] for i in some]).tolist()


def test_small_models_and_ties():
    pieces = {"a": -1.0, "aa": -2.0, "b": -5.0, "aab": -2.5, MARK: -1.0}
    tokens = ["", "a", "aa", "aaa", "aaab", "b", "c", MARK + "aab", "aabaab"]
    assert Unigram(pieces).counts(tokens).tolist() == [brute(t, pieces) for t in tokens]
    assert Unigram(pieces).counts([]).tolist() == []


def test_agrees_with_sentencepiece(pieces):
    """The library's own unigram model of the same pieces, where no characters are unknown."""
    import sentencepiece

    from tidemark.llm.bpe import _field

    unigram, normal, unknown = 1, 1, 2
    model = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)) + b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, normal)) for p, s in pieces.items())
    model += _field(2, _field(3, unigram)) + _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(2)
    tokens = sorted({MARK + "".join(rng.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(rng.randint(1, 12))) for _ in range(500)})
    same = sum(len(processor.encode(t)) == n for t, n in zip(tokens, Unigram(pieces).counts(tokens).tolist(), strict=True))
    assert same >= 0.99 * len(tokens)  # it sums in 32 bits


def test_documents(spark, pieces):
    docs = clashing(odd_docs(spark))
    out = count_tokens(docs)
    assert out.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_tokens"]
    known = {}
    want = [(r[0], len(words(r[1])), sum(known.setdefault(w, brute(MARK + w, pieces)) for w in words(r[1]))) for r in odd_rows()]
    assert sorted(((r.doc_id, r.n_words, r.n_tokens) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert count_tokens(empty(docs)).count() == 0

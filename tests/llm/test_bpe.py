import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, empty, odd_docs, odd_rows
from tidemark.llm.bpe import Codec, decode_ids, encode_texts, model_bytes, token_digests, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    tokens = vocabulary(PATH)
    return tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    tokens = vocabulary(PATH)
    return Codec(model_bytes(tokens), tokens, public_tokenizers.PATTERN)


def random_texts(n):
    rng = random.Random(3)
    kinds = [(0, 127), (0, 0x2FF), (0x2000, 0x30FF), (0x10000, 0x1F9FF), (0x20, 0x20), (0x85, 0xA0)]
    return ["".join(chr(rng.randint(*rng.choice(kinds))) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_are_those_of_the_known_encoder(codec, known):
    texts = [*random_texts(800), "a" * 3000, " " * 999 + "x", "<|endoftext|>", "it's we'll  \n\n x", ""]
    ids, ends = codec.encode([t.encode() for t in texts])
    data, data_ends = codec.decode(ids, ends)
    assert [part.tolist() for part in np.split(ids, ends[:-1])] == [known.encode_ordinary(t) for t in texts]
    assert [part.tobytes() for part in np.split(data, data_ends[:-1])] == [t.encode() for t in texts]


def test_memory_of_pretokens_is_bounded(codec, known, monkeypatch):
    monkeypatch.setattr("tidemark.llm.bpe.REMEMBERED", 3)
    for text in random_texts(50):
        assert codec.encode([text.encode()])[0].tolist() == known.encode_ordinary(text)


def test_documents(spark, known):
    def sha(data):
        return hashlib.sha256(data).hexdigest()

    want = []
    for row in odd_rows():
        ids = known.encode_ordinary(row[1] or "")
        want.append((row[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((row[1] or "").encode())))
    got = token_digests(odd_docs(spark)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_columns(spark):
    docs = clashing(odd_docs(spark))
    out = decode_ids(encode_texts(docs))
    assert out.columns == [c for c in docs.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    assert out.where(F.decode("decoded", "UTF-8") != F.coalesce("text", F.lit(""))).count() == 0


def test_null_ids_and_empty_table(spark):
    assert decode_ids(spark.createDataFrame([(None,), ([],)], "ids array<int>")).where("octet_length(decoded) = 0").count() == 2
    assert token_digests(empty(odd_docs(spark))).count() == 0


def test_vocabulary_must_be_whole(tmp_path):
    (tmp_path / "bad").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        vocabulary(str(tmp_path / "bad"))

"""Token counts by a unigram model, with one dynamic program over the trie of a batch's distinct pre-tokens.

A pre-token is a word with a word mark in front. Its tokens are the pieces of the segmentation with the best sum of log
probabilities; of equally good ones the one with fewer tokens. A character that no piece covers costs UNKNOWN less than
the worst piece and counts as its UTF-8 bytes. The best score and count of a prefix don't depend on what follows, so they
are computed once for each node of the trie, a level of nodes at a time, and a word's count is read at its last node.
Words of more than ``DEEPEST`` characters, whose tail no other word is likely to share, are branches of their own: their
pieces are found for all places at once and one pass over these gives the same count. Counts of words that were seen are
kept from one slice to the next.

The piece list is a public one; the log probabilities follow from the ranks by Zipf's law, as that list has ranks only.
Defined cases: a null text has no words and no tokens; repeated rows stay; extra columns stay, and columns named like an
added one are replaced. Words and prefixes are told apart by 64-bit hashes. Memory is that of a few MB of text or the longest text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.shared import add_columns, documents
from tidemark.llm.words import Words, mix

MARK = "▁"
UNKNOWN = 10.0
#: Characters up to which words share a trie, and words whose counts are remembered.
DEEPEST, REMEMBERED = 48, 500_000
#: Bits of the table that tells most hashes that are no piece.
FILTER_BITS = 20
_BASE = 0x9E3779B97F4A7C15


def read_pieces(path: str | None = None) -> dict[str, float]:
    """Log probabilities of the pieces of a sentencepiece model, from their order."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [model.id_to_piece(i) for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = np.log(np.sum(1 / np.arange(1, len(usual) + 1)))
    return {piece: float(-np.log(rank + 1) - total) for rank, piece in enumerate(usual)}


def _step(h: np.ndarray, char: np.ndarray) -> np.ndarray:
    return h * np.uint64(_BASE) + char.astype(np.uint64) + np.uint64(1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Unigram:
    def __init__(self, pieces: dict[str, float]):
        hashes = []
        for piece in pieces:
            h = 0
            for c in piece:
                h = (h * _BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes.append(h)
        order = np.argsort(np.array(hashes, np.uint64))
        self.hash = np.array(hashes, np.uint64)[order]
        self.score = np.array(list(pieces.values()))[order]
        self.longest = max(map(len, pieces))
        self.worst = min(pieces.values()) - UNKNOWN
        self.power = [np.uint64(pow(_BASE, i, 1 << 64)) for i in range(self.longest + 1)]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self._slot(self.hash)] = True

        self.known, self.counted = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (mix(h.copy()) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are pieces, their scores)"""
        at = np.flatnonzero(self.maybe[self._slot(h)])
        place = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        real = self.hash[place] == h[at]
        return at[real], self.score[place[real]]

    def remembered(self, hashes: np.ndarray, pretokens: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """Tokens of the words of distinct hashes; ``pretokens`` gives those at some places, for words not seen before."""
        if len(self.known) > REMEMBERED:
            self.known, self.counted = self.known[:0], self.counted[:0]
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = np.flatnonzero(place < len(self.known))
        new[inside] = self.known[place[inside]] != hashes[inside]
        out, missing = np.empty(len(hashes), np.int64), np.flatnonzero(new)
        out[~new] = self.counted[place[~new]]
        if len(missing):
            out[missing] = self.counts(pretokens(missing))
            every, tokens = np.concatenate([self.known, hashes[missing]]), np.concatenate([self.counted, out[missing]])
            order = np.argsort(every)
            self.known, self.counted = every[order], tokens[order]
        return out

    def counts(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each distinct pre-token."""
        out = np.zeros(len(pretokens), np.int64)
        size = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        shared = np.flatnonzero(size <= DEEPEST)
        out[shared] = self._shared([pretokens[i] for i in shared])
        for i in np.flatnonzero(size > DEEPEST).tolist():
            out[i] = self._alone(pretokens[i])
        return out

    def _alone(self, pretoken: str) -> int:
        """Tokens of one long pre-token."""
        char = _codes(pretoken).astype(np.uint64)
        n = len(char)
        # sums of characters by falling powers give the hash of every run
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((char + np.uint64(1)) * down, dtype=np.uint64)])
        ends, lengths, gains = [], [], []
        for length in range(1, min(self.longest, n) + 1):
            at, gain = self.lookup((total[length:] - total[:-length]) * up[length:])
            ends.append(at + length)
            lengths.append(np.full(len(at), length))
            gains.append(gain)
        end = np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        first = np.searchsorted(end[order], np.arange(n + 2)).tolist()
        length, gain = np.concatenate(lengths)[order].tolist(), np.concatenate(gains)[order].tolist()
        unknown = (1 + (char > 0x7F).astype(np.int64) + (char > 0x7FF) + (char > 0xFFFF)).tolist()
        best, tokens, worst = [0.0] * (n + 1), [0] * (n + 1), self.worst
        for d in range(1, n + 1):
            value, number = best[d - 1] + worst, tokens[d - 1] + unknown[d - 1]
            for i in range(first[d], first[d + 1]):
                before = d - length[i]
                other = best[before] + gain[i]
                if other > value or other == value and tokens[before] + 1 < number:
                    value, number = other, tokens[before] + 1
            best[d], tokens[d] = value, number
        return tokens[n]

    def _shared(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of distinct pre-tokens, by their trie."""
        if not pretokens:
            return np.zeros(0, np.int64)
        size = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        order = np.argsort(-size, kind="stable")
        size = size[order]
        chars = _codes("".join(pretokens[i] for i in order))
        start = np.cumsum(size) - size
        # at depth d the words of at least d characters are the first ones
        live = np.searchsorted(-size, -np.arange(size[0] + 2), "right")
        prefix = np.zeros(len(size), np.uint64)
        root = (np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64), np.zeros(len(size), np.int64))
        levels = [root]  # of the last depths: hash, best score and count of each node, node of each live word
        out = np.zeros(len(size), np.int64)
        for d in range(1, size[0] + 1):
            n = live[d]
            char = chars[start[:n] + d - 1]
            prefix = _step(prefix[:n], char)
            node_hash, word, node = np.unique(prefix, return_index=True, return_inverse=True)
            last = char[word]
            parent = levels[-1][3][word]
            # one unknown character
            best = levels[-1][1][parent] + self.worst
            count = levels[-1][2][parent] + 1 + (last > 0x7F) + (last > 0x7FF) + (last > 0xFFFF)
            for length in range(1, min(d, self.longest) + 1):
                h, score, tokens, of = levels[-length]
                before = of[word]
                at, gain = self.lookup(node_hash - h[before] * self.power[length])
                value, number = score[before[at]] + gain, tokens[before[at]] + 1
                better = (value > best[at]) | (value == best[at]) & (number < count[at])
                best[at[better]], count[at[better]] = value[better], number[better]
            levels = [*levels[-self.longest + 1 :], (node_hash, best, count, node)]
            ends = slice(live[d + 1], n)
            out[ends] = count[node[ends]]
        result = np.empty(len(size), np.int64)
        result[order] = out
        return result


def count_tokens(docs: DataFrame, text: str = "text", pieces: dict[str, float] | None = None) -> DataFrame:
    """Each row with ``n_words`` and ``n_tokens``."""
    shipped = docs.sparkSession.sparkContext.broadcast(Unigram(pieces or read_pieces()))

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        words = Words(texts)
        hashes, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        data = words.buf.tobytes()

        def pretokens(at: np.ndarray) -> list[str]:
            return [MARK + data[lo:hi].decode() for lo, hi in zip(words.start[first[at]].tolist(), words.end[first[at]].tolist(), strict=True)]

        total = np.concatenate([[0], np.cumsum(shipped.value.remembered(hashes, pretokens)[which])])
        return [pa.array(np.diff(words.first), pa.int64()), pa.array(np.diff(total[words.first]), pa.int64())]

    return add_columns(docs, text, "n_words long, n_tokens long", work)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir).select("doc_id", "text")).drop("text")

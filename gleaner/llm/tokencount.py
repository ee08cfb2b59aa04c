"""Token counts by dynamic programming over a trie that distinct pre-tokens share.

Pre-tokens are runs without ASCII white space, each with the word mark in front. Their unigram segmentation of the
highest score is found by forward scores, which hang on a prefix only: the distinct pre-tokens that a worker has not
met before are put in a trie, and each node's score is computed once, whatever number of pre-tokens share it; the node
where a pre-token ends has its count, which the worker keeps. Levels of many nodes are computed level by level, in
numpy; what goes on below levels of few nodes is walked depth first, branch after branch. Of equal scores the one of
fewer tokens counts.

A piece scores the logarithm of its place in the vocabulary (Zipf's law), in thousandths; the vocabulary's own
numbers are kept where they are log-probabilities. Where a vocabulary holds merges, as the one of the query does, these
counts are those of a unigram made of it, not those of its own merges. Characters without a piece cost a token for each
UTF-8 byte.

Cases: a null or empty text, or one of white space, has 0 tokens; pre-tokens of any length are counted whole; repeated
rows are counted each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import text_chunks, with_package, words_of

MARK = "▁"
#: Distinct pre-tokens whose counts a worker keeps.
KEPT = 500_000
#: Pre-tokens at a level of the trie from which on branches are walked depth first.
FEW = 16
NONE = -(1 << 60)


class Vocabulary:
    """pieces: text and score (an integer, higher is better); byte_score: of a byte of a character without a piece."""

    def __init__(self, pieces: dict[str, int], byte_score: int):
        self.pieces, self.byte_score = pieces, byte_score
        self.longest = max(map(len, pieces))
        moves: dict[int, int] = {}
        scores = [NONE]
        for piece, score in pieces.items():
            state = 0
            for c in piece:
                key = state << 21 | ord(c)
                if key not in moves:
                    moves[key] = len(scores)
                    scores.append(NONE)
                state = moves[key]
            scores[state] = score
        # the last state has no move: where no piece goes on
        self.dead = len(scores)
        self.scores = np.array([*scores, NONE], np.int64)
        self.keys = np.array(sorted(moves), np.int64)
        self.next = np.array([moves[k] for k in sorted(moves)], np.int64)
        self.forget()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a sentencepiece model file."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        own = [p.get_score(i) for i in ids]
        ranked = all(float(s).is_integer() for s in own)  # numbers of merges, not log-probabilities
        score = lambda i: round(-1000 * math.log(i + 2)) if ranked else round(1000 * p.get_score(i))
        return cls({p.id_to_piece(i): score(i) for i in ids}, round(-1000 * math.log(p.get_piece_size() + 2)) if ranked else round(1000 * min(own)) - 10_000)

    def forget(self) -> None:
        self.words, self.counts = pa.array([], pa.string()), np.zeros(0, np.int64)

    def step(self, state: np.ndarray, points: np.ndarray) -> np.ndarray:
        key = state << 21 | points
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], self.dead)

    def count_trie(self, words: list[str]) -> np.ndarray:
        """Tokens of each word (with its mark): one level of the trie after another."""
        out = np.zeros(len(words), np.int64)
        if not words:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(size) - size
        width = self.longest
        # of each node: states of the pieces begun at its last ancestors; forward scores and counts of itself and those
        state = np.full((1, width), self.dead, np.int64)
        score, count = np.full((1, width), NONE, np.int64), np.zeros((1, width), np.int64)
        score[0, 0] = 0
        active, depth = np.flatnonzero(size), 0
        node = np.zeros(len(active), np.int64)
        while len(active) > FEW:
            keys, new = np.unique(node << 21 | points[begin[active] + depth], return_inverse=True)
            parent, c = keys >> 21, keys & (1 << 21) - 1
            states = np.empty((len(keys), width), np.int64)
            states[:, 0] = self.step(np.zeros(len(keys), np.int64), c)
            states[:, 1:] = self.step(state[parent, :-1], c[:, None])
            at = score[parent] + self.scores[states]
            tokens = count[parent] + 1
            unknown = self.scores[states[:, 0]] == NONE
            wide = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            at[unknown, 0] = score[parent[unknown], 0] + self.byte_score * wide[unknown]
            tokens[unknown, 0] = count[parent[unknown], 0] + wide[unknown]
            best = at.max(axis=1)
            least = np.where(at == best[:, None], tokens, 1 << 60).min(axis=1)
            score = np.concatenate([best[:, None], score[parent, :-1]], axis=1)
            count = np.concatenate([least[:, None], count[parent, :-1]], axis=1)
            state, node, depth = states, new, depth + 1
            ended = size[active] == depth
            out[active[ended]] = least[node[ended]]
            active, node = active[~ended], node[~ended]
        # forward scores and counts from the node's last ancestors on, the root's first
        branches = sorted((words[k], int(n), int(k)) for k, n in zip(active, node))
        walked, last, best, least = "", -1, [], []
        for word, n, k in branches:
            first = max(0, depth - width + 1)  # the first position whose score is at hand
            if n != last:
                walked, last = word[:depth], n
                best, least = score[n, : depth - first + 1].tolist()[::-1], count[n, : depth - first + 1].tolist()[::-1]
            shared = depth
            while shared < min(len(word), len(walked)) and word[shared] == walked[shared]:
                shared += 1
            del best[shared - first + 1 :], least[shared - first + 1 :]
            self._walk(word, shared, first, best, least)
            walked, out[k] = word, least[len(word) - first]
        return out

    def _walk(self, word: str, done: int, first: int, best: list[int], least: list[int]) -> None:
        """Adds forward scores and counts of the word's positions after ``done``; the lists begin with position ``first``."""
        pieces, longest = self.pieces, self.longest
        for end in range(done + 1, len(word) + 1):
            found, tokens = NONE, 0
            for begin in range(max(first, end - longest), end):
                s = pieces.get(word[begin:end])
                if s is not None:
                    here, more = best[begin - first] + s, least[begin - first] + 1
                elif begin == end - 1:
                    wide = len(word[begin].encode("utf-8", "surrogatepass"))
                    here, more = best[begin - first] + self.byte_score * wide, least[begin - first] + wide
                else:
                    continue
                if here > found or here == found and more < tokens:
                    found, tokens = here, more
            best.append(found)
            least.append(tokens)

    def count(self, words: pa.StringArray) -> np.ndarray:
        """Tokens of each distinct pre-token; counts of those met before are kept."""
        if len(self.words) > KEPT:
            self.forget()
        place = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(place))
        if len(new):
            counts = self.count_trie([MARK + w for w in new.to_pylist()])
            self.words, self.counts = pa.concat_arrays([self.words, new]), np.append(self.counts, counts)
            place = pc.index_in(words, value_set=self.words)
        return self.counts[place.to_numpy()]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each file and worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary.load(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words (pre-tokens) and n_tokens of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            words, n = words_of(batch.column("text"))
            coded = words.dictionary_encode()
            each = vocabulary(path).count(coded.dictionary)[coded.indices.to_numpy()]
            ends = np.cumsum(n)
            total = np.append(0, np.cumsum(each))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total[ends] - total[ends - n])], names=["doc_id", "n_words", "n_tokens"])

    return with_package(docs.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")

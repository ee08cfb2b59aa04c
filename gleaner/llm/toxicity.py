"""Toxicity: multiple-instance learning of sentences from labels of documents.

A document is a bag of sentences. Each sentence has the probability of being toxic that a logistic model of its words
gives; a document is toxic unless all of its sentences are not (noisy-or). The model is fitted to labels of documents
alone, through the noisy-or, and then tells which sentences offend.

A word counts by itself and by its first four to seven letters (of its letters in lower case), hashed, so that
inflected forms of one stem are alike. Weights are shrunk towards zero by a first-power penalty.

Cases: a null or empty text has no sentences and scores as near 0 as scores get; texts of any length are read whole;
rows without a label, or with a null one, are not learned from; labels of only one class give that class's share as
every score, none at all 0.5; repeated rows are learned from once and scored each; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.common import labelled, text_chunks, with_package

#: Hashed features.
BITS = 20
#: Labelled rows that the model is fitted to, at most, and bytes of their texts, which go to the driver.
MAX_ROWS, MAX_BYTES = 8000, 20_000_000
#: Words whose weight a worker remembers.
KEPT = 500_000
#: From which probability a sentence offends.
LEAST = 0.5

_BREAKS = b".!?\n"
#: Bytes as the sentences' signs: ends of sentences, what is between words, and the rest as it is.
_SIGNS = bytes(10 if b in _BREAKS else b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or b in b"'-" else 32 for b in range(256))


def split(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """Begin, end (in bytes) and words of the sentences with a word."""
    out, at = [], 0
    for sentence in text.translate(_SIGNS).split(b"\n"):
        if words := sentence.split():
            out.append((at, at + len(sentence), words))
        at += len(sentence) + 1
    return out


def features(word: bytes) -> list[int]:
    """Hashed numbers of the word and its beginnings."""
    letters = word.decode("utf-8", "replace").lower()
    kinds = [f"={letters}", *(f"{n}{letters[:n]}" for n in range(4, 8) if len(letters) >= n)]
    return [zlib.crc32(k.encode()) & ((1 << BITS) - 1) for k in kinds]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    share: float | None = None  # of a model without both classes
    known: dict[bytes, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def weight(self, word: bytes) -> float:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            found = self.known[word] = float(self.weights[features(word)].sum())
        return found

    def sentences(self, text: bytes) -> tuple[list[tuple[int, int, list[bytes]]], np.ndarray]:
        """The text's sentences, and the probability of each."""
        found, get, weight = split(text), self.known.get, self.weight
        margins = np.empty(len(found))
        for k, (_, _, words) in enumerate(found):
            total = 0.0
            for w in words:
                x = get(w)
                total += weight(w) if x is None else x
            margins[k] = total
        return found, 1 / (1 + np.exp(-np.clip(margins + self.bias, -40, 40)))

    def score(self, probabilities: np.ndarray) -> float:
        """The document's probability: noisy-or of its sentences'."""
        if self.share is not None:
            return self.share
        return float(-np.expm1(np.log1p(-np.minimum(probabilities, 1 - 1e-12)).sum()))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 150, rate: float = 0.3, shrink: float = 0.3, bias: float = -6.0) -> Model:
    """Maximises the likelihood of the documents' labels through the noisy-or, by steps scaled for each weight.

    Both classes count alike in all. ``shrink`` is the penalty of a weight of one, in documents.
    """
    size = 1 << BITS
    if not len(texts) or labels.min() == labels.max():
        return Model(np.zeros(size, np.float32), 0.0, float(labels.mean()) if len(texts) else 0.5)
    number: dict[bytes, int] = {}
    words, lengths, of = [], [], []
    for d, text in enumerate(texts):
        for _, _, found in split(text):
            words.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
            lengths.append(len(found))
            of.append(d)
    if not words:
        return Model(np.zeros(size, np.float32), 0.0, float(labels.mean()))
    words, lengths, of = np.concatenate(words), np.array(lengths), np.array(of)
    hashed = [features(w) for w in number]
    each, flat = np.array([len(f) for f in hashed]), np.array([x for f in hashed for x in f])
    used, flat = np.unique(flat, return_inverse=True)
    owner, sentence = np.repeat(np.arange(len(hashed)), each), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    toxic = labels == 1
    balance = np.where(toxic, len(labels) / 2 / toxic.sum(), len(labels) / 2 / (~toxic).sum())
    balance = np.minimum(balance, 10.0)
    w, seen = np.zeros(len(used)), np.full(len(used), 1e-6)
    for _ in range(epochs):
        by_word = np.bincount(owner, w[flat], len(hashed))
        p = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, by_word[words], len(lengths)) + bias, -40, 40)))
        none = np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts))  # log probability that no sentence is toxic
        whole = -np.expm1(none)
        push = np.where(toxic, np.exp(none) / np.maximum(whole, 1e-12), -1.0) * balance
        by_sentence = push[of] * p
        gradient = np.bincount(flat, np.bincount(words, by_sentence[sentence], len(hashed))[owner], len(used))
        seen += gradient**2
        step = rate / np.sqrt(seen)
        w = w + step * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
    out = np.zeros(size, np.float32)
    out[used] = w
    return Model(out, bias)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, label: str = "toxic") -> Model:
    """Fits the model to at most ``max_rows`` of the labelled rows given, of ``max_bytes`` of text together."""
    got = labelled(docs, labels, label, max_rows, max_bytes).collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"].encode() for r in got], np.array([r["label"] for r in got], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_sentences and n_offending of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in text_chunks(batches, "text"):
            rows = []
            for t in batch.column("text"):
                found, p = m.sentences((t.as_py() or "").encode())
                rows.append((m.score(p), len(found), int((p >= LEAST).sum())))
            kinds = (pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "score", "n_sentences", "n_offending"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_package(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, score double, n_sentences bigint, n_offending bigint")


def offending(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """doc_id, begin and end (characters, end left out), sentence and probability of the sentences that offend."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in text_chunks(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = (text or "").encode()
                found, p = m.sentences(raw)
                rows = []
                for k in np.flatnonzero(p >= least):
                    begin, end, _ = found[k]
                    at = len(raw[:begin].decode())
                    sentence = raw[begin:end].decode()
                    rows.append((doc_id, at, at + len(sentence), sentence, float(p[k])))
                if rows:
                    kinds = (batch.column("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "begin", "end", "sentence", "probability"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_package(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, begin bigint, end bigint, sentence string, probability double")

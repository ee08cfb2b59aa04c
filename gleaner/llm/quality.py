"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of n-grams are scaled by their class log-count ratios; a linear hinge-loss model is fitted to them by
dual coordinate descent; a logistic curve, fitted to the margins, turns margins into scores.

n-grams are of characters, of one to four, over the text's shape (letters, capitals and digits each as one sign,
runs of one sign as two at most, other bytes as they are), and of words, hashed. How many words repeat the one
before, and how many lines repeat, enters as an indicator of its band.

Cases: a null or empty text has only the band indicators and is scored with them; texts of any length are read whole;
rows without a label, or with a null one, are not learned from; labels of only one class give that class's share as
every score, none at all 0.5; repeated rows are learned from once and scored each; an empty table gives an empty
result; further columns are not read (``score`` with ``keep`` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gleaner.llm.common import extended, labelled, text_chunks, unused, with_package

#: Hashed features.
BITS = 18
#: Labelled rows that the model is fitted to, at most, and bytes of their texts: rows of the smallest hashes.
#: A text has some twenty bytes of feature numbers for each of its own at most, and a megabyte at most, which bounds what the driver gets.
MAX_ROWS, MAX_BYTES = 6000, 20_000_000

_SHAPE = np.frombuffer(bytes(ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256)), np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BANDS = np.array([0.0, 0.02, 0.1, 0.3, 0.6])


def _hashed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: bytes) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    share = [again / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)), min(1.0, len(words) / 2000)]
    bands = np.array([1 + 8 * i + int(np.searchsorted(_BANDS, s)) for i, s in enumerate(share)], np.uint64) << np.uint64(40)
    parts = [_hashed(bands)]
    if text:
        shape = _SHAPE[np.frombuffer(text, np.uint8)]
        keep = np.ones(len(shape), bool)
        keep[2:] = (shape[2:] != shape[1:-1]) | (shape[2:] != shape[:-2])
        shape = shape[keep].astype(np.uint64)
        gram = np.zeros(len(shape), np.uint64)
        for n in range(4):
            gram = (gram[: len(shape) - n] << np.uint64(8)) | shape[n:]
            if not len(gram):
                break
            parts.append(_hashed(np.unique(gram) | np.uint64((n + 1) << 36)))
            gram = gram[:-1]
        parts.append(np.array([hash_word(w) for w in set(words)], np.int32))
    return np.unique(np.concatenate(parts))


def hash_word(word: bytes) -> int:
    import zlib

    return (zlib.crc32(word) * 2654435761 & 0xFFFFFFFF) >> (32 - BITS)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # with the log-count ratios multiplied in
    squares: np.ndarray  # of the log-count ratios
    bias: float
    slope: float
    offset: float

    def score(self, found: np.ndarray) -> float:
        length = np.sqrt(max(1.0, float(self.squares[found].sum(dtype=np.float64))))
        margin = float(self.weights[found].sum(dtype=np.float64)) / length + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, cost: float = 1.0, seed: int = 7) -> Model:
    """Log-count ratios, then dual coordinate descent on the hinge loss, then a logistic curve over the margins."""
    size = 1 << BITS
    if len(rows) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(rows) else 0.5
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    count = [np.ones(size), np.ones(size)]
    for found, label in zip(rows, labels):
        count[label][found] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    sign = np.where(labels == 1, 1.0, -1.0)
    # the rarer class counts as much as the other
    bound = cost * np.where(labels == 1, 1.0, (labels == 1).sum() / max(1, (labels == 0).sum()))
    scaled = [ratio[found] / np.sqrt(max(1.0, (ratio[found] ** 2).sum())) for found in rows]
    w, b, alpha, rng = np.zeros(size), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            found, x, y = rows[i], scaled[i], sign[i]
            gradient = y * (w[found] @ x + b) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[found] += step * x
                b += step
                alpha[i] = new
    margins = np.array([w[f] @ x + b for f, x in zip(rows, scaled)])
    slope, offset = _curve(margins, (labels == 1).astype(float))
    return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), b, slope, offset)


def _curve(margins: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """A logistic curve by Newton's steps, targets held off 0 and 1."""
    n1, n0 = target.sum(), (1 - target).sum()
    target = np.where(target == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        q = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        h = np.array([[(q * margins**2).sum() + 1e-6, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, label: str = "quality") -> Model:
    """Fits the model to at most ``max_rows`` of the labelled rows given, of ``max_bytes`` of text together.

    Which ones hangs on hashes of their ids only. The driver gets feature numbers of those rows, not their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            found = [features((t or "").encode()).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "found"])

    texts = labelled(docs, labels, label, max_rows, max_bytes)
    got = with_package(texts).mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, label int, found binary").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["found"]))
    return fit([np.frombuffer(r["found"], np.int32) for r in got], np.array([r["label"] for r in got], np.int64))


def score(docs: DataFrame, model: Model, keep: bool = False, name: str = "score") -> DataFrame:
    """doc_id and score of each whole text; with ``keep``, the other columns of the documents too.

    ``name`` is that of the score's column; with ``keep`` no column of the documents may have it.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    rows = docs if keep else docs.select("doc_id", "text")
    schema = extended((rows if keep else rows.select("doc_id")).schema, name, DoubleType())
    names = schema.fieldNames()[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in text_chunks(batches, "text"):
            scores = [m.score(features((t.as_py() or "").encode())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64())], names=[*names, name])

    return with_package(rows).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` or more, with their columns, whatever their names."""
    (name,) = unused(docs.columns, "score")
    return score(docs, model, keep=True, name=name).where(F.col(name) >= least).select(docs.columns)

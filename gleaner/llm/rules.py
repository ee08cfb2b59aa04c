"""Quality rules: counts of a text, and a linear-chain conditional random field that marks its lines.

Each line with a word is content or boilerplate. Their sequence is decoded with Viterbi; a text is kept if
content lines hold enough of its words. The field is trained here, from labels of whole documents, as no lines
are labelled: lines take their document's label at first; after each round, lines of a poor document that the
field itself decodes as content become content, since such documents hold good lines too, and it is fitted anew.

Cases: a null or empty text has no words: its counts are 0, it fails the base rules and is not kept; without
labels of both classes, the field keeps every text that passes the base rules; texts of any length are read whole, in
training too; repeated rows are learned from once and judged each; an empty table gives an empty result; further
columns are not read (``apply`` with ``keep`` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from gleaner.llm.common import extended, labelled, text_chunks, unused, with_package

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
UPPER, LOWER, DIGITS = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))
#: Labelled documents that the field is fitted to, at most, and bytes of their texts.
MAX_ROWS, MAX_BYTES = 1000, 10_000_000
#: Share of words in content lines from which a text is kept.
SHARE = 0.5
BOILERPLATE, CONTENT = 0, 1


@dataclass(frozen=True)
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeated(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, the first of them included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]  # numbers below n, so products fit
    _, window, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def counts(text: bytes, lines: list[tuple[bytes, list[bytes]]]) -> Counts:
    """lines: those with a word, with their words."""
    words = [w for _, ws in lines for w in ws]
    inner = text.translate(None, WHITE)
    points = len(inner) if inner.isascii() else len(inner.decode("utf-8", "replace"))
    return Counts(len(words), points, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len({line for line, _ in lines}), repeated(words))


#: What is seen of a line; each is a number of features(), 0 or 1.
SEEN = (
    "always", "symbols over 3 %", "symbols over 10 %", "bars between words", "capitals over a third", "capitals over two thirds", "digits over 15 %", "ends like a sentence",
    "starts with a capital", "a word follows itself", "a third of words follow themselves", "under 4 words", "over 12 words", "an earlier line", "words over 12 bytes on average", "many shouts",
)


def line_features(line: bytes, words: list[bytes], earlier: bool) -> list[int]:
    """Numbers of the features of SEEN that hold."""
    size = max(1, sum(map(len, words)))
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    capitals, small = len(line) - len(line.translate(None, UPPER)), len(line) - len(line.translate(None, LOWER))
    again = sum(a == b for a, b in zip(words, words[1:]))
    stripped, n = line.rstrip(), len(words)
    holds = (
        True, symbols > 0.03 * size, symbols > 0.1 * size, line.count(b" | ") * 4 > n, capitals * 2 > small, capitals > 2 * small, len(line) - len(line.translate(None, DIGITS)) > 0.15 * size, stripped[-1:] in (b".", b"!", b"?"),
        words[0][:1].isupper() or words[0][:1] >= b"\x80", again > 0, again * 3 >= n, n < 4, n > 12, earlier, size > 12 * n, line.count(b"!") * 3 > n,
    )
    return [i for i, x in enumerate(holds) if x]


def split_lines(text: bytes) -> list[tuple[bytes, list[bytes]]]:
    return [(line, words) for line in text.split(b"\n") if (words := line.split())]


def sequence(lines: list[tuple[bytes, list[bytes]]]) -> list[list[int]]:
    seen: set[bytes] = set()
    out = []
    for line, words in lines:
        out.append(line_features(line, words, line in seen))
        seen.add(line)
    return out


@dataclass(frozen=True)
class Field:
    """emit: for each state and feature; move: from state to state."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, found: list[list[int]]) -> list[int]:
        """The likeliest states of a sequence; ties go to content."""
        if not found:
            return []
        e0, e1 = self.emit[0].tolist(), self.emit[1].tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b, back = 0.0, 0.0, []
        for k, f in enumerate(found):
            s0, s1 = sum([e0[i] for i in f]), sum([e1[i] for i in f])
            if k:
                from0, from1 = int(b + m10 >= a + m00), int(b + m11 >= a + m01)
                a, b = (b + m10 if from0 else a + m00) + s0, (b + m11 if from1 else a + m01) + s1
                back.append((from0, from1))
            else:
                a, b = s0, s1
        state = int(b >= a)
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]


class Padded:
    """Sequences of like length side by side: features seen, states and which places are filled."""

    def __init__(self, sequences: list[list[list[int]]], states: list[list[int]]):
        n, longest = len(sequences), max(map(len, sequences))
        self.x, y, self.mask = np.zeros((n, longest, len(SEEN)), np.float32), np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for k, (found, s) in enumerate(zip(sequences, states)):
            self.x[k, np.repeat(np.arange(len(found)), [len(f) for f in found]), [i for f in found for i in f]] = 1
            y[k, : len(s)], self.mask[k, : len(s)] = s, True
        hot = np.eye(2)[y] * self.mask[..., None]
        self.emitted = np.einsum("ktf,kts->sf", self.x, hot)
        self.moved = np.einsum("kti,ktj->ij", hot[:, :-1], hot[:, 1:])

    def gradient(self, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seen less expected numbers of features in states, and of steps between states."""
        n, longest, _ = self.x.shape
        score = self.x @ emit.T
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = score[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(self.mask[:, t, None], np.logaddexp(alpha[:, t - 1, 0, None] + move[0], alpha[:, t - 1, 1, None] + move[1]) + score[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = beta[:, t + 1] + score[:, t + 1]
            beta[:, t] = np.where(self.mask[:, t + 1, None], np.logaddexp(ahead[:, 0, None] + move[:, 0], ahead[:, 1, None] + move[:, 1]), 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None, None]
        p = np.exp(alpha + beta - z) * self.mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + move + (score + beta)[:, 1:, None, :] - z[..., None]) * self.mask[:, 1:, None, None]
        return self.emitted - np.einsum("ktf,kts->sf", self.x, p), self.moved - pair.sum((0, 1))


def fit(sequences: list[list[list[int]]], states: list[list[int]], epochs: int = 100, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Maximises the conditional likelihood by gradient ascent, whole sequences, those of like length side by side."""
    by_size: dict[int, list[int]] = {}
    for k, found in enumerate(sequences):
        by_size.setdefault(len(found).bit_length(), []).append(k)
    padded = [Padded([sequences[k] for k in own], [states[k] for k in own]) for own in by_size.values()]
    emit, move, total = np.zeros((2, len(SEEN))), np.zeros((2, 2)), sum(map(len, sequences))
    seen_e, seen_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    for _ in range(epochs):
        ge, gm = (np.sum(g, axis=0) for g in zip(*(p.gradient(emit, move) for p in padded)))
        ge, gm = ge / total - ridge * emit, gm / total - ridge * move
        seen_e, seen_m = seen_e + ge**2, seen_m + gm**2
        emit, move = emit + rate * ge / np.sqrt(seen_e), move + rate * gm / np.sqrt(seen_m)
    return Field(emit, move)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, rounds: int = 3) -> Field:
    """Fits the field to at most ``max_rows`` labelled documents, of ``max_bytes`` together, all lines of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            found = [sequence(split_lines((t or "").encode())) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "label", "found"])

    texts = labelled(docs, labels, "quality", max_rows, max_bytes)
    got = with_package(texts).mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, label int, found array<array<int>>").collect()
    got = sorted((r for r in got if r["found"]), key=lambda r: (r["doc_id"], r["found"]))
    sequences, marks = [r["found"] for r in got], [r["label"] for r in got]
    if len(set(marks)) < 2:
        return Field(np.array([[0.0] * len(SEEN), [1.0] * len(SEEN)]), np.zeros((2, 2)))
    states = [[m] * len(s) for s, m in zip(sequences, marks)]
    field = fit(sequences, states)
    for _ in range(rounds - 1):
        # a poor document keeps one boilerplate line at least: the one that looks least like content
        states = []
        for s, m in zip(sequences, marks):
            now = [CONTENT] * len(s) if m else field.viterbi(s)
            if not m and BOILERPLATE not in now:
                now[int(np.argmin([(field.emit[1] - field.emit[0])[f].sum() for f in s]))] = BOILERPLATE
            states.append(now)
        field = fit(sequences, states)
    return field


def judge(text: bytes, field: Field, share: float = SHARE) -> tuple[Counts, float, bool]:
    """Counts, share of words in content lines, and whether the text is kept."""
    lines = split_lines(text)
    c = counts(text, lines)
    states = field.viterbi(sequence(lines))
    content = sum(len(words) for (_, words), s in zip(lines, states) if s == CONTENT) / max(1, c.n_words)
    return c, content, not c.base_failed and content >= share


COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, content_share double, base_failed boolean, kept boolean"


def apply(docs: DataFrame, field: Field, share: float = SHARE, keep: bool = False, name: str = "kept") -> DataFrame:
    """doc_id, counts and verdict of each whole text; with ``keep``, the columns of the documents and the verdict only.

    With ``keep``, ``name`` is that of the verdict's column; no column of the documents may have it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs if keep else docs.select("doc_id", "text")
    names = rows.columns if keep else ["doc_id"]
    added = [name] if keep else [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [pa.bool_()] if keep else [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
    schema = extended(rows.schema, name, BooleanType()) if keep else f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {COLUMNS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            found = []
            for t in batch.column("text"):
                c, content, kept = judge((t.as_py() or "").encode(), sent.value, share)
                found.append((kept,) if keep else (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, content, c.base_failed, kept))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(x, k) for x, k in zip(zip(*found), kinds))], names=[*names, *added])

    return with_package(rows).mapInArrow(run, schema)


def accepted(docs: DataFrame, field: Field, share: float = SHARE) -> DataFrame:
    """The documents that the rules keep, with their columns, whatever their names."""
    (name,) = unused(docs.columns, "kept")
    return apply(docs, field, share, keep=True, name=name).where(F.col(name)).select(docs.columns)

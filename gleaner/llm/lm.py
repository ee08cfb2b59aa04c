"""Language-model scores: a log-bilinear model over words, trained with noise-contrastive estimation in numpy.

An outcome is a word with vectors of its own, or one of a few classes of all other words (by their last two bytes).
Words get their own vectors in the order of their frequency, as more of them come with more text: all that occur
LEAST times or more, up to WORDS. Outcomes are normalised in two steps, a group first and then the word within it;
a group is a run of SPAN words of like frequency, or a class. Scores of groups and of words are bilinear in their
vectors and the context's, which is a vector of the last token plus the mean of vectors of the tokens before it.
Matrix products over batches give the scores of all groups, and of all words of a group, and with them normalised
log-probabilities; within a class words take their smoothed share of the class's training tokens, all words never
seen counting as one more. So the probabilities of a token's alternatives sum to one. An untrained model gives every
outcome its share.

Training: every task passes over its own training texts from the same start. A vector of the model is the mean of
what the tasks made of it, weighted by how often each met it; so scores hang, slightly, on how the table is cut into
tasks. Word counts cover all training texts. Counts of the most frequent words (a fixed number) go to every task; the
others meet the texts' words in a join.

Cases: a null or empty text is its end token alone; a null id counts as the empty text for the fold; without
training texts every count is 0, and scores come from the untrained model; texts of any length are read whole; repeated
rows are learned from and scored each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import remainder, text_chunks, with_package, words_of, written

#: The end token: no word holds white space.
END = "\n"
#: Words with vectors of their own, END among them, at most; how often they occur at least; words of a group.
WORDS, LEAST, SPAN = 8192, 8, 128
#: Classes of the other words; words whose counts every task has.
CLASSES, HEAD = 32, 65_536
SIZE, WINDOW = 16, 16
#: Tokens of a step of training, noise groups of a step, noise words of a token.
STEP, NOISE, OTHERS = 4096, 64, 2
#: Tokens that are scored together, and whose groups are scored in one product.
SLAB, ROOM = 65_536, 512


def tokens_of(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """Tokens of the texts, each text's end token among them, and their number for each text."""
    words, n = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    out = np.full(len(words) + len(n), len(words))
    ends = np.cumsum(n + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = np.arange(len(words))
    return pa.concat_arrays([words, pa.array([END])]).take(pa.array(out)), n + 1


def class_of(words: pa.StringArray) -> np.ndarray:
    """A class of each word, from its last two bytes."""
    raw = words.cast(pa.binary())
    ends, data = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1], raw.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(1, np.uint8)
    size = np.diff(ends)
    last = np.where(size > 0, data[np.maximum(ends[1:] - 1, 0)], 0).astype(np.int64)
    before = np.where(size > 1, data[np.maximum(ends[1:] - 2, 0)], 0).astype(np.int64)
    return (before * 31 + last * 7) % CLASSES


@dataclass(frozen=True)
class Head:
    """words: the most frequent, their counts; kept: the number of them that are outcomes; share: of all outcomes."""

    words: pa.StringArray
    counts: np.ndarray
    kept: int
    total: int  # training tokens
    distinct: int
    mass: np.ndarray  # of each class: smoothed tokens
    share: np.ndarray  # of each outcome

    def outcomes(self, tokens: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's outcome and place among the head's words (-1: none)."""
        coded = tokens.dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy()
        own = np.where((place >= 0) & (place < self.kept), place, self.kept + class_of(coded.dictionary))
        at = coded.indices.to_numpy()
        return own[at], place[at]


@dataclass(frozen=True)
class Model:
    last: np.ndarray  # vectors of the last token, an outcome; one more stands for a text's start
    past: np.ndarray  # of the tokens before
    group: np.ndarray  # of groups: runs of words, then classes
    group_bias: np.ndarray
    word: np.ndarray  # of words
    word_bias: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, kept: int, seed: int = 5) -> Model:
        """Outcomes with these shares, the first ``kept`` of which are words."""
        rng, n = np.random.default_rng(seed), len(share)
        vectors = lambda k: rng.normal(0, 0.1, (k, SIZE)).astype(np.float32)
        of = groups_of(np.arange(n), kept)
        mass = np.bincount(of, share)
        zeros = lambda k: np.zeros((k, SIZE), np.float32)
        within = np.log(share[:kept] / mass[of[:kept]])
        return cls(vectors(n + 1), vectors(n + 1), vectors(len(mass)), np.log(mass).astype(np.float32), zeros(kept), within.astype(np.float32))

    @property
    def kept(self) -> int:
        return len(self.word_bias)

    def rows(self) -> np.ndarray:
        """All parameters, a row of SIZE + 1 for each vector, with its bias or 0."""
        biased = lambda x, bias: np.concatenate([x, bias[:, None]], axis=1)
        none = np.zeros(len(self.last), np.float32)
        return np.concatenate([biased(self.last, none), biased(self.past, none), biased(self.group, self.group_bias), biased(self.word, self.word_bias)])

    def of(self, rows: np.ndarray) -> Model:
        last, past, group, word = np.split(rows.astype(np.float32), np.cumsum([len(self.last), len(self.past), len(self.group)]))
        return Model(last[:, :-1].copy(), past[:, :-1].copy(), group[:, :-1].copy(), group[:, -1].copy(), word[:, :-1].copy(), word[:, -1].copy())


def groups_of(ids: np.ndarray, kept: int) -> np.ndarray:
    """The group of each outcome."""
    return np.where(ids < kept, ids // SPAN, ids + (-(-kept // SPAN) - kept))


def contexts(ids: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, ...]:
    """Of each token: the last one's id, and where the window before it begins and ends, in ids."""
    ends = np.cumsum(sizes)
    first = np.repeat(ends - sizes, sizes)
    at = np.arange(len(ids))
    last = np.where(at > first, ids[np.maximum(at - 1, 0)], start)
    return last, np.maximum(first, at - WINDOW), at


def context_vectors(model: Model, ids: np.ndarray, context: tuple[np.ndarray, ...], a: int, b: int) -> np.ndarray:
    """Of the tokens from a to b; of those before them no more than a window is read."""
    last, begin, end = (x[a:b] for x in context)
    low = max(0, a - WINDOW)
    total = np.zeros((b - low + 1, SIZE))
    np.cumsum(model.past[ids[low:b]], axis=0, out=total[1:])
    mean = (total[end - low] - total[begin - low]) / np.maximum(end - begin, 1)[:, None]
    return model.last[last] + mean.astype(np.float32)


def summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows at each of n places."""
    out, columns = np.empty((n, rows.shape[1]), np.float32), np.ascontiguousarray(rows.T)
    for d in range(rows.shape[1]):
        out[:, d] = np.bincount(at, columns[d], n)
    return out


class Trainer:
    """Noise-contrastive estimation of groups, with noise shared by a step, and of words within their group, with noise of
    each token's own; steps are scaled by past gradients (Adagrad)."""

    NAMES = ("last", "past", "group", "group_bias", "word", "word_bias")

    def __init__(self, model: Model, share: np.ndarray, rate: float = 0.3, seed: int = 11):
        self.model = Model(*(getattr(model, n).copy() for n in self.NAMES))
        self.past = Model(*(np.full_like(getattr(model, n), 1e-3 if n.startswith("word") else 1e-2) for n in self.NAMES))
        kept = model.kept
        self.of = groups_of(np.arange(len(share)), kept)
        mass = np.bincount(self.of, share)
        self.mass, self.ends = np.log(mass).astype(np.float32), np.cumsum(mass)
        self.within, self.rate, self.rng, self.seen = model.word_bias.copy(), rate, np.random.default_rng(seed), 0
        self.within = np.log(share[:kept] / mass[self.of[:kept]]).astype(np.float32)
        own = np.cumsum(share[:kept])
        self.sums, self.lows = own, np.append(0.0, own[SPAN - 1 :: SPAN])
        self.met = [np.zeros(len(getattr(model, n))) for n in ("last", "past", "group", "word")]

    def _move(self, name: str, gradient: np.ndarray) -> None:
        seen = getattr(self.past, name)
        seen += gradient**2
        getattr(self.model, name).__iadd__(self.rate * gradient / np.sqrt(seen))

    def step(self, ids: np.ndarray, context: tuple[np.ndarray, ...], a: int, b: int) -> None:
        m, kept, own = self.model, self.model.kept, ids[a:b]
        last, begin, end = (x[a:b] for x in context)
        r, of, n = context_vectors(m, ids, context, a, b), self.of[own], len(m.group)
        noise = np.minimum(np.searchsorted(self.ends, self.rng.random(NOISE) * self.ends[-1]), n - 1)
        # how far the model's score of a group exceeds the expected number of its noise samples
        vectors, few = m.group[of], np.float32(np.log(NOISE))
        up = 1 / (1 + np.exp(np.einsum("td,td->t", r, vectors) + (m.group_bias - self.mass - few)[of]))
        down = 1 / (1 + np.exp(-(r @ m.group[noise].T + (m.group_bias - self.mass - few)[noise])))
        g = up[:, None] * vectors - down @ m.group[noise]
        group, group_bias = summed(up[:, None] * r, of, n), np.bincount(of, up, n)
        np.subtract.at(group, noise, down.T @ r)
        np.subtract.at(group_bias, noise, down.sum(0))
        moves = [("group", group), ("group_bias", group_bias.astype(np.float32))]
        self.met[2] += np.bincount(of, minlength=n)
        words = np.flatnonzero(own < kept)
        if len(words):
            target, x = own[words], r[words]
            low = self.lows[target // SPAN]
            high = self.sums[np.minimum(target // SPAN * SPAN + SPAN, kept) - 1]
            drawn = low[:, None] + self.rng.random((len(words), OTHERS)) * (high - low)[:, None]
            others = np.clip(np.searchsorted(self.sums, drawn, side="right"), (target // SPAN * SPAN)[:, None], (np.minimum(target // SPAN * SPAN + SPAN, kept) - 1)[:, None])
            offset = m.word_bias - self.within - np.float32(np.log(OTHERS))
            mine, theirs = m.word[target], m.word[others]
            up = 1 / (1 + np.exp(np.einsum("td,td->t", x, mine) + offset[target]))
            down = 1 / (1 + np.exp(-(np.einsum("td,tkd->tk", x, theirs) + offset[others])))
            g[words] += up[:, None] * mine - np.einsum("tk,tkd->td", down, theirs)
            at = np.concatenate([target, others.T.ravel()])
            weight = np.concatenate([up, -down.T.ravel()])
            moves += [("word", summed(weight[:, None] * np.tile(x, (OTHERS + 1, 1)), at, kept)), ("word_bias", np.bincount(at, weight, kept).astype(np.float32))]
            self.met[3] += np.bincount(at, minlength=kept)
        low = max(0, a - WINDOW)
        spread = np.zeros((b - low + 1, SIZE), np.float32)
        each = g / np.maximum(end - begin, 1).astype(np.float32)[:, None]
        spread[end - low] -= each
        whole = end - begin == WINDOW  # their windows begin at places of their own
        spread[begin[whole] - low] += each[whole]
        np.add.at(spread, begin[~whole] - low, each[~whole])
        spread = np.cumsum(spread, axis=0, dtype=np.float64)[:-1]
        moves += [("last", summed(g, last, len(m.last))), ("past", summed(spread, ids[low:b], len(m.past)))]
        self.met[0] += np.bincount(last, minlength=len(m.last))
        self.met[1] += np.bincount(ids[low:b], minlength=len(m.past))
        for name, x in moves:
            self._move(name, x * np.float32(32 / len(own)))
        self.seen += len(own)

    def learn(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Steps of about STEP tokens each over all texts."""
        context = contexts(ids, sizes, len(self.model.last) - 1)
        for a in range(0, len(ids), STEP):
            self.step(ids, context, a, min(a + STEP, len(ids)))


def log_probabilities(model: Model, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural logarithm of each token's outcome's probability in its context."""
    out, context = np.empty(len(ids), np.float64), contexts(ids, sizes, len(model.last) - 1)
    longest = lambda x: np.sqrt(np.einsum("td,td->t", x, x).max()) if len(x) else 0.0
    reach, of = max(longest(model.group), longest(model.word)), groups_of(np.arange(len(model.last)), model.kept)
    for a in range(0, len(ids), SLAB):
        own = ids[a : a + SLAB]
        r = context_vectors(model, ids, context, a, a + len(own))
        far = longest(r) * reach > 60  # far from what training gives; an exponential could overflow
        group = of[own]
        log = np.einsum("td,td->t", r, model.group[group]) + model.group_bias[group]
        for at in range(0, len(own), ROOM):
            log[at : at + ROOM] -= total(r[at : at + ROOM], model.group, model.group_bias, far)
        words = np.flatnonzero(own < model.kept)
        words = words[np.argsort(group[words], kind="stable")]
        begins = np.flatnonzero(np.append(True, group[words][1:] != group[words][:-1])) if len(words) else []
        for k, to in zip(begins, [*begins[1:], len(words)]):
            some = words[k:to]
            low = group[some[0]] * SPAN
            x, vectors, bias = r[some], model.word[low : low + SPAN], model.word_bias[low : low + SPAN]
            log[some] += np.einsum("td,td->t", x, vectors[own[some] - low]) + bias[own[some] - low] - total(x, vectors, bias, far)
        out[a : a + len(own)] = log
    return out


def total(r: np.ndarray, vectors: np.ndarray, bias: np.ndarray, far: bool) -> np.ndarray:
    """Logarithm of the sum of the exponentials of all scores, for each context."""
    scores = r @ vectors.T
    top = scores.max(axis=1) if far else 0.0
    if far:
        scores -= top[:, None]
    np.exp(scores, out=scores)
    return np.log(scores @ np.exp(bias)) + top


def word_counts(docs: DataFrame) -> DataFrame:
    """word and count of all tokens of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", 16_000_000):
            tokens, _ = tokens_of(batch.column("text"))
            found = tokens.value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    found = with_package(docs.select("text")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("c"))


def head_of(counts: DataFrame, words: int = WORDS, head: int = HEAD, least: int = LEAST) -> Head:
    """What every task knows of the counts: ``head`` words and sums; nothing here grows with the corpus."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    got = counts.orderBy(F.desc("c"), "word").limit(head).toArrow()
    names, numbers = got["word"].combine_chunks(), got["c"].to_numpy()
    names = names if isinstance(names, pa.StringArray) else pa.array(got["word"].to_pylist(), pa.string())
    kept = min(words, int((numbers >= least).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = class_of(batch.column("word"))
            n = np.bincount(of, weights=batch.column("c").to_numpy() + 0.5, minlength=CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n)], names=["class", "n"])

    sums = with_package(counts.select("word", "c")).mapInArrow(run, "class bigint, n double").groupBy("class").sum("n").collect()
    mass = np.full(CLASSES, 0.5)  # of a class's words never seen
    for k, n in sums:
        mass[k] += n
    np.subtract.at(mass, class_of(names.slice(0, kept)), numbers[:kept] + 0.5)
    share = np.append(numbers[:kept] + 0.5, mass)
    return Head(names, numbers, kept, total, distinct, mass, share / share.sum())


def coded(docs: DataFrame, head: Head, mod: int, out_of: int) -> DataFrame:
    """A row for each text: outcomes of its tokens, what the head's counts give of its scores, its words outside the head.

    key is a number of the row, fixed once the table is written. base: logarithms of the head words' counts; share:
    of their shares of their classes, and of the classes' masses for the others.
    """
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent.value
        made, task = 0, TaskContext.get().partitionId()
        weight = np.append(np.log10(head.counts + 0.5), 0.0)  # the last: of words outside the head
        within = np.append(np.zeros(head.kept), np.log10(head.mass))
        for batch in text_chunks(batches, "text"):
            tokens, n = tokens_of(batch.column("text"))
            own, place = head.outcomes(tokens)
            ends = np.cumsum(n)
            total = lambda x: np.diff(np.append(0, np.cumsum(x)[ends - 1]))  # noqa: E731, B023
            # a class word's share: (c + 0.5) / mass; c of words outside the head comes with a join
            share = np.where(own >= head.kept, weight[place] - within[own], 0.0)
            tail = place < 0
            lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)
            keys = (task << 40) + made + np.arange(len(n))
            made += len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column("doc_id"), batch.column("held_out"), pa.array(total(~tail).astype(np.int64)), pa.array(total(weight[place])), pa.array(total(share)), lists(n, pa.array(own.astype(np.int16))), lists(total(tail), tokens.filter(pa.array(tail)))],
                names=["key", "doc_id", "held_out", "n_head", "base", "share", "ids", "tail"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (remainder("doc_id", mod) == out_of).alias("held_out"))
    return with_package(rows).mapInArrow(run, "key bigint, doc_id bigint, held_out boolean, n_head bigint, base double, share double, ids array<smallint>, tail array<string>")


def ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The outcomes of all texts of a batch, and how many each text has."""
    ids = batch.column("ids")
    return ids.flatten().to_numpy().astype(np.int64), pc.list_value_length(ids).to_numpy().astype(np.int64)


def train(texts: DataFrame, share: np.ndarray, kept: int, passes: int = 1) -> Model:
    """What tasks learn from all their texts (ids array<smallint>), ``passes`` times, each vector as a weighted mean."""
    model = Model.start(share, kept)
    for k in range(passes):
        sent = texts.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, seed=11 + k) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(sent.value, share, seed=seed)
            for batch in batches:
                trainer.learn(*ids_of(batch))
            times = np.concatenate(trainer.met)
            met = np.flatnonzero(times)
            rows = trainer.model.rows()[met].astype(np.float64) * times[met, None]
            yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(np.ascontiguousarray(rows[:, d])) for d in range(SIZE + 1)), pa.array(times[met])], names=["row", *VALUES, "n"])

        got = with_package(texts.select("ids")).mapInArrow(run, f"row bigint, {', '.join(f'{v} double' for v in VALUES)}, n double")
        got = got.groupBy("row").agg(*(F.sum(v).alias(v) for v in VALUES), F.sum("n").alias("n")).toArrow()
        rows = model.rows().astype(np.float64)
        rows[got["row"].to_numpy()] = np.stack([got[v].to_numpy() for v in VALUES], axis=1) / got["n"].to_numpy()[:, None]
        model = model.of(rows)
    return model


VALUES = [f"v{d}" for d in range(SIZE + 1)]


def model_logs(texts: DataFrame, model: Model) -> DataFrame:
    """key and logs, the sum of the model's log10 probabilities of each text's outcomes."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = ids_of(batch)
            if len(n):
                total = np.append(0, np.cumsum(log_probabilities(sent.value, ids, n)))
                ends = np.cumsum(n)
                kept = [batch.column(c) for c in KEPT]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n), pa.array((total[ends] - total[ends - n]) / np.log(10))], names=[*KEPT, "n_tokens", "logs"])

    schema = "key bigint, doc_id bigint, held_out boolean, n_head bigint, base double, share double, n_tokens bigint, logs double"
    return with_package(texts.select(*KEPT, "ids")).mapInArrow(run, schema)


KEPT = ["key", "doc_id", "held_out", "n_head", "base", "share"]


def rest_of(found: DataFrame, counts: DataFrame) -> DataFrame:
    """key, more (the sum of the logarithms of smoothed counts) and n_tail (known words) of the texts' words that tasks do not count."""
    words = found.select("key", F.explode("tail").alias("word")).join(counts, "word", "left")
    return words.groupBy("key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("n_tail"))


def told(head: Head) -> list:
    """held_out, n_tokens, n_known, train_tokens and base_score, of texts with their rest."""
    return [
        F.col("held_out"), F.col("n_tokens"), (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(head.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(head.total + 0.5 * (head.distinct + 1)))).alias("base_score"),
    ]


def score(found: DataFrame, counts: DataFrame, head: Head, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each text of ``coded``."""
    score = F.col("logs") + F.col("share") + F.coalesce("more", F.lit(0.0))
    return model_logs(found, model).join(rest_of(found, counts), "key", "left").select("doc_id", *told(head), score.alias("score"))


def base_scores(docs: DataFrame, mod: int = 5, out_of: int = 1) -> DataFrame:
    """The columns of ``score_documents`` but the model's score, without the training that only that score needs."""
    counts = written(word_counts(docs.where(remainder("doc_id", mod) != out_of)), "counts")
    head = head_of(counts)
    found = coded(docs, head, mod, out_of).withColumn("n_tokens", F.size("ids").cast("bigint")).select("key", "doc_id", "held_out", "n_head", "base", "n_tokens", "tail")
    found = written(found, "coded")
    return found.join(rest_of(found, counts), "key", "left").select("doc_id", *told(head))


def score_documents(docs: DataFrame, mod: int = 5, out_of: int = 1) -> DataFrame:
    """Learns from the documents whose fold is not ``out_of`` and scores all."""
    training = docs.where(remainder("doc_id", mod) != out_of)
    counts = written(word_counts(training), "counts")
    head = head_of(counts)
    found = written(coded(docs, head, mod, out_of), "coded")
    return score(found, counts, head, train(found.where("not held_out"), head.share, head.kept))

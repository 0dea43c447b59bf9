"""Hidden Markov language model over words: Baum-Welch on all training text, exact scaled forward scores.

The most frequent words are symbols of their own; every other word belongs to the symbol of its last
letters, inside which it has its share of the training counts (one more for each, and one for all
unseen words).  States emit symbols, so the model is a proper distribution over texts of any words,
and its size does not grow with the corpus.  What is gathered from the corpus (word counts,
Baum-Welch counts) covers all training rows and is summed by Spark.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, shared_folder, words_of

STATES, ROUNDS = 8, 6
#: Words with a symbol of their own; words whose counts every task holds (others are joined); symbols of word endings.
OWN, FREQUENT, ENDINGS = 4_000, 60_000, 509
#: Words of a training sequence; longer texts are several sequences.
SEGMENT = 256
#: Tokens that one forward or backward pass holds, about.
HELD = 400_000
#: Weight of the corpus-wide distribution in a state's emissions.
PRIOR = 200.0
END = b""


def ending(word: bytes) -> int:
    """Symbol class of a word by its last three bytes."""
    return zlib.crc32(word[-3:]) % ENDINGS


# ------------------------------------------------------------------ counts


def word_counts(train: DataFrame) -> DataFrame:
    """word (binary; empty: the end of a text) and c over ``train`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                seen[END] += 1
                if len(seen) > 400_000:
                    yield _counts(seen)
                    seen = Counter()
        if seen:
            yield _counts(seen)

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])


class Vocabulary:
    """Frequent words with their counts, and the symbols with their shares."""

    def __init__(self, frequent: list[tuple[bytes, int]], tokens: int, distinct: int, class_counts: np.ndarray, class_words: np.ndarray) -> None:
        own = [w for w, _ in frequent if w != END][:OWN]
        self.symbol_of = {w: k + 1 for k, w in enumerate(own)}  # symbol 0: the end
        self.first = len(own) + 1
        self.symbols = self.first + ENDINGS
        self.code = {w: k for k, (w, _) in enumerate(frequent)}
        self.counts = np.asarray([c for _, c in frequent], np.float64)
        self.symbol = np.asarray([self.symbol_of.get(w, 0 if w == END else self.first + ending(w)) for w, _ in frequent], np.int64)
        self.tokens, self.distinct = tokens, distinct
        # What is left of a class once the words with own symbols are out; one share for unseen words.
        in_class = class_counts.copy(), class_words.copy()
        for w, c in frequent:
            if w in self.symbol_of:
                k = ending(w)
                in_class[0][k] -= c
                in_class[1][k] -= 1
        self.class_size = in_class[0] + in_class[1] + 1.0
        self.weights = np.zeros(self.symbols)
        for w, c in frequent:
            if w in self.symbol_of:
                self.weights[self.symbol_of[w]] = c
            elif w == END:
                self.weights[0] = c
        self.weights[self.first :] = in_class[0]
        self.weights = (self.weights + 0.5) / (self.weights + 0.5).sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Vocabulary of a count table: its head and the sums of each ending reach the driver."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words = np.zeros(ENDINGS), np.zeros(ENDINGS)
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if w != END:
                    k = ending(w)
                    n[k] += c
                    words[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(ENDINGS), pa.int64()), pa.array(n.astype(np.int64)), pa.array(words.astype(np.int64))], ["k", "n", "words"])

    n, words = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counts.mapInArrow(classes, "k long, n long, words long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        n[r.k], words[r.k] = r.n, r.words
    head = [(bytes(r.word), r.c) for r in counts.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()]
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return Vocabulary(head, tokens, distinct, n, words)


# ------------------------------------------------------------------ sequences


_SEQUENCES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, all_log double, class_log double, symbols binary, rare array<struct<word: binary, n: int>>"


def encode(docs: DataFrame, vocab) -> DataFrame:
    """Symbols of every document (doc_id, text, held_out), what its frequent words add to the scores, and its rarer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = vocab.value
        row = TaskContext.get().partitionId() << 33
        get = v.code.get
        logs, own = np.log10(v.counts + 1), v.symbol < v.first
        sizes = np.log10(v.class_size)
        known_end = END in v.code
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                out: list[list] = [[] for _ in range(9)]
                for doc, text, held in zip(*(c.to_pylist() for c in part.columns)):
                    words = words_of(text)
                    code = np.asarray([get(w, -1) for w in words], np.int64)
                    new = np.flatnonzero(code < 0)
                    rare = [words[k] for k in new.tolist()]
                    seen = code[code >= 0]
                    symbols = np.empty(len(code) + 1, np.int64)
                    symbols[:-1] = v.symbol[code] if len(v.symbol) else 0
                    if rare:
                        symbols[new] = [v.first + ending(w) for w in rare]
                    symbols[-1] = 0
                    in_class = symbols[symbols >= v.first] - v.first
                    every = float(logs[seen].sum()) + (float(logs[v.code[END]]) if known_end else 0.0)
                    shared = float(logs[seen[~own[seen]]].sum()) - float(sizes[in_class].sum())
                    values = (row, doc, held, len(symbols), len(seen) + known_end, every, shared, symbols.astype("<u2").tobytes(), [{"word": w, "n": n} for w, n in Counter(rare).items()])
                    for column, value in zip(out, values):
                        column.append(value)
                    row += 1
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), kind]
                names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "all_log", "class_log", "symbols", "rare"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(run, _SEQUENCES)


def _side_by_side(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, symbols by step, sequences still running at each step) of groups of like lengths, longest first."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, len(sequences[order[at]]))
        group = order[at : at + max(1, HELD // longest)]
        lengths = np.asarray([len(sequences[k]) for k in group])
        symbols = np.zeros((longest, len(group)), np.int64)
        for j, k in enumerate(group):
            symbols[: lengths[j], j] = sequences[k]
        running = np.searchsorted(-lengths, -np.arange(longest), "left")  # lengths above the step
        yield group, symbols, running
        at += len(group)


class Model:
    """Parameters: start (K), move (K x K), emit (symbols x K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(vocab: Vocabulary) -> "Model":
        rng = np.random.default_rng(11)
        emit = vocab.weights[:, None] * rng.gamma(0.7, 1.0, (vocab.symbols, STATES)) + vocab.weights[:, None] * 0.2
        move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence by the scaled forward recursion."""
        out = np.zeros(len(sequences))
        for group, symbols, running in _side_by_side(sequences):
            total = np.zeros(len(group))
            a = np.broadcast_to(self.start, (len(group), STATES))
            for t, n in enumerate(running):
                a = (a[:n] @ self.move if t else a[:n]) * self.emit[symbols[t, :n]]
                scale = a.sum(axis=1)
                a = a / scale[:, None]
                total[:n] += np.log10(scale)
            out[group] = total
        return out

    def expect(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts (start, move, emit) of the sequences, and their natural log likelihood."""
        start, move, emit, likelihood = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(self.emit), STATES)), 0.0
        for group, symbols, running in _side_by_side(sequences):
            steps, width = symbols.shape
            alpha, scale = np.zeros((steps, width, STATES)), np.ones((steps, width))
            for t, n in enumerate(running):
                a = (alpha[t - 1, :n] @ self.move if t else self.start) * self.emit[symbols[t, :n]]
                scale[t, :n] = a.sum(axis=1)
                alpha[t, :n] = a / scale[t, :n, None]
            likelihood += float(np.log(scale).sum())
            beta = np.ones((width, STATES))
            for t in range(steps - 1, -1, -1):
                n = running[t]
                if t:
                    back = self.emit[symbols[t, :n]] * beta[:n] / scale[t, :n, None]
                    move += alpha[t - 1, :n].T @ back
                alpha[t, :n] *= beta[:n]
                if t:
                    beta[:n] = back @ self.move.T
            start += alpha[0].sum(axis=0)
            flat = symbols.reshape(-1)
            for k in range(STATES):
                emit[:, k] += np.bincount(flat, alpha[:, :, k].reshape(-1), len(emit))
        return start, move * self.move, emit, likelihood

    @staticmethod
    def of(counts: np.ndarray, vocab: Vocabulary) -> "Model":
        start, move, emit = counts[:STATES] + 0.1, counts[STATES : STATES + STATES**2].reshape(STATES, STATES) + 0.1, counts[STATES + STATES**2 :].reshape(-1, STATES)
        emit = emit + PRIOR * vocab.weights[:, None]
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(sequences: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows (symbols): tasks add up their counts, Spark adds those of the tasks."""
    spark = sequences.sparkSession
    model = Model.first(vocab)
    size = STATES + STATES**2 + vocab.symbols * STATES
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, held, n = np.zeros(size), [], 0

            def flush():
                nonlocal held, n, total
                start, move, emit, _ = shared.value.expect(held)
                total += np.concatenate([start, move.reshape(-1), emit.reshape(-1)])
                held, n = [], 0

            for batch in batches:
                for x in batch.column(0):
                    own = np.frombuffer(x.as_py(), "<u2").astype(np.int64)
                    held += [own[k : k + SEGMENT] for k in range(0, len(own), SEGMENT)]
                    n += len(own)
                    if n > 8 * HELD:
                        flush()
            if held:
                flush()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["k", "n"])

        found = sequences.select("symbols").mapInArrow(run, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # a row per parameter at most
        counts = np.zeros(size)
        counts[found["k"].to_numpy()] = found["n"].to_numpy()
        model = Model.of(counts, vocab)
        shared.unpersist()
    return model


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document (doc_id, text, held_out).

    The model learns from the rows that are not held out.  A text's tokens are its words (A-Z
    lower-cased, between ASCII white space) and one end; null and empty texts are the end alone.
    base_score adds the log10 of each token's add-one share of the training tokens; score is the
    log10 probability of the text under the hidden Markov model.  Without training rows both tables
    are empty and every count is 0.  Repeated rows are scored alike.
    """
    spark = docs.sparkSession
    counts = materialize(word_counts(docs.where("not held_out")), "counts")
    vocab = vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocab)  # at most FREQUENT words
    path = shared_folder(spark, "sequences")
    encode(docs, shared).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(_SEQUENCES).parquet(path)
    model = train(rows.where("not held_out"), vocab)
    fitted = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = [np.frombuffer(x.as_py(), "<u2").astype(np.int64) for x in batch.column(7)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(fitted.value.score(sequences))], [*_NAMES, "forward"])

    scored = rows.select(*_NAMES, "symbols").mapInArrow(run, _SEQUENCES.rsplit(", symbols", 1)[0] + ", forward double")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    added = rare.join(counts.hint("merge"), "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("n").alias("rare_known"))
    below = math.log10(vocab.tokens + vocab.distinct + 1)
    joined = scored.join(added.hint("merge"), "row", "left").withColumn("more", F.coalesce("rare_log", F.lit(0.0)))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("all_log") + F.col("more") - F.col("n_tokens") * below).alias("base_score"), (F.col("forward") + F.col("class_log") + F.col("more")).alias("score"),
    )


_NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "all_log", "class_log"]

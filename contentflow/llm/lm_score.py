"""Masked pseudo-likelihood scores of documents.

A window network predicts every word from the words on both of its sides, never from the word itself:
h = tanh(b + sum over the places o of the window of E[word at o] * P[o]), and the word's chance is that of its
class times that within the class, both by a softmax over h. A document's score is the sum of the logarithms of
these conditional chances over all of its words.

The words are counted over all documents. Those outside the vocabulary fall into hashed buckets, which are words of the
model too; the chance of such a word is that of its bucket times its share of the bucket's count. Counts of frequent
words are at hand in every task, all others are joined from the count table. Training goes over all documents in parallel: each worker starts from the common weights, takes Adagrad
steps on its part, and the weights are averaged, by positions, in a shuffle of fixed size for each worker; only
the average comes to the driver. Every word of every document is a target once, a quarter of them in each round. The
documents' word numbers are written once and read by every round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.llm.common import pieces, read, save, span_hashes, text_bytes, word_spans

CLASSES, MEMBERS = 64, 64
BUCKETS = 512  # hashed words outside the vocabulary
NEAR_SHARE = 1_000_000  # words with over 1 / NEAR_SHARE of the corpus, so fewer than NEAR_SHARE, are at hand in every task
VOCABULARY = CLASSES * MEMBERS - BUCKETS
PAD = CLASSES * MEMBERS
SIDE = 3  # words on either side
WIDTH = 24
STRIDE = 4  # a round trains on every STRIDE-th position of every document, another one each round
ROUNDS = STRIDE  # every position is a target once
STEP_POSITIONS = 16_384
RATE = 0.08
SCORE_POSITIONS = 32_768
CHUNK = 4096  # weights of a row on their way to the average
MERGE_WORDS = 2_000_000  # distinct words that a counting task holds before it passes them on
OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]

# ---- network -------------------------------------------------------------------------------


@dataclass
class Network:
    embed: np.ndarray  # (PAD + 1, WIDTH)
    place: np.ndarray  # (2 SIDE, WIDTH)
    bias: np.ndarray  # (WIDTH,)
    to_class: np.ndarray  # (WIDTH, CLASSES)
    class_bias: np.ndarray
    to_member: np.ndarray  # (CLASSES, WIDTH, MEMBERS)
    member_bias: np.ndarray  # (CLASSES, MEMBERS)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.place, self.bias, self.to_class, self.class_bias, self.to_member, self.member_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at: at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*out)


def new_network(counts: np.ndarray, seed: int = 11) -> Network:
    """Small random weights; the biases give every word its share of the corpus."""
    rng = np.random.default_rng(seed)
    share = (counts.reshape(MEMBERS, CLASSES).T + 1.0)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    embed = small(PAD + 1, WIDTH)
    return Network(embed, np.ones((2 * SIDE, WIDTH), np.float32), np.zeros(WIDTH, np.float32), small(WIDTH, CLASSES),
                   np.log(share.sum(axis=1) / share.sum()).astype(np.float32), small(CLASSES, WIDTH, MEMBERS),
                   np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32))


def hidden(net: Network, context: np.ndarray) -> np.ndarray:
    """(positions, WIDTH) from the words around, (2 SIDE, positions)."""
    out = np.take(net.embed * net.place[0] + net.bias, context[0], axis=0)
    for o in range(1, 2 * SIDE):
        out += np.take(net.embed * net.place[o], context[o], axis=0)
    return np.tanh(out, out=out)


def _log_totals(x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Logarithm of the sum of exp(x) of each row and, with ``keep``, the softmax. ``x`` is used up."""
    top = x.max()
    shift = top if top - x.min() < 60 else x.max(axis=1, keepdims=True)  # one shift for all rows if none can vanish
    x -= shift
    np.exp(x, out=x)
    total = x.sum(axis=1)
    if keep:
        x /= total[:, None]
    return np.log(total) + np.squeeze(shift), x if keep else None


def by_class(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order that brings the words of a class together, and the run of each class in it; word w is member
    w // CLASSES of class w % CLASSES."""
    kinds = (words % CLASSES).astype(np.uint8)
    order = np.argsort(kinds, kind="stable")
    edges = np.searchsorted(kinds[order], np.arange(CLASSES + 1))
    return order, [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]]


def log_chances(net: Network, words: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Logarithm of each word's chance given the words around it."""
    order, runs = by_class(words)
    h, w = hidden(net, context[:, order]), words[order]
    x = h @ net.to_class + net.class_bias
    found = x[np.arange(len(w)), w % CLASSES].astype(np.float64)
    found -= _log_totals(x)[0]
    for c, run in runs:
        x = h[run] @ net.to_member[c] + net.member_bias[c]
        found[run] += x[np.arange(len(x)), w[run] // CLASSES]
        found[run] -= _log_totals(x)[0]
    out = np.empty(len(w))
    out[order] = found
    return out


def gradient(net: Network, words: np.ndarray, context: np.ndarray) -> Network:
    """Gradient of the mean negative log chance."""
    order, runs = by_class(words)
    w, around, n = words[order], context[:, order], len(words)
    h = hidden(net, around)
    d = _log_totals(h @ net.to_class + net.class_bias, keep=True)[1]
    d[np.arange(n), w % CLASSES] -= 1
    d /= n
    to_class, class_bias, dh = h.T @ d, d.sum(axis=0), d @ net.to_class.T
    to_member, member_bias = np.zeros_like(net.to_member), np.zeros_like(net.member_bias)
    for c, run in runs:
        d = _log_totals(h[run] @ net.to_member[c] + net.member_bias[c], keep=True)[1]
        d[np.arange(len(d)), w[run] // CLASSES] -= 1
        d /= n
        to_member[c], member_bias[c] = h[run].T @ d, d.sum(axis=0)
        dh[run] += d @ net.to_member[c].T
    dh *= 1 - h * h
    sums = np.empty((WIDTH, 2 * SIDE, PAD + 1))  # of dh by place and the word there
    for k, d in enumerate(np.ascontiguousarray(dh.T, np.float64)):
        for o in range(2 * SIDE):
            sums[k, o] = np.bincount(around[o], d, PAD + 1)
    place = np.einsum("wk,kow->ok", net.embed, sums).astype(np.float32)
    embed = np.einsum("kow,ok->wk", sums, net.place).astype(np.float32)
    return Network(embed, place, dh.sum(axis=0), to_class, class_bias, to_member, member_bias)


class Trainer:
    """Adagrad on one worker."""

    def __init__(self, net: Network):
        self.net = net.filled(net.flat())
        self.seen = [np.full(p.shape, 1e-4, np.float32) for p in self.net.parts()]
        self.positions = 0

    def step(self, words: np.ndarray, context: np.ndarray) -> None:
        for p, g, s in zip(self.net.parts(), gradient(self.net, words, context).parts(), self.seen):
            s += g * g
            p -= RATE * g / np.sqrt(s)
        self.positions += len(words)


# ---- word numbers --------------------------------------------------------------------------


def word_numbers(hashes: np.ndarray, vocabulary: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Model words of word hashes; ``vocabulary`` is sorted, ``numbers`` are the words' numbers in that order."""
    out = VOCABULARY + (hashes % np.uint64(BUCKETS)).astype(np.int64)
    if len(vocabulary):
        k = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        found = vocabulary[k] == hashes
        out[found] = numbers[k[found]]
    return out.astype(np.uint16)


def windows(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end with PAD between them, the places of their words there, and the text of each word."""
    gap = np.full(SIDE, PAD, np.int64)
    joined = np.concatenate([gap, *[x for t in lists for x in (t.astype(np.int64), gap)]])
    sizes = np.array([len(t) for t in lists], np.int64)
    first = SIDE + np.cumsum(sizes + SIDE) - sizes - SIDE
    return joined, np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), np.repeat(np.arange(len(lists)), sizes)


def targets(at: np.ndarray, text: np.ndarray, turn: int) -> np.ndarray:
    """Places that a round predicts; any STRIDE rounds in a row have each place once."""
    first = np.searchsorted(text, np.arange(text[-1] + 1), "left") if len(text) else text
    return at[(np.arange(len(at)) - first[text]) % STRIDE == turn % STRIDE]


def context_of(joined: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([joined[at + o] for o in OFFSETS])


# ---- jobs ----------------------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """(word hash, count) over all texts; each task adds up what it has before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(words.view(np.int64)), "n": pa.array(counts)})

        for batch in pieces(batches, "text"):
            low, starts, ends, _ = word_spans(*text_bytes(batch.column("text")))
            new, n = np.unique(span_hashes(low, starts, ends), return_counts=True)
            every, index = np.unique(np.concatenate([words, new]), return_inverse=True)
            words, counts = every, np.bincount(index, weights=np.concatenate([counts, n]), minlength=len(every)).astype(np.int64)
            if len(words) > MERGE_WORDS:
                yield out()
                words, counts = words[:0], counts[:0]
        yield out()

    return docs.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """What a task needs of the counts: vocabulary and near words sorted by hash, logarithms of their counts."""

    vocabulary: np.ndarray
    numbers: np.ndarray  # model words of the vocabulary
    near: np.ndarray
    near_logs: np.ndarray
    bucket_logs: np.ndarray  # of the words outside the vocabulary together


NUMBERED = "key bigint, id bigint, words binary, within double, far array<bigint>"


def number_words(docs: DataFrame, counts: Counts) -> DataFrame:
    """Each text (id, text) as 16-bit word numbers, written once, with a key of its own. For the words outside the
    vocabulary, within sums the logarithms of their shares of their buckets, but without the counts of the words in far."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in pieces(batches, "text"):
            n = batch.num_rows
            low, starts, ends, before = word_spans(*text_bytes(batch.column("text")))
            hashes = span_hashes(low, starts, ends)
            w = word_numbers(hashes, c.vocabulary, c.numbers)
            outside = np.flatnonzero(w >= VOCABULARY)
            text, rare = np.searchsorted(before, outside, "right") - 1, hashes[outside]
            logs, is_far = -c.bucket_logs[w[outside] - VOCABULARY], np.ones(len(rare), bool)
            if len(c.near):
                k = np.minimum(np.searchsorted(c.near, rare), len(c.near) - 1)
                is_far = c.near[k] != rare
                logs += np.where(is_far, 0, c.near_logs[k])
            far = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[is_far], np.arange(n + 1)), pa.int32()), pa.array(rare[is_far].view(np.int64)))
            yield pa.record_batch([batch.column("key"), batch.column("id"), pa.array([w[a:b].tobytes() for a, b in zip(before[:-1].tolist(), before[1:].tolist())], pa.binary()),
                                   pa.array(np.bincount(text, weights=logs, minlength=n).astype(np.float64)), far], names=["key", "id", "words", "within", "far"])

    return save(docs.select(F.monotonically_increasing_id().alias("key"), "id", "text").mapInArrow(run, NUMBERED), "lm-words")


def _lists(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def _groups(batches: Iterator[pa.RecordBatch], limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``limit`` bytes of word numbers, or one text."""
    for batch in batches:
        sizes = np.array([len(x) for x in _lists(batch.column("words"))], np.int64) * 2
        reached, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = reached[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(reached, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def train_round(numbered: DataFrame, net: Network, turn: int) -> Network:
    """One pass over all documents by as many workers as there are cores; their weights are averaged."""
    spark = numbered.sparkSession
    shared = spark.sparkContext.broadcast(net.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(net_shape.filled(shared.value))
        for batch in _groups(batches):
            joined, at, text = windows(_lists(batch.column("words")))
            if not len(at):
                continue
            at = np.random.default_rng(turn).permutation(targets(at, text, turn))
            for k in range(0, len(at), STEP_POSITIONS):
                some = at[k: k + STEP_POSITIONS]
                trainer.step(joined[some], context_of(joined, some))
        if trainer.positions:
            flat = trainer.net.flat()
            parts = [flat[k: k + CHUNK].tobytes() for k in range(0, len(flat), CHUNK)]
            yield pa.record_batch({"chunk": pa.array(range(len(parts)), pa.int32()), "positions": [trainer.positions] * len(parts), "weights": pa.array(parts, pa.binary())})

    def average(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["positions"].to_pylist(), table["weights"].to_pylist()))
        total = sum(n for n, _ in rows)
        mean = sum(np.frombuffer(w, np.float32).astype(np.float64) * (n / total) for n, w in rows).astype(np.float32)
        return pa.table({"chunk": table["chunk"][:1], "positions": pa.array([total], pa.int64()), "weights": pa.array([mean.tobytes()], pa.binary())})

    kind = "chunk int, positions bigint, weights binary"
    net_shape = Network(*[np.zeros(p.shape, np.float32) for p in net.parts()])
    workers = max(1, spark.sparkContext.defaultParallelism)
    got = numbered.select("words").coalesce(workers).mapInArrow(run, kind).groupBy("chunk").applyInArrow(average, kind).collect()  # one network
    if not got:
        return net
    return net.filled(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(got, key=lambda r: r["chunk"])]))


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Network, DataFrame, DataFrame]:
    """The network, the documents (id, text) as word numbers, and the counts of all words (word hash, n)."""
    counts = save(count_words(docs), "lm-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    rest = counts.groupBy(F.pmod(F.col("word"), F.lit(BUCKETS)).cast("int").alias("b")).agg(F.sum("n").alias("n")).collect()
    size = np.zeros(PAD)
    size[: len(top)] = [r["n"] for r in top]
    for r in rest:
        size[VOCABULARY + r["b"]] += r["n"]
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    size[VOCABULARY:] -= np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), weights=size[: len(top)], minlength=BUCKETS)
    order = np.argsort(hashes)
    near = counts.filter(F.col("n") > sum(r["n"] for r in rest) / NEAR_SHARE).toArrow()
    near_hashes, near_counts = near["word"].to_numpy().view(np.uint64), near["n"].to_numpy()
    by_hash = np.argsort(near_hashes)
    numbered = number_words(docs, Counts(hashes[order], order, near_hashes[by_hash], np.log(near_counts[by_hash]), np.log(np.maximum(size[VOCABULARY:], 1))))
    net = new_network(size)
    for turn in range(rounds):
        net = train_round(numbered, net, turn)
    return net, numbered, counts


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Network, DataFrame]:
    """The network, and the documents (id, text) as word numbers."""
    return fit(docs, rounds)[:2]


def score_words(numbered: DataFrame, net: Network) -> DataFrame:
    """(key, id, n_words, log_likelihood) of each document as words of the model: one outside the vocabulary has the
    chance of its bucket. within is passed on."""
    shared = numbered.sparkSession.sparkContext.broadcast(net.flat())
    shape = Network(*[np.zeros(p.shape, np.float32) for p in net.parts()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shape.filled(shared.value)
        for batch in _groups(batches):
            joined, at, text = windows(_lists(batch.column("words")))
            total = np.zeros(batch.num_rows)
            for k in range(0, len(at), SCORE_POSITIONS):
                some = at[k: k + SCORE_POSITIONS]
                total += np.bincount(text[k: k + SCORE_POSITIONS], weights=log_chances(mine, joined[some], context_of(joined, some)), minlength=batch.num_rows)
            yield pa.record_batch([batch.column("key"), batch.column("id"), pa.array(np.bincount(text, minlength=batch.num_rows)), pa.array(total), batch.column("within")],
                                  names=["key", "id", "n_words", "log_likelihood", "within"])

    return numbered.drop("far").mapInArrow(run, "key bigint, id bigint, n_words bigint, log_likelihood double, within double")


def far_logs(numbered: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, far_log): sum of the logarithms of the counts of the words in far. No such word has over 1 / NEAR_SHARE of
    all words, so none is hot; a word that isn't in the join has a count of 1."""
    words = numbered.select("key", F.explode("far").alias("word"))
    return words.join(counts.filter("n > 1"), "word").groupBy("key").agg(F.sum(F.log("n")).alias("far_log"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_words, log_likelihood (sum over its words), mean_log_likelihood.

    A null text or one without words has 0 words, log_likelihood 0 and a null mean. Repeated rows are scored each,
    null ids are kept, other columns aren't read. Without any words no training takes place."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    net, numbered, counts = fit(rows)
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    of_words = F.col("log_likelihood") + F.col("within") + F.coalesce(F.col("far_log"), F.lit(0.0))
    return score_words(numbered, net).join(far_logs(numbered, counts), "key", "left").select(
        "id", "n_words", of_words.alias("log_likelihood")).withColumn("mean_log_likelihood", mean)


def op1(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

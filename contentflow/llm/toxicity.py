"""Toxicity by weak supervision.

1. Lexicons: words and word beginnings that are significantly more frequent in texts labelled toxic, found on a
   bounded sample of labelled training rows.
2. Voters: the lexicons are dealt to several voters, pattern voters look at number, density and place of the hits
   and at the shape of the text. A voter says toxic, clean or nothing.
3. Label model: the votes of all documents are counted by vote pattern. EM over these counts estimates how often
   each voter says what in either class, and which voters agree beyond what the class explains; such voters count
   less in the posterior.
4. A logistic regression on the single lexicon entries and patterns is trained on the posterior labels, and
   scores every text.

Texts are read once to find entries and hits; what is kept of a text is one bit for each entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.llm.common import mix, pieces, read, save, span_hashes, text_bytes, word_spans

FIT_ROWS = 30_000  # labelled training rows that lexicons and classifier are fitted on
ENTRIES = 512  # lexicon entries kept
CANDIDATES = 4096  # entries among which those are chosen
CHANCE_ENTRIES = 1.0  # entries that chance alone may bring
BEGINNINGS = (4, 5, 6)  # bytes of a word beginning
LEXICON_VOTERS = 8
NOISE = 0.1  # correlations of votes below this count as none
THRESHOLD = 0.3
HELD_OUT = 2  # remainder of crc32(doc_id as text) by 4 whose labels are never read

# ---- features ------------------------------------------------------------------------------


def entry_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes) for whole words of three bytes or more and for each length of word beginning."""
    size = ends - starts
    out = []
    for k in (0, *BEGINNINGS):
        at = np.flatnonzero(size >= 3 if k == 0 else size > k)
        h = span_hashes(low, starts[at], ends[at] if k == 0 else starts[at] + k)
        out.append((at, mix(h + np.uint64(k))))
    return out


def text_features(texts: pa.Array, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted entries each text has, and its measures: hit words, words, whether the hits lie in both
    halves, doubled exclamation marks, share of upper-case letters, share of other signs."""
    data, off = text_bytes(texts)
    low, starts, ends, before = word_spans(data, off)
    n = len(off) - 1
    has = np.zeros((n, len(entries)), bool)
    row = np.repeat(np.arange(n), np.diff(before))
    hit = np.zeros(len(starts), bool)
    for at, h in entry_hashes(low, starts, ends):
        if len(entries):
            k = np.minimum(np.searchsorted(entries, h), len(entries) - 1)
            found = entries[k] == h
            has[row[at[found]], k[found]] = True
            hit[at[found]] = True
    words = np.diff(before)
    place = np.arange(len(starts)) - before[row] < words[row] / 2
    sums = lambda flags: np.add.reduceat(np.append(flags, 0), np.minimum(off[:-1], len(flags))) * (np.diff(off) > 0) if n else np.zeros(0)
    upper = sums(((data >= 0x41) & (data <= 0x5A)).astype(np.int64))
    letters = sums(((low >= 0x61)).astype(np.int64))
    other = sums(((data > 0x20) & (low == 0)).astype(np.int64))
    doubled = np.zeros(len(data), np.int64)
    doubled[1:] = (data[1:] == 0x21) & (data[:-1] == 0x21)
    count = lambda flags: np.bincount(row[flags], minlength=n)
    both = (count(hit & place) > 0) & (count(hit & ~place) > 0)
    measures = np.stack([count(hit), words, both, sums(doubled), upper / np.maximum(letters, 1), other / np.maximum(np.diff(off), 1)], axis=1)
    return has, measures.astype(np.float64)


VOTERS = LEXICON_VOTERS + 5  # 2 ** 8 * 3 ** 5 vote patterns at most


def votes(has: np.ndarray, measures: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 nothing, for each text and voter. Entries are dealt to the lexicon voters by turns."""
    hits, words, both, doubled, upper, other = measures.T
    kinds = has.sum(axis=1)
    out = np.zeros((len(has), VOTERS), np.int8)
    for v in range(LEXICON_VOTERS):
        out[:, v] = has[:, v::LEXICON_VOTERS].any(axis=1)
    density = hits / np.maximum(words, 1)
    out[:, LEXICON_VOTERS] = np.where(kinds >= 3, 1, np.where(kinds == 0, -1, 0))
    out[:, LEXICON_VOTERS + 1] = np.where(density >= 0.005, 1, np.where(hits == 0, -1, 0))
    out[:, LEXICON_VOTERS + 2] = np.where(both > 0, 1, 0)
    out[:, LEXICON_VOTERS + 3] = np.where((doubled >= 3) | (upper > 0.5), 1, 0)
    out[:, LEXICON_VOTERS + 4] = np.where(other > 0.2, -1, 0)
    return out


def classifier_input(has: np.ndarray, measures: np.ndarray) -> np.ndarray:
    hits, words, both, doubled, upper, other = measures.T
    kinds = has.sum(axis=1)
    extra = np.stack([np.ones(len(has)), kinds > 0, np.log1p(kinds), np.log1p(hits), both, np.minimum(doubled, 3) / 3, upper > 0.5, other > 0.2], axis=1)
    return np.hstack([extra, has])


# ---- label model ---------------------------------------------------------------------------


@dataclass
class LabelModel:
    """tables[y, v, s]: chance that voter v says s - 1 in class y; weights: share of a voter's evidence that is its
    own; correlations: of the votes beyond the class; prior: chance of class 1."""

    tables: np.ndarray
    weights: np.ndarray
    correlations: np.ndarray
    prior: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of class 1 for each row of votes."""
        logs = np.log(self.tables)
        voters = np.arange(patterns.shape[1])
        said = patterns.astype(np.int64) + 1
        odds = (logs[1][voters, said] - logs[0][voters, said]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(odds + np.log(self.prior / (1 - self.prior)), -30, 30)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 25) -> LabelModel:
    """EM over distinct vote patterns. ``counts`` are documents of each pattern, ``known[:, y]`` labelled training
    documents of it; these are counted in their class, the rest by the posterior."""
    n, v = patterns.shape
    labelled = known.sum(axis=0)
    prior = float((labelled[1] + 1) / (labelled.sum() + 20)) if labelled.sum() else 0.05
    said = patterns.astype(np.int64) + 1
    free = np.maximum(counts - known.sum(axis=1), 0).astype(float)

    def tables_of(share: np.ndarray) -> np.ndarray:
        out = np.ones((2, v, 3))
        for y, w in ((0, 1 - share), (1, share)):
            mass = free * w + known[:, y] if share is not start else known[:, y].astype(float)
            for s in range(3):
                out[y, :, s] += ((said == s) * mass[:, None]).sum(axis=0)
        return out / out.sum(axis=2, keepdims=True)

    start = np.zeros(n)
    model = LabelModel(tables_of(start), np.full(v, 1.0), np.zeros((v, v)), prior)
    for _ in range(rounds):
        share = model.posterior(patterns)
        total = np.zeros((v, v))
        for y, w in ((0, 1 - share), (1, share)):
            mass = free * w + known[:, y]
            if mass.sum() <= 0:
                continue
            centred = patterns - (patterns * mass[:, None]).sum(axis=0) / mass.sum()
            total += (centred * mass[:, None]).T @ centred
        scale = np.sqrt(np.maximum(np.diag(total), 1e-9))
        correlations = total / np.outer(scale, scale)
        np.fill_diagonal(correlations, 0)
        correlations[np.abs(correlations) < NOISE] = 0
        weights = 1 / (1 + np.abs(correlations).sum(axis=1))
        model = LabelModel(tables_of(share), weights, correlations, prior)
    return model


def fit_logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3  # the constant
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + penalty * w
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ x + np.diag(penalty), grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return w


# ---- jobs ----------------------------------------------------------------------------------

FEATURES = "id bigint, hits binary, measures array<double>, pattern bigint"


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """Up to ``fit_rows`` (id, toxic) of labelled rows outside the held-out part, one for each text, in an order that
    a hash of the id gives. Only ids and text hashes are shuffled."""
    names = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    marks = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    marks = marks.filter(~held_out("id") & F.col("toxic").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic"))
    one = names.join(marks, "id").groupBy("text_hash").agg(F.min(F.struct("id", "toxic")).alias("r")).select("r.*")
    return save(one.orderBy(F.xxhash64("id"), "id").limit(fit_rows), "toxic-training")


def find_entries(texts: DataFrame, entries: int) -> np.ndarray:
    """Sorted hashes of the most telling entries of texts (id, text, toxic), at most ``entries``: their share of toxic
    texts exceeds the mean with a likelihood ratio that chance gives to about one entry of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, off = text_bytes(batch.column("text"))
            low, starts, ends, before = word_spans(data, off)
            row = np.repeat(np.arange(batch.num_rows), np.diff(before))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
            found = entry_hashes(low, starts, ends)
            h, of = np.concatenate([h for _, h in found]), np.concatenate([row[at] for at, _ in found])
            order = np.lexsort((of, h))
            h, of = h[order], of[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            h, of = h[new], of[new]
            unique, first = np.unique(h, return_index=True)
            if len(unique):
                yield pa.record_batch({"entry": pa.array(unique.view(np.int64)), "texts": pa.array(np.diff(np.append(first, len(h)))),
                                       "toxic": pa.array(np.add.reduceat(toxic[of].astype(np.int64), first))})

    size = texts.agg(F.avg("toxic").alias("p")).first()["p"]
    if not size or size >= 1:
        return np.zeros(0, np.uint64)
    counts = save(texts.mapInArrow(run, "entry bigint, texts bigint, toxic bigint").groupBy("entry").agg(
        F.sum("texts").alias("n"), F.sum("toxic").alias("k")), "toxic-entries")
    share = (F.col("k") / F.col("n"))
    ratio = F.col("k") * F.log(share / size) + F.when(share < 1, (F.col("n") - F.col("k")) * F.log((1 - share) / (1 - size))).otherwise(0.0)
    best = counts.filter((F.col("k") > 0) & (share > size)).withColumn("ratio", ratio)
    need = float(np.log(max(counts.filter("n >= 3").count(), 1) / CHANCE_ENTRIES))  # rarer ones can never be telling
    top = best.filter(F.col("ratio") > need).orderBy(F.desc("ratio"), "entry").limit(CANDIDATES).collect()
    candidates = np.sort(np.array([r["entry"] for r in top], np.int64).view(np.uint64))
    if not len(candidates):
        return candidates

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            has, _ = text_features(batch.column("text"), candidates)
            yield pa.record_batch({"id": batch.column("id"), "toxic": batch.column("toxic"), "hits": pa.array([b.tobytes() for b in np.packbits(has, axis=1)], pa.binary())})

    got = texts.mapInArrow(hits, "id bigint, toxic int, hits binary").orderBy("id").collect()  # one row for each training row
    chosen = cover(_unpack([bytes(r["hits"]) for r in got], len(candidates)), np.array([r["toxic"] for r in got]) > 0, size,
                   float(np.log(max(len(candidates), 20) / CHANCE_ENTRIES)), entries)
    return np.sort(candidates[chosen])


def cover(has: np.ndarray, toxic: np.ndarray, share: float, need: float, entries: int) -> list[int]:
    """Entries that explain the toxic texts, each by texts that no earlier one explains. So words that merely go
    along with a telling one, as in the copies of a toxic text, are not taken."""
    left, chosen = np.ones(len(has), bool), []
    k, n = has[toxic].sum(axis=0).astype(float), has.sum(axis=0).astype(float)
    while len(chosen) < entries:
        p = k / np.maximum(n, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(k > 0, k * np.log(p / share), 0) + np.where(n > k, (n - k) * np.log(np.maximum(1 - p, 1e-12) / (1 - share)), 0)
        ratio[(p <= share) | (k == 0)] = -1
        best = int(ratio.argmax())
        if ratio[best] <= need:
            break
        chosen.append(best)
        new = left & has[:, best]
        left &= ~new
        k -= has[new & toxic].sum(axis=0)
        n -= has[new].sum(axis=0)
    return chosen


_STATES = 3 ** np.arange(VOTERS, dtype=np.int64)


def features(docs: DataFrame, entries: np.ndarray) -> DataFrame:
    """Hits (one bit for each entry), measures and vote pattern of each document (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            has, measures = text_features(batch.column("text"), entries)
            pattern = (votes(has, measures).astype(np.int64) + 1) @ _STATES
            yield pa.record_batch({"id": batch.column("id"), "hits": pa.array([b.tobytes() for b in np.packbits(has, axis=1)], pa.binary()),
                                   "measures": pa.array(measures.tolist(), pa.list_(pa.float64())), "pattern": pa.array(pattern)})

    return save(docs.select("id", "text").mapInArrow(run, FEATURES), "toxic-features")


def _unpack(hits: list[bytes], entries: int) -> np.ndarray:
    width = -(-entries // 8)
    raw = np.frombuffer(b"".join(hits), np.uint8).reshape(len(hits), width)
    return np.unpackbits(raw, axis=1, count=entries).astype(bool) if entries else np.zeros((len(hits), 0), bool)


@dataclass
class Model:
    entries: np.ndarray
    weights: np.ndarray
    label_model: LabelModel

    def score(self, has: np.ndarray, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(classifier_input(has, measures) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_rows: int = FIT_ROWS, entries: int = ENTRIES) -> tuple[Model, DataFrame]:
    """The model, and the features of all documents. Labels of held-out ids are never read.

    Rows with a null id or label aren't trained on; labels of an id that repeats count as toxic if any is. Without
    labels of both classes no entry is found and every text gets the prior."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marks = training_rows(docs, labels, id_col, text_col, label_col, fit_rows)
    sample = rows.join(F.broadcast(marks), "id")  # at most fit_rows rows are broadcast
    found = find_entries(sample, entries)
    every = features(rows, found)

    counts = every.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    marked = every.join(F.broadcast(marks), "id")
    by_label = marked.groupBy("pattern").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
    table = counts.join(by_label, "pattern", "left").orderBy("pattern").toPandas()  # at most 2 ** 8 * 3 ** 5 rows
    patterns = (table["pattern"].to_numpy(np.int64)[:, None] // _STATES % 3 - 1).astype(np.int8)
    known = table[["clean", "toxic"]].fillna(0).to_numpy(np.float64)
    label_model = fit_label_model(patterns, table["n"].to_numpy(np.float64), known)

    got = marked.orderBy("id").select("hits", "measures").limit(2 * fit_rows).collect()
    has, measures = _unpack([bytes(r["hits"]) for r in got], len(found)), np.array([r["measures"] for r in got], float).reshape(-1, 6)
    target = label_model.posterior(votes(has, measures))
    weights = fit_logistic(classifier_input(has, measures), target) if len(got) else np.zeros(8 + len(found))
    return Model(found, weights, label_model), every


def score_features(model: Model, every: DataFrame) -> DataFrame:
    """(id, score) of each row of the features."""

    @F.pandas_udf("double")
    def score(hits: pd.Series, measures: pd.Series) -> pd.Series:
        if not len(hits):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(_unpack([bytes(b) for b in hits], len(model.entries)), np.stack(measures.to_list())))

    return every.select("id", score("hits", "measures").alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score THRESHOLD or more; all columns kept, nothing is shuffled. Null and empty
    texts get a score too."""
    model, _ = fit(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            keep = model.score(*text_features(batch.column(at), model.entries)) < THRESHOLD
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    model, every = fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return score_features(model, every).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

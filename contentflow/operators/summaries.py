"""Extractive summaries, key points and summary records.

Sentences are ranked by the mean frequency of their content words inside the
text. Where a key stands for a group of texts, name the column that orders them
(``order``): the group is then summed up as one text, over exploded sentences. A
word budget of n can hold at most n sentences, so a top-n per key is exact and
keeps a hot group from travelling whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from contentflow.functions import text as x
from contentflow.operators.ordering import top_per_key
from contentflow.operators.quality import content_words
from contentflow.session import give_back


PART_WORDS = 1 << 17  # words that numpy holds at a time


def _parts(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Consecutive texts of at most ``most`` words together, or one text."""
    per_text = np.asarray(pc.fill_null(pc.list_value_length(texts), 0), np.int64)
    words = np.append(0, np.cumsum(np.asarray(pc.list_value_length(texts.flatten()), np.int64)))
    upto = words[np.append(0, np.cumsum(per_text))]  # words before each text
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def _means(texts: pa.Array) -> pa.Array:
    sentences = texts.flatten()
    words = sentences.flatten()
    per_text = np.asarray(pc.fill_null(pc.list_value_length(texts), 0), np.int64)
    per_sentence = np.asarray(pc.list_value_length(sentences), np.int64)
    text_of = np.repeat(np.repeat(np.arange(len(texts)), per_text), per_sentence)
    code = np.asarray(words.dictionary_encode().indices, np.int64)
    _, place, seen = np.unique(text_of * (len(words) + 1) + code, return_inverse=True, return_counts=True)
    total = np.append(0, np.cumsum(seen[place]))
    stop = np.cumsum(per_sentence)
    mean = (total[stop] - total[stop - per_sentence]) / np.maximum(per_sentence, 1)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_text)), pa.int32()), pa.array(mean, pa.float64()))


@F.arrow_udf(ArrayType(DoubleType()))
def mean_frequencies(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """For the words of each sentence of a text, how often they occur in the text on average (no words: 0).

    Memory follows one Arrow batch of words; what is counted beside it is bounded by ``PART_WORDS`` or the longest text."""
    for texts in parts:
        found = [_means(part) for part in _parts(texts, PART_WORDS)]
        yield pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.float64()))
        del texts, found
    give_back()


def sentence_scores(docs: DataFrame, key: list[str], body: str = "text") -> DataFrame:
    """(key, _s): the sentences of each text as array<struct<pos, sentence, n_words, score>>; a row is one text.

    Words are counted inside the row, so nothing is shuffled. Texts without a sentence (null, empty, only marks) are left out."""
    cut = docs.select(*key, x.sentences(body).alias("_k"))
    # not deterministic for the optimiser: the filter below would else be pushed through and count all words once more
    frequencies = mean_frequencies.asNondeterministic()
    words = F.transform("_k", lambda s: content_words(x.tokens(s)))
    scored = cut.withColumn("_f", frequencies(words)).filter(F.size("_f") > 0)
    places = F.transform("_k", lambda s, i: F.struct(i.alias("pos"), s.alias("sentence"), x.word_count(s).alias("n_words")))
    return scored.select(*key, F.zip_with(places, "_f", lambda p, f: F.struct(
        p["pos"].alias("pos"), p["sentence"].alias("sentence"), p["n_words"].alias("n_words"), f.alias("score"))).alias("_s"))


def group_sentences(docs: DataFrame, key: list[str], order: str, body: str = "text") -> DataFrame:
    """(key, pos, sentence) of groups of texts; ``pos`` is (text, place in the text)."""
    rows = docs.select(*key, F.col(order).alias("_text"), F.posexplode_outer(x.sentences(body)).alias("_at", "sentence"))
    return rows.filter(F.col("_at").isNotNull()).select(*key, F.struct("_text", "_at").alias("pos"), "sentence")


def ranked_sentences(docs: DataFrame, key: list[str], body: str = "text", order: str | None = None) -> DataFrame:
    """(key, pos, sentence, n_words, score)."""
    if order is not None:
        return scored_sentences(group_sentences(docs, key, order, body), key)
    return sentence_scores(docs, key, body).select(*key, F.inline("_s"))


def scored_sentences(sents: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``n_words`` and ``score`` to (key, pos, sentence); ``pos`` is unique per key."""
    terms = sents.select(*key, "pos", F.explode(content_words(x.tokens("sentence"))).alias("term"))
    per = terms.groupBy(*key, "term", "pos").agg(F.count(F.lit(1)).alias("c"))
    totals = per.groupBy(*key, "term").agg(F.sum("c").alias("tf"))
    scores = per.join(totals, [*key, "term"]).groupBy(*key, "pos").agg((F.sum(F.col("c") * F.col("tf")) / F.sum("c")).alias("score"))
    return (sents.withColumn("n_words", x.word_count("sentence"))
            .join(scores, [*key, "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))))


def extractive_summary(docs: DataFrame, key: list[str], body: str = "text", max_words: int = 150,
                       order: str | None = None) -> DataFrame:
    """Best sentences up to the word budget (the best one always), in original order."""
    if order is not None:
        return pick_sentences(ranked_sentences(docs, key, body, order), key, max_words)
    best_first = F.array_sort(F.transform("_s", lambda s: F.struct(
        (-F.round(s["score"], 9)).alias("k"), s["pos"].alias("pos"), s["sentence"].alias("sentence"), s["n_words"].alias("n"))))
    picked_type = "array<struct<pos:int,sentence:string,n:int>>"
    start = F.struct(F.lit(0).alias("total"), F.array().cast(picked_type).alias("picked"))

    def step(acc, s):
        total = acc["total"] + s["n"]
        fits = (total <= max_words) | (F.size(acc["picked"]) == 0)
        one = F.array(F.struct(s["pos"].alias("pos"), s["sentence"].alias("sentence"), s["n"].alias("n")))
        return F.struct(total.alias("total"), F.when(fits, F.concat(acc["picked"], one)).otherwise(acc["picked"]).alias("picked"))

    chosen = F.aggregate(best_first, start, step, lambda acc: F.array_sort(acc["picked"]))
    return sentence_scores(docs, key, body).withColumn("_p", chosen).select(
        *key, F.array_join(F.transform("_p", lambda s: s["sentence"]), ". ").alias("summary"),
        F.aggregate("_p", F.lit(0), lambda acc, s: acc + s["n"]).alias("summary_words"))


def pick_sentences(ranked: DataFrame, key: list[str], max_words: int = 150) -> DataFrame:
    order = [F.round("score", 9).desc(), F.col("pos").asc()]
    best = Window.partitionBy(*key).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    picked = (top_per_key(ranked, key, order, max(max_words, 1), out="_rank")
              .withColumn("_total", F.sum("n_words").over(best))
              .filter((F.col("_total") <= max_words) | (F.col("_rank") == 1)))
    return picked.groupBy(*key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda s: s["sentence"]), ". ").alias("summary"),
        F.sum("n_words").alias("summary_words"))


def abstractive_summary(docs: DataFrame, key: list[str], body: str = "text",
                        model: Callable[[list[str]], list[str]] | None = None, max_words: int = 150) -> DataFrame:
    """Summary by a user model that maps a list of texts to a list of summaries, one
    call per Arrow batch; without a model the extractive summary."""
    base = extractive_summary(docs, key, body, max_words).select(*key, "summary")
    if model is None:
        return base
    rows = docs.select(*key, F.col(body).alias("summary"))

    def run(batches):
        for pdf in batches:
            pdf["summary"] = model(pdf["summary"].tolist())
            yield pdf

    return rows.mapInPandas(run, rows.schema)


def key_points(docs: DataFrame, key: list[str], body: str = "text", group: int = 5) -> DataFrame:
    """One sentence for every ``group`` consecutive sentences: the best scored."""
    def best(i):
        part = F.slice("_s", i * group + 1, group)
        return F.array_max(F.transform(part, lambda s: F.struct(
            F.round(s["score"], 9).alias("score"), (-s["pos"]).alias("first"), s["sentence"].alias("sentence"))))["sentence"]

    groups = F.sequence(F.lit(0), F.ceil(F.size("_s") / group).cast("int") - 1)
    rows = sentence_scores(docs, key, body).filter(F.size("_s") > 0)
    return rows.select(*key, F.posexplode(F.transform(groups, best)).alias("point", "sentence")).withColumn(
        "point", F.col("point").cast("bigint"))


def summary_record(df: DataFrame, body: str, summary: str) -> DataFrame:
    """Lengths, compression and scores of a summary; texts of at most three words are their own summary."""
    n, m = x.word_count(body), x.word_count(summary)
    tiny = n <= 3
    chosen = F.when(tiny, F.col(body)).otherwise(F.col(summary))
    return (
        df.filter(~x.is_blank(body))
        .withColumn("_s", chosen)
        .withColumns({
            "original_length": n.cast("bigint"),
            "summary_length": F.when(tiny, n).otherwise(m).cast("bigint"),
            "compression_ratio": F.when(tiny, F.lit(1.0)).otherwise(x.ratio(m, n)),
            "readability_score": x.readability_ideal_length("_s"),
            "coherence_score": F.when(tiny, F.lit(1.0)).otherwise(x.coherence("_s")),
        })
        .drop("_s")
    )

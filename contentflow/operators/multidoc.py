"""Summaries of groups of texts: combined summary, key points, themes, references, timeline and metrics.

The result is four tables. ``groups`` has one row per group and only bounded parts (five themes, five key points,
a summary within its word budget, counts); what grows with a group stays rows of its own: ``documents`` (a summary of every
text), ``references`` (related pairs with copies folded) and ``timeline`` (dated sentences)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.functions import dates
from contentflow.functions import text as x
from contentflow.operators import similarity, summaries, tfidf
from contentflow.operators.ordering import top_per_key
from contentflow.session import shared_table


def document_summaries(docs: DataFrame, key: list[str], body: str = "text") -> DataFrame:
    """(key, summary, original_length, summary_length, compression_ratio, readability) of every text."""
    return docs.withColumn("summary", x.short_summary(body)).select(
        *key, "summary", x.word_count(body).cast("bigint").alias("original_length"), x.word_count("summary").cast("bigint").alias("summary_length"),
        x.ratio(x.word_count("summary"), x.word_count(body)).alias("compression_ratio"), x.readability_ideal_length("summary").alias("readability"))


def first_points(documents: DataFrame, group: list[str], doc: str, most: int = 5) -> DataFrame:
    """(group, key_points): the first different sentences of the summaries, in the order of the texts."""
    said = documents.select(*group, doc, F.posexplode(x.sentences("summary")).alias("_at", "sentence"))
    places = said.groupBy(*group, "sentence").agg(F.min(F.struct(doc, "_at")).alias("_place"))
    first = top_per_key(places, group, [F.col("_place").asc()], most)
    return first.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", "sentence"))), lambda s: s["sentence"]).alias("key_points"))


def reference_counts(found: DataFrame, group: list[str]) -> DataFrame:
    """(group, n_references) over all pairs of texts, counted from the folded form: a class of m copies holds m (m - 1) / 2
    pairs, and a related pair of classes as many as the product of their sizes."""
    copies = found.filter("kind = 'copy'").groupBy(*group, F.col("a").alias("rep")).agg((F.count(F.lit(1)) + 1).alias("m"))
    inside = copies.select(*group, (F.col("m") * (F.col("m") - 1) / 2).cast("bigint").alias("n"))
    pairs = found.filter("kind = 'pair'").select(*group, "a", "b")
    left = copies.select(*group, F.col("rep").alias("a"), F.col("m").alias("ma"))
    right = copies.select(*group, F.col("rep").alias("b"), F.col("m").alias("mb"))
    across = pairs.join(left, [*group, "a"], "left").join(right, [*group, "b"], "left").select(
        *group, (F.coalesce("ma", F.lit(1)) * F.coalesce("mb", F.lit(1))).cast("bigint").alias("n"))
    return inside.unionByName(across).groupBy(*group).agg(F.sum("n").alias("n_references"))


def timeline(sentences: DataFrame, as_of: Column) -> DataFrame:
    """The dated sentences of (..., sentence): ``date`` as written, ``at`` resolved, and the confidence in the event."""
    rows = sentences.withColumn("_m", dates.date_mentions("sentence")).filter(F.size("_m") > 0)
    kept = [c for c in sentences.columns if c != "sentence"]
    return rows.select(*kept, F.col("sentence").alias("content"), F.posexplode("_m").alias("nth", "date")).withColumns(
        {"at": dates.resolve_mention("date", as_of), "confidence": dates.mention_confidence("content")})


def group_confidence(documents: DataFrame, themes: DataFrame, group: list[str], doc: str) -> DataFrame:
    """(group, confidence): mean of the share of themes that the summary of the first text names and of its coherence."""
    first = documents.groupBy(*group).agg(F.min_by("summary", doc).alias("s")).join(themes, group)
    cover = x.ratio(F.size(F.filter("themes", lambda k: F.contains(F.lower("s"), F.lower(k)))), F.size("themes"))
    return first.select(*group, ((cover + x.coherence("s")) / 2).alias("confidence"))


def summarize_groups(docs: DataFrame, group: list[str], doc: str, as_of: Column, body: str = "text", max_words: int = 150) -> dict[str, DataFrame]:
    """The four tables for ``docs`` (group, doc, body); ``doc`` orders the texts of a group. No texts, or a budget below one
    word, are refused."""
    if max_words <= 0:
        raise ValueError("the length of a summary must be positive")
    texts = docs.select(*group, doc, body).filter(F.col(body).isNotNull())
    if texts.isEmpty():
        raise ValueError("no texts to sum up")
    documents, _ = shared_table(document_summaries(texts, [*group, doc], body), "document-summaries")
    theme_rows, _ = shared_table(tfidf.theme_array(tfidf.themes(texts, group, doc, body), group), "themes")
    # texts are cut into sentences once; the combined summary and the timeline read them
    sentences, _ = shared_table(texts.select(*group, doc, F.posexplode(x.sentences(body)).alias("place", "sentence")), "sentences")
    hit = F.coalesce(F.exists("themes", lambda k: F.contains(F.lower("sentence"), F.lower(k))), F.lit(False))
    named = sentences.join(theme_rows, group, "left").withColumn("hit", hit).drop("themes")
    with_hit = named.groupBy(*group).agg(F.bool_or("hit").alias("_any"))
    about = named.join(with_hit, group).filter(F.col("hit") | (~F.col("_any") & (F.col("place") == 0)))
    about = about.select(*group, F.struct(doc, "place").alias("pos"), "sentence")
    combined = summaries.pick_sentences(summaries.scored_sentences(about, group), group, max_words)
    references, _ = shared_table(similarity.similar_pairs(texts, group, doc, body), "references")
    events, _ = shared_table(timeline(sentences, as_of), "timeline")
    out = documents.groupBy(*group).agg(
        F.count(F.lit(1)).alias("num_documents"), F.sum("original_length").alias("total_length"), F.avg("compression_ratio").alias("compression_ratio"))
    parts = [theme_rows, combined, first_points(documents, group, doc), group_confidence(documents, theme_rows, group, doc), reference_counts(references, group),
             events.groupBy(*group).agg(F.count(F.lit(1)).alias("n_events"), F.min("at").alias("first_event"))]
    for part in parts:
        out = out.join(part, group, "left")
    return {"groups": out.na.fill(0, ["n_references", "n_events"]), "documents": documents, "references": references, "timeline": events}

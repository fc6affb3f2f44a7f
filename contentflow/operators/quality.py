"""Quality scores of texts: one narrow pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.functions import text as x
from contentflow.vocab import ENGLISH_STOP_WORDS, NEGATIVE_WORDS, POSITIVE_WORDS

# Weights of the overall score.
WEIGHTS = {
    "readability_score": 0.2, "coherence_score": 0.2, "engagement_score": 0.15,
    "originality_score": 0.15, "fact_density": 0.15, "sentiment_score": 0.15,
}


def content_words(token_array: Column, stop_words=ENGLISH_STOP_WORDS) -> Column:
    return F.filter(token_array, lambda t: t.rlike(r"^\p{L}+$") & ~t.isin(list(stop_words)))


def quality_flags(n_tokens: Column, top: Column, n_sentences: Column, readability: Column, compound: Column) -> Column:
    mean_length = n_tokens / F.nullif(n_sentences, F.lit(0))
    return F.array_compact(F.array(
        F.when(top > n_tokens * 0.1, "excessive_repetition"),
        F.when(mean_length > 40, "long_sentences").when(mean_length < 10, "short_sentences"),
        F.when(n_tokens < 100, "insufficient_length"),
        F.when(readability < 0.3, "low_readability"),
        F.when(F.abs(compound) > 0.8, "extreme_sentiment"),
    ))


def text_profile(df: DataFrame, body: str = "text") -> DataFrame:
    """Arrays and counts the measures share, cut once per row; unused ones are pruned."""
    return (
        df.withColumn("_low", F.lower(body))
        .withColumns({
            "_tok": x.tokens_of_lower("_low"), "_sents": x.sentences(body), "_marked": x.sentences_with_end(body),
            "_ents": x.entities(body), "_phrases": x.phrases_of_lower("_low"), "_numbers": F.regexp_count(body, F.lit("[0-9]+")),
        })
        .withColumns({
            "_alpha": F.filter("_tok", lambda t: t.rlike(r"^\p{L}+$")),
            "_shapes": x.sentence_shapes("_sents"), "_stok": F.transform("_sents", x.tokens),
        })
        .withColumns({
            "_content": F.filter("_alpha", lambda t: ~t.isin(list(ENGLISH_STOP_WORDS))),
            "_sets": F.transform("_stok", F.array_distinct), "_lengths": F.transform("_stok", F.size),
        })
    )


PROFILE = ["_low", "_tok", "_sents", "_marked", "_ents", "_phrases", "_numbers", "_alpha", "_shapes", "_stok", "_sets", "_lengths", "_content"]


def detail_columns() -> dict[str, Column]:
    n = F.size("_tok")
    keywords = F.least(F.size(F.array_distinct(F.filter("_content", lambda t: F.length(t) > 2))), F.lit(10))
    return {
        "sentence_count": F.size("_sents").cast("bigint"),
        "avg_sentence_length": x.ratio(n, F.size("_sents")),
        "unique_entities": F.size(F.array_distinct("_ents")).cast("bigint"),
        "keyword_density": x.ratio(keywords, n),
    }


def score_quality(df: DataFrame, body: str = "text", positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS) -> DataFrame:
    """Adds the six component scores, the overall score, the flags and the details.

    A blank text gets an ``error`` and no scores; the other rows go on."""
    p, n = x.hits("_tok", positive), x.hits("_tok", negative)
    scored = text_profile(df, body).withColumns({
        "_p": p, "_q": n, "_top": F.coalesce(x.most_repeated("_content"), F.lit(0)),
        "readability_score": x.flesch_of_counts(F.array_size("_tok"), F.array_size("_sents"), "_low") / 100,
        "coherence_score": x.shift_coherence_of("_sets"),
        "engagement_score": x.engagement_of("_marked", "_alpha", "_lengths"),
        "originality_score": x.originality_of("_phrases", "_shapes"),
        "fact_density": x.fact_density_of("_ents", "_numbers", F.size("_tok")),
        **detail_columns(),
    }).withColumn("compound", x.ratio(F.col("_p") - F.col("_q"), F.col("_p") + F.col("_q")))
    scored = scored.withColumn("sentiment_score", (F.col("compound") + 1) / 2)
    overall = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    flags = quality_flags(F.size("_tok"), F.col("_top"), F.size("_sents"), F.col("readability_score"), F.col("compound"))
    return (
        scored.withColumn("error", F.when(x.is_blank(body), "empty text"))
        .withColumn("overall_score", F.when(F.col("error").isNull(), x.clamp(overall, 0.0, 1.0)))
        .withColumn("quality_flags", flags)
        .drop(*PROFILE, "_p", "_q", "_top")
    )

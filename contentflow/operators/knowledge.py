"""Taxonomy, categories, sentiment, entities and fact checks against user tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentflow.functions import text as x
from contentflow.functions.mentions import phrase_mentions, running_sum
from contentflow.operators.ordering import top_per_key
from contentflow.session import cut_lineage
from contentflow.vocab import CATEGORIES, NEGATIVE_WORDS, POSITIVE_WORDS, TAXONOMY


# --- taxonomy -----------------------------------------------------------------------

def default_taxonomy(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(nodes(category, parent), keywords(category, keyword)) of the built-in taxonomy."""
    from contentflow.sources.views import small_table

    nodes = small_table(spark, [(c, p) for c, p, _ in TAXONOMY], "category string, parent string")
    words = small_table(spark, [(c, k) for c, _, ks in TAXONOMY for k in ks], "category string, keyword string")
    return nodes, words


def find_category(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.lower("category") == name.lower())


def children(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.lower("parent") == name.lower())


def ancestors(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(category, ancestor, depth), nearest first, roots' missing parent excluded.

    One equi-join per level; a taxonomy has few levels whatever its width. Each level
    is checkpointed, so neither plan nor lineage grows. A category that comes to
    an ancestor it already has is on a cycle, which raises."""
    edges = nodes.filter(F.col("parent").isNotNull()).select(F.col("category").alias("_c"), "parent")
    level = start.select("category").join(edges, F.col("category") == F.col("_c")).select(
        "category", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    levels: list[DataFrame] = []
    while True:
        level = cut_lineage(level)
        if level.isEmpty():
            break
        pair = ["category", "ancestor"]
        if levels and not level.join(_all_levels(levels).select(*pair), pair, "left_semi").isEmpty():
            raise ValueError("taxonomy is cyclic")
        levels.append(level)
        level = level.join(edges, F.col("ancestor") == F.col("_c")).select(
            "category", F.col("parent").alias("ancestor"), F.lit(len(levels) + 1).alias("depth"))
    return _all_levels(levels or [level])


def _all_levels(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def inherited_keywords(nodes: DataFrame, keywords: DataFrame, start: DataFrame) -> DataFrame:
    """(category, keyword): own keywords and those of every ancestor."""
    own = start.select("category", F.col("category").alias("ancestor"))
    line = own.unionByName(ancestors(nodes, start).select("category", "ancestor"))
    return line.join(keywords.select(F.col("category").alias("ancestor"), "keyword"), "ancestor").select("category", "keyword").distinct()


# Weights of a keyword, an entity and a noun phrase.
EVIDENCE_WEIGHTS = (("keywords", 1.0), ("entities", 0.8), ("phrases", 0.6))


def category_matches(docs: DataFrame, taxonomy: DataFrame, doc: str) -> DataFrame:
    """(doc, category, score) before normalisation.

    ``docs`` has the arrays ``keywords``, ``entities`` and ``phrases``. They meet the taxonomy before
    any aggregation: where it is small enough to be broadcast, only what it knows is shuffled."""
    def weigh(arr, w):
        return F.transform(arr, lambda p: F.struct(F.lower(p).alias("keyword"), F.lit(w).alias("w")))

    weighted = F.concat(*[weigh(c, w) for c, w in EVIDENCE_WEIGHTS])
    rows = docs.select(doc, F.inline(weighted))
    return rows.join(taxonomy, "keyword").groupBy(doc, "category").agg(F.sum("w").alias("score"))


def categorise(docs: DataFrame, taxonomy: DataFrame, doc: str, categories: list[str] = CATEGORIES) -> DataFrame:
    """Every text with the normalised scores of all categories, the best one and the next two.

    Missing categories are filled inside the row; ties follow the category order."""
    matched = category_matches(docs, taxonomy, doc)
    maps = matched.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("category", F.round("score", 9)))).alias("_m"))
    names = F.array(*[F.lit(c) for c in categories])
    value = F.transform(names, lambda c: F.coalesce(F.try_element_at(F.coalesce("_m", F.create_map().cast("map<string,double>")), c), F.lit(0.0)))
    joined = docs.select(doc, "keywords").join(maps, doc, "left").withColumn("_v", value).withColumn("_max", F.array_max("_v"))
    scaled = joined.withColumn("_s", F.transform("_v", lambda v: F.when(F.col("_max") > 0, v / F.col("_max")).otherwise(v)))
    ranked = F.array_sort(F.transform(names, lambda c, i: F.struct((-F.get("_s", i)).alias("k"), i.alias("i"), c.alias("c"))))
    return scaled.withColumn("_r", ranked).select(
        doc, F.map_from_arrays(names, F.col("_s")).alias("scores"), F.get("_r", F.lit(0))["c"].alias("primary_category"),
        F.transform(F.slice("_r", 2, 2), lambda r: r["c"]).alias("secondary_categories"), F.slice("keywords", 1, 10).alias("keywords"))


# --- sentiment ------------------------------------------------------------------------

def signed_score(score, label) -> Column:
    return F.when(F.lower(x.col(label)).isin("negative", "1 star", "2 stars"), -x.col(score)).otherwise(x.col(score))


def star_score(label) -> Column:
    """One to five stars on the scale -1..1."""
    return (F.substring(x.col(label), 1, 1).cast("int") - 3) / 2


def balance(c, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS) -> Column:
    """(positive - negative) / hits in one fold over the tokens; 0 without a hit."""
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"))
    return F.aggregate(
        x.tokens(c), start,
        lambda a, t: F.struct((a["p"] + t.isin(list(positive)).cast("int")).alias("p"), (a["n"] + t.isin(list(negative)).cast("int")).alias("n")),
        lambda a: F.when(a["p"] + a["n"] > 0, (a["p"] - a["n"]) / (a["p"] + a["n"])).otherwise(F.lit(0.0)))


def document_sentiment(docs: DataFrame, body: str = "text", positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS,
                       model: Callable[[str], Column] | None = None) -> DataFrame:
    """Overall balance, scores of the ``". "`` pieces, and word ratios.

    ``model`` may replace the lexicon: a function from a column to a score column."""
    score = model or (lambda c: balance(c, positive, negative))
    pieces = F.filter(x.period_pieces(body), lambda s: ~x.is_blank(s))
    prepared = docs.withColumns({"_tok": x.tokens(body), "_pieces": pieces}).withColumns({
        "_p": x.hits("_tok", positive), "_q": x.hits("_tok", negative), "_w": F.size("_tok")})
    return prepared.withColumns({
        "overall": score(x.col(body)),
        "sentences": F.transform("_pieces", lambda s: F.struct(s.alias("sentence"), score(s).alias("score"))),
        "positive": x.ratio("_p", "_w"), "negative": x.ratio("_q", "_w"),
    }).withColumn("neutral", 1 - F.col("positive") - F.col("negative")).drop("_tok", "_pieces", "_p", "_q", "_w")


def entity_sentiment(docs: DataFrame, entities: list[str], key: list[str], body: str = "text", margin: int = 50) -> DataFrame:
    """(key, entity, mentions, sentiment): mean balance of the text around each mention."""
    found = docs.select(*key, F.inline(phrase_mentions(docs.sparkSession, body, entities, margin)))
    per = found.withColumn("_s", balance("around")).groupBy(*key, "phrase").agg(F.count(F.lit(1)).cast("int").alias("mentions"), F.avg("_s").alias("sentiment"))
    return per.join(phrase_names(docs.sparkSession, [(e,) for e in entities], "entity string"), "phrase").select(*key, "entity", "mentions", "sentiment")


def phrase_names(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The numbers that :func:`phrase_mentions` gives, with what they stand for; as large as the list of phrases."""
    return F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"phrase int, {schema}"))


def aspect_sentiment(docs: DataFrame, aspects: dict[str, list[str]], key: list[str], body: str = "text") -> DataFrame:
    """(key, aspect, sentences, sentiment): mean balance of the pieces that name the aspect."""
    cut = docs.select(*key, x.period_pieces(body).alias("_pieces"))

    def scores(words):
        any_word = lambda s: reduce(or_, [F.contains(F.lower(s), F.lit(w)) for w in words])
        return F.transform(F.filter("_pieces", any_word), lambda s: balance(s))

    parts = [F.struct(F.lit(name).alias("aspect"), scores(words).alias("scores")) for name, words in aspects.items()]
    rows = cut.select(*key, F.inline(F.array(*parts))).filter(F.size("scores") > 0)
    return rows.select(*key, "aspect", F.size("scores").alias("sentences"), x.mean_of(F.col("scores")).alias("sentiment"))


# --- entities and facts -------------------------------------------------------------------

def entity_rows(docs: DataFrame, key: list[str], body: str = "text") -> DataFrame:
    """(key, nth, entity, label) by the built-in rules."""
    return docs.select(*key, F.posexplode(x.entities(body)).alias("nth", "entity")).withColumn("label", x.entity_label("entity"))


def spans(body) -> Column:
    """[start, end) of every rule entity, 0-based: the ends are running sums of the lengths of gaps and entities."""
    gaps = F.transform(F.split(x.col(body), x.ENTITY_RE), F.length)
    sizes = F.transform(x.entities(body), F.length)
    ends = running_sum(F.zip_with(sizes, F.slice(gaps, 1, F.size(sizes)), lambda e, g: e + g)).cast("array<int>")
    return F.zip_with(ends, sizes, lambda stop, e: F.struct((stop - e).alias("start"), stop.alias("end")))


def with_custom_entities(docs: DataFrame, patterns: list[tuple[str, str]], key: list[str], body: str = "text") -> DataFrame:
    """(key, label, phrase, start): mentions of user phrases that overlap no rule entity. ``patterns`` are (label, phrase)."""
    spark = docs.sparkSession
    found = phrase_mentions(spark, body, [phrase for _, phrase in patterns])
    rows = docs.select(*key, body, found.alias("_found")).filter(F.size("_found") > 0).withColumn("_spans", spans(body))
    rows = rows.select(*key, "_spans", F.inline("_found")).join(phrase_names(spark, patterns, "label string, text_ string"), "phrase")
    end = F.col("start") + F.length("text_")
    clash = F.exists("_spans", lambda s: (F.col("start") < s["end"]) & (end > s["start"]))
    return rows.filter(~clash).select(*key, "label", F.col("text_").alias("phrase"), "start")


def link_entities(entities: DataFrame, kb: DataFrame) -> DataFrame:
    """Entities with the knowledge-base entry of the same name and label.

    ``kb(name, label, kb_id, description)`` is any table with unique (lower(name), label)."""
    base = kb.select(F.lower("name").alias("_n"), F.col("label"), "kb_id", F.substring("description", 1, 200).alias("description"))
    j = entities.withColumn("_n", F.lower("entity")).join(base, ["_n", "label"], "left").drop("_n")
    return j.withColumn("confidence", F.when(x.is_blank("entity"), 0.4).when(F.col("kb_id").isNotNull(), 0.8).otherwise(0.6))


# Labels worth looking up for a claim.
CLAIM_LABELS = ["ORG", "PERSON", "GPE", "PRODUCT", "EVENT"]


def claim_evidence(claims: DataFrame, pages: DataFrame, key: list[str], per_entity: int = 2) -> DataFrame:
    """(key, claim, entity, source, evidence) from ``pages(name, source, body)``.

    The pages of an entity are cut to ``per_entity`` before the join: the cut depends on
    the entity alone, so this is exact and a name with many pages stays small."""
    found = claims.select(*key, "claim", F.explode(F.array_distinct(x.entities("claim"))).alias("entity"))
    found = found.filter(x.entity_label("entity").isin(CLAIM_LABELS))
    few = top_per_key(pages, ["name"], [F.col("source").asc()], per_entity).select(
        F.lower("name").alias("_n"), "source", F.substring("body", 1, 500).alias("evidence"))
    return found.withColumn("_n", F.lower("entity")).join(few, "_n").drop("_n")


NEGATIONS = ["not", "no", "never", "none", "neither"]


def judge_evidence(evidence: DataFrame, relevant_above: float = 0.6,
                   model: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Adds ``verdict`` and ``score``. Default: a claim most of whose content words occur in
    the evidence is supported, or contradicted when exactly one side is negated.

    ``model(claim, evidence)`` may return struct<verdict:string, score:double> instead."""
    if model is not None:
        return evidence.withColumn("_m", model(F.col("claim"), F.col("evidence"))).select("*", "_m.*").drop("_m")
    share = x.relevance("claim", "evidence", 0.0)
    negated = (x.vocabulary_hits("claim", NEGATIONS) > 0) != (x.vocabulary_hits("evidence", NEGATIONS) > 0)
    return evidence.withColumn("score", share).filter(F.col("score") > relevant_above).withColumn(
        "verdict", F.when(negated, "contradicts").otherwise("supports"))


def fact_verdicts(claims: DataFrame, judged: DataFrame, key: list[str]) -> DataFrame:
    """VERIFIED above 0.6 mean signed score, REFUTED below -0.6, else UNCERTAIN."""
    signed = F.when(F.col("verdict") == "supports", F.col("score")).when(F.col("verdict") == "contradicts", -F.col("score")).otherwise(0.0)
    means = judged.groupBy(*key).agg(F.avg(signed).alias("mean"), F.count(F.lit(1)).alias("n_evidence"))
    j = claims.select(*key).distinct().join(means, key, "left")
    m = F.col("mean")
    return j.select(
        *key, F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"),
        F.when(m > 0.6, "VERIFIED").when(m < -0.6, "REFUTED").otherwise("UNCERTAIN").alias("status"),
        F.when(F.abs(m) > 0.6, F.abs(m)).when(m.isNotNull(), 0.5).otherwise(0.3).alias("confidence"))

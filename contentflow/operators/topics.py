"""Topic extraction: leader clustering, topic summaries, relations and trends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.functions import text as x
from contentflow.operators import tfidf
from contentflow.operators.ordering import numbered, top_per_key
from contentflow.session import cut_lineage, shared_table


BLOCK = 4096  # rows of fixed width that a task compares at a time, and that one task settles in order
GROWTH = 8  # every round looks at so many times the texts of the one before


def _blocks(path: str, doc: str):
    """(ids, matrix) of the rows of a written table, a block at a time."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    system, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(BLOCK, columns=[doc, "vec"]):
                    if batch.num_rows:
                        yield batch.column(doc).to_numpy(), batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1)


def _in_order(doc: str, threshold: float):
    """Leaders among the rows of one block, in id order."""
    def run(batches):
        rows = pd.concat(list(batches)).sort_values(doc)
        ids, vecs, kept = rows[doc].to_numpy(), np.stack(rows["vec"].to_numpy()) if len(rows) else None, []
        for i in range(len(rows)):
            if not kept or (vecs[kept] @ vecs[i]).max() < threshold:
                kept.append(i)
        yield pd.DataFrame({doc: ids[kept], "vec": [vecs[i] for i in kept]})
    return run


def _without_earlier(doc: str, path: str, threshold: float):
    """The rows to which no row of the table at ``path`` with a smaller id is similar."""
    def run(batches):
        for pdf in batches:
            left = pdf
            for ids, mat in _blocks(path, doc):
                if not len(left):
                    break
                sims = np.stack(left["vec"].to_numpy()) @ mat.T
                sims[ids[None, :] >= left[doc].to_numpy()[:, None]] = -1.0
                left = left[sims.max(axis=1) < threshold]
            yield left
    return run


def _show_leaders(doc: str, path: str):
    """Keeps the most similar of the leaders seen so far that come before a text; of equally similar ones the first."""
    def run(batches):
        for pdf in batches:
            rows = np.flatnonzero(pdf["vec"].notna().to_numpy())
            if len(rows):
                key, vecs = pdf[doc].to_numpy()[rows], np.stack(pdf["vec"].to_numpy()[rows])
                best, leader = pdf["similarity"].to_numpy()[rows].copy(), pdf["leader"].to_numpy()[rows].copy()
                for ids, mat in _blocks(path, doc):
                    sims = vecs @ mat.T
                    sims[ids[None, :] > key[:, None]] = -1.0
                    sims[ids[None, :] == key[:, None]] = 2.0  # a leader belongs to itself
                    score = sims.max(axis=1)
                    first = np.where(sims == score[:, None], ids[None, :], np.iinfo(np.int64).max).min(axis=1)
                    better = (score > best) | ((score == best) & (score >= 0) & (first < leader))
                    best[better], leader[better] = score[better], first[better]
                out_best, out_leader = pdf["similarity"].to_numpy().copy(), pdf["leader"].to_numpy().copy()
                out_best[rows], out_leader[rows] = best, leader
                pdf = pdf.assign(similarity=out_best, leader=out_leader)
            yield pdf
    return run


def _independent(undecided: DataFrame, doc: str, threshold: float) -> DataFrame:
    """Leaders among ``undecided`` (doc, vec): those that no earlier leader is similar to.

    Each round settles the first block in order, accepts every later text without a similar undecided text before it,
    and drops what is similar to those accepted. Only the question whether there is a similar text is asked, so no
    pair is ever written, however dense a cluster is."""
    schema, found = undecided.schema, None
    while True:
        left, path = shared_table(undecided, "topic-undecided")
        block, _ = shared_table(left.orderBy(doc).limit(BLOCK), "topic-block")
        edge = block.agg(F.max(doc).alias("m"), F.count(F.lit(1)).alias("n")).first()
        if not edge["n"]:
            return found if found is not None else left
        new = block.coalesce(1).mapInPandas(_in_order(doc, threshold), schema)
        if edge["n"] == BLOCK:
            later = left.filter(F.col(doc) > edge["m"])
            new = new.unionByName(later.mapInPandas(_without_earlier(doc, path, threshold), schema))
        new, accepted = shared_table(new, "topic-accepted")
        found = new if found is None else found.unionByName(new)
        if edge["n"] < BLOCK:
            return found
        undecided = later.join(new.select(doc), doc, "left_anti").mapInPandas(_without_earlier(doc, accepted, threshold), schema)


def leader_clusters(vectors: DataFrame, doc: str, threshold: float = 0.5, max_leaders: int | None = None) -> DataFrame:
    """(doc, label, leader, similarity), equal to going through the texts in id order.

    A text joins the most similar earlier leader when that reaches the threshold, else it becomes a leader while there
    is room (default max(2, n/2)). The leaders are the first independent set, in id order, of the texts that are
    similar to each other. Rounds take the texts up to the ``BLOCK * GROWTH ** r``-th id, drop those similar to a known
    leader and find the leaders among the rest; then all texts are shown the new ones. So the number of rounds follows the
    logarithm of the number of texts, vectors stay in tables of the shared folder that tasks read in blocks, and the driver
    sees counts alone."""
    vectors, _ = shared_table(vectors.select(F.col(doc).cast("bigint").alias(doc), "vec"), "topic-vectors")
    total = vectors.count()
    room = max_leaders if max_leaders is not None else max(2, total // 2)
    with_terms = vectors.filter("vec is not null").select(doc)
    cuts, at = [], BLOCK
    while at < total:
        cuts, at = [*cuts, at], at * GROWTH
    ends = sorted(r[0] for r in numbered(with_terms, [doc], out="_n").filter(F.col("_n").isin(cuts)).select(doc).collect()) if cuts else []
    state = vectors.select(doc, "vec", F.lit(1 << 62).cast("bigint").alias("leader"), F.lit(-1.0).alias("similarity"))
    schema, leaders, count = state.schema, None, 0
    for end in [*ends, None]:
        rows = state.filter(F.col("vec").isNotNull() & (F.col("similarity") < threshold))
        new = _independent((rows if end is None else rows.filter(F.col(doc) <= end)).select(doc, "vec"), doc, threshold)
        new, _ = shared_table(numbered(new, [doc], out="_n").withColumn("label", (F.col("_n") + count - 1).cast("int")).drop("_n"), "topic-numbered")
        new, path = shared_table(new.filter(F.col("label") < room), "topic-leaders")
        leaders = new.select(doc, "label") if leaders is None else leaders.unionByName(new.select(doc, "label"))
        count = leaders.count()
        state, _ = shared_table(state.mapInPandas(_show_leaders(doc, path), schema), "topic-state")
        if count >= room:
            break
    leaders = leaders.withColumnRenamed(doc, "leader")
    first = leaders.agg(F.min("leader")).scalar()
    # texts without any vocabulary term go to the first leader
    return state.withColumn("leader", F.when(F.col("similarity") < 0, first).otherwise(F.col("leader"))).join(leaders, "leader", "left").select(
        doc, F.coalesce("label", F.lit(0)).alias("label"), "leader", F.greatest(F.least("similarity", F.lit(1.0)), F.lit(0.0)).alias("similarity"))


def topic_centres(weights: DataFrame, labels: DataFrame, doc: str) -> DataFrame:
    """(label, term, c): mean vector of the texts of each label, as a sparse table.

    ``labels(doc, label)`` covers every text, also those without terms."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sums = weights.join(labels, doc).groupBy("label", "term").agg(F.sum("w").alias("s"))
    return sums.join(sizes, "label").select("label", "term", (F.col("s") / F.col("n")).alias("c"))


def topic_summary(centres: DataFrame, labels: DataFrame, top: int = 10) -> DataFrame:
    """(label, name, keywords, document_count, confidence)."""
    n = labels.agg(F.count(F.lit(1))).scalar()
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("document_count")).withColumn("_all", n)
    # equal weights are ordered by term; rounding keeps float noise out of the order
    best = top_per_key(centres, ["label"], [F.round("c", 9).desc(), F.col("term").asc()], top)
    words = F.transform(F.sort_array(F.collect_list(F.struct((-F.round("c", 9)).alias("k"), "term"))), lambda s: s["term"])
    named = best.groupBy("label").agg(F.filter(words, lambda w: F.length(w) > 1).alias("keywords"))
    return sizes.join(named, "label", "left").select(
        "label", F.array_join(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 3), " + ").alias("name"), "keywords",
        "document_count", F.least(F.col("document_count") / F.col("_all"), F.lit(1.0)).alias("confidence"))


def topic_scores(weights: DataFrame, centres: DataFrame, labels: DataFrame, doc: str) -> DataFrame:
    """(doc, label, score): cosine of each text with the centre of its own label."""
    norms = centres.groupBy("label").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("_nc"))
    dots = (weights.join(labels, doc).join(centres, ["label", "term"]).groupBy(doc, "label")
            .agg(F.sum(F.col("w") * F.col("c")).alias("_dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_nd")))
    return dots.join(norms, "label").select(doc, "label", (F.col("_dot") / (F.col("_nd") * F.col("_nc"))).alias("score"))


def topic_coherence(topics: DataFrame, scores: DataFrame, at_least: float = 0.3) -> DataFrame:
    """(label, coherence). All keyword pairs of one topic co-occur in the same texts, those
    that belong to it with at least the given score, so no pair has to be listed."""
    strong = scores.filter(F.col("score") >= at_least).groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    return topics.filter(F.size("keywords") > 1).join(strong, "label").select(
        "label", (F.col("_n") / F.col("document_count")).alias("coherence"))


def overall_coherence(per_topic: DataFrame) -> DataFrame:
    return per_topic.agg(F.coalesce(F.avg("coherence"), F.lit(0.0)).alias("coherence"))


def match_topics(docs: DataFrame, topic_words: DataFrame, doc: str, body: str = "text", at_least: float = 0.2) -> DataFrame:
    """(doc, label, overlap, similarity): Jaccard of a text's tokens and a topic's keywords.

    ``topic_words(label, term)``. Texts meet topics on equal terms only."""
    sizes = topic_words.groupBy("label").agg(F.count(F.lit(1)).alias("_nt"))
    toks = docs.select(doc, F.array_distinct(x.tokens(body)).alias("_t"))
    rows = toks.select(doc, F.size("_t").alias("_nd"), F.explode("_t").alias("term"))
    hits = (rows.join(topic_words, "term").groupBy(doc, "label")
            .agg(F.count(F.lit(1)).alias("overlap"), F.max("_nd").alias("_nd")).join(sizes, "label"))
    sim = F.col("overlap") / (F.col("_nt") + F.col("_nd") - F.col("overlap"))
    return hits.select(doc, "label", "overlap", sim.alias("similarity")).filter(F.col("similarity") >= at_least)


def related_topics(topic_words: DataFrame, above: float = 0.1) -> DataFrame:
    """(a, b, similarity) with a != b: mean of keyword Jaccard and partial matches.

    A keyword lies inside another exactly when it equals one of its substrings, so the
    partial matches are an equi-join on substrings instead of all keywords with all."""
    w = topic_words.select("label", "term").distinct()
    n = F.length("term")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        F.sequence(F.lit(1), n - i + 1), lambda k: F.substring("term", i, k))))
    inside = w.filter(n > 0).select(F.col("label").alias("a"), F.col("term").alias("ka"), F.explode(F.array_distinct(cuts)).alias("kb"))
    hits = inside.join(w.select(F.col("label").alias("b"), F.col("term").alias("kb")), "kb").filter(F.col("a") != F.col("b"))
    both = hits.select("a", "ka", "b", "kb").unionByName(
        hits.select(F.col("b").alias("a"), F.col("kb").alias("ka"), F.col("a").alias("b"), F.col("ka").alias("kb"))).distinct()
    sizes = w.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    pairs = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("partial"), F.count_if(F.col("ka") == F.col("kb")).alias("same"))
    j = (pairs.join(sizes.select(F.col("label").alias("a"), F.col("n").alias("na")), "a")
         .join(sizes.select(F.col("label").alias("b"), F.col("n").alias("nb")), "b"))
    exact = F.col("same") / (F.col("na") + F.col("nb") - F.col("same"))
    sim = (exact + F.col("partial") / (F.col("na") + F.col("nb"))) / 2
    return j.select("a", "b", sim.alias("similarity")).filter(F.col("similarity") > above)


def emerging_topics(scores: DataFrame, doc: str, at_least: float = 0.2, growth_above: float = 0.1) -> DataFrame:
    """(label, growth, first_count, last_count, emerging) over chunks of texts in id order."""
    scores = cut_lineage(scores)  # counted, numbered and joined below
    docs = scores.select(doc).distinct()
    n = docs.count()
    size = max(1, n // min(3, n)) if n else 1
    periods = -(-n // size) if n else 0
    placed = numbered(docs, [doc], out="_n").select(doc, F.floor((F.col("_n") - 1) / size).alias("_p"))
    strong = F.col("score") >= at_least
    j = scores.join(placed, doc)
    sums = [F.sum(F.when(strong & (F.col("_p") == i), F.col("score")).otherwise(0.0)).alias(f"f{i}") for i in range(periods)]
    counts = [F.count_if(strong & (F.col("_p") == i)).alias(f"c{i}") for i in range(periods)]
    wide = j.groupBy("label").agg(*sums, *counts)
    steps = [(F.col(f"f{i}") - F.col(f"f{i-1}")) / F.greatest(F.col(f"f{i-1}"), F.lit(0.01)) for i in range(1, periods)]
    growth = F.array_max(F.array(*steps)) if steps else F.lit(0.0)
    if n < 2:
        return wide.select("label").withColumns({"growth": F.lit(0.0), "first_count": F.lit(0), "last_count": F.lit(0), "emerging": F.lit(False)})
    total = sum((F.col(f"c{i}") for i in range(periods)), F.lit(0))
    first, last = F.col("c0"), F.col(f"c{periods - 1}")
    return wide.withColumn("growth", growth).select(
        "label", "growth", first.alias("first_count"), last.alias("last_count"),
        ((F.col("growth") > growth_above) & (total >= 1) & (last >= first)).alias("emerging"))


def ranked_topics(topics: DataFrame) -> DataFrame:
    """Most texts first, then confidence; equal ones by label."""
    keyed = topics.withColumns({"_a": -F.col("document_count"), "_b": -F.col("confidence")})
    return numbered(keyed, ["_a", "_b", "label"], out="place").drop("_a", "_b")


def extract_topics(docs: DataFrame, doc: str, body: str = "text", max_features: int = 100) -> dict[str, DataFrame]:
    """Clusters, topics and scores of a corpus."""
    words = tfidf.corpus_words(docs, [doc], body)
    vocab = cut_lineage(tfidf.corpus_vocabulary(docs, body, max_features, words=words))
    weights, _ = shared_table(tfidf.corpus_weights(docs, doc, vocab, body, words=words), "topic-weights")
    labels, _ = shared_table(leader_clusters(tfidf.corpus_vectors(words, doc, vocab), doc), "topic-labels")
    pairs = labels.select(doc, "label")
    centres = topic_centres(weights, pairs, doc)
    topics = topic_summary(centres, pairs)
    return {"labels": labels, "topics": topics, "scores": topic_scores(weights, centres, pairs, doc)}

"""Text measures on the small cases with known results."""

import re
import string
import time
import unicodedata
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from contentflow.functions import rules
from contentflow.functions import text as x
from contentflow.functions.mentions import _automaton, phrase_mentions, running_sum, walk
from contentflow.operators import knowledge, quality, summaries
from contentflow.vocab import ENGLISH_STOP_WORDS, LANGUAGE_PROFILES


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("v")).first().v


@pytest.mark.parametrize("places", [2, 6])
def test_rounded_is_round(spark, places):
    """Ties in binary and in decimal numbers, values beside them, large and odd ones; few of the common ones go through a decimal number."""
    values = [0.5078125, 0.5015625, 0.50156250000001, 0.50156249999999, 0.125, 0.135, 1.005, -0.125, -0.135, -0.5078125, -1e-9, 0.0, -0.0, 1.0, 0.1 + 0.2, 1e5 + 0.1234565,
              1e9 + 0.015, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), None, *(k / 640 for k in range(-640, 641)), *(k / 2e6 + 5e-7 for k in range(300))]
    df = spark.createDataFrame([(v,) for v in values], "v double").unionByName(spark.range(20000).select((F.rand(1) * 3 - 1).alias("v")))
    assert df.filter(~x.rounded("v", places).eqNullSafe(F.round("v", places))).count() == 0
    assert df.filter(x.rounded("v", places).isNull() != F.col("v").isNull()).count() == 0


@pytest.mark.parametrize("word,n", [("hello", 2), ("world", 1), ("beautiful", 3), ("programming", 3), ("the", 1), ("table", 2), ("degree", 1),
                                    ("rhythm", 1), ("be", 1), ("ale", 1), ("tree able", 3), ("", 0)])
def test_syllables(spark, word, n):
    assert one(spark, word, x.syllables("text")) == n


def test_readability(spark):
    assert one(spark, "", x.flesch_by_groups("text")) == 0.0
    assert one(spark, "...", x.flesch_by_letters("text")) == 0.0
    assert one(spark, "This is one sentence. This is another! And a third?", x.terminal_sentence_count("text")) == 3
    assert one(spark, "Hello, world! How's it going?", x.clean_for_reading("text")) == "Hello world Hows it going"
    assert one(spark, "   ", x.readability_with_penalties("text")) == 0.8
    assert one(spark, "", x.readability_with_penalties("text")) == 0.0
    assert one(spark, "one two three", x.coherence("text")) == 1.0
    assert one(spark, "the cat. the dog", x.coherence("text")) == pytest.approx(1 / 3)


def test_quality(spark):
    text = "The cat saw a cat. The cat liked the cat. A cat is a cat."
    row = quality.score_quality(spark.createDataFrame([(text,), ("  ",)], "text string")).collect()
    by = {r.text: r for r in row}
    assert "excessive_repetition" in by[text].quality_flags and "insufficient_length" in by[text].quality_flags
    assert 0 <= by[text].overall_score <= 1 and by["  "].error == "empty text" and by["  "].overall_score is None
    dense = "On January 15, 2024, Acme Corp opened in New York for $5,000 at 10%."
    sparse = "they went there and did some things again"
    d = [quality.text_profile(spark.createDataFrame([(t,)], "text string")).select(
        x.fact_density_of("_ents", "_numbers", F.size("_tok")).alias("v")).first().v for t in (dense, sparse)]
    assert d[0] > 0.5 and d[1] == 0.0


def test_language_and_labels(spark):
    df = spark.createDataFrame([("the house and the garden of it",), ("der Hund und die Katze",), ("zzz",)], "text string")
    assert [r[0] for r in df.select(x.language_of(x.tokens("text"), LANGUAGE_PROFILES)).collect()] == ["en", "de", "en"]
    assert one(spark, "Machine learning models have achieved 95% accuracy.", rules.fact_category("text")) == "STATISTICAL"
    assert one(spark, "AI developments in recent years have been significant.", rules.fact_category("text")) == "TEMPORAL"
    assert one(spark, "", x.relevance("text", F.lit("body"))) == 0.8
    assert one(spark, "Machine progress", x.relevance("text", F.lit("progress of the machine"))) == 1.0


def test_mentions_follow_the_length_of_the_text():
    """One walk: ten times the text with ten times the mentions takes about ten times as long, whatever the number of phrases."""
    phrases = ["ab", *[f"word{i}" for i in range(20_000)]]
    automaton = _automaton(phrases)

    def took(n):
        start = time.process_time()
        found = walk(automaton, "ab " * n, "ab " * n, 50)
        assert len(found) == n and found[-1][1] == 3 * (n - 1)
        return time.process_time() - start

    took(5_000)
    assert took(50_000) < 40 * max(took(5_000), 0.004)


def test_running_sums(spark):
    assert spark.createDataFrame([([1, 0, 5],), ([],), (None,)], "v array<int>").select(running_sum("v")).collect() == [([1, 1, 6],), ([],), (None,)]


def test_mentions(spark):
    text = "Apple met apple. Pineapple"
    found = one(spark, text, phrase_mentions(spark, "text", ["apple", "pear", "APP", "ppl", ""], 2))
    assert sorted(map(tuple, found)) == sorted(
        [(0, s, text[max(0, s - 2): s + 7]) for s in (0, 10, 21)] + [(2, s, text[max(0, s - 2): s + 5]) for s in (0, 10, 21)]
        + [(3, s, text[max(0, s - 2): s + 5]) for s in (1, 11, 22)])
    assert one(spark, text, phrase_mentions(spark, "text", ["pear"])) == [] == one(spark, "", phrase_mentions(spark, "text", []))
    assert one(spark, "aaaaa", F.transform(phrase_mentions(spark, "text", ["aa"]), lambda m: m["start"])) == [0, 2]
    custom = knowledge.with_custom_entities(spark.createDataFrame([(1, "we use apple inc and Apple Park daily")], "d long, text string"), [("ORG", "apple")], ["d"])
    assert [(r.label, r.start) for r in custom.collect()] == [("ORG", 7)]
    assert one(spark, "alpha beta", x.source_context(F.lit("beta"), "text")) == "alpha beta"
    assert one(spark, "beta alpha gamma", x.source_context(F.lit("gamma alpha beta"), "text")) == "beta alpha gamma"
    assert one(spark, "beta alpha gamma", x.source_context(F.lit("delta"), "text")) is None


def test_sentiment_and_verdicts(spark):
    df = spark.createDataFrame([(1, "Great quality product. The service was terrible")], "d long, text string")
    s = knowledge.document_sentiment(df).first()
    assert s.overall == 0.0 and [r.score for r in s.sentences] == [1.0, -1.0] and s.positive == pytest.approx(1 / 7)
    a = knowledge.aspect_sentiment(df, {"quality": ["quality"], "value": ["worth"]}, ["d"]).collect()
    assert [(r.aspect, r.sentiment) for r in a] == [("quality", 1.0)]
    claims = spark.createDataFrame([(1,), (2,), (3,), (4,)], "d long")
    judged = spark.createDataFrame([(1, "supports", 0.9), (2, "contradicts", 0.8), (3, "supports", 0.9), (3, "contradicts", 0.9)], "d long, verdict string, score double")
    v = {r.d: (r.status, round(r.confidence, 6)) for r in knowledge.fact_verdicts(claims, judged, ["d"]).collect()}
    assert v == {1: ("VERIFIED", 0.9), 2: ("REFUTED", 0.8), 3: ("UNCERTAIN", 0.5), 4: ("UNCERTAIN", 0.3)}


def test_summaries_and_model_hook(spark):
    df = spark.createDataFrame([(1, "Cats sleep. Cats eat fish. Dogs bark loudly at night"), (2, "One two three")], "d long, text string")
    s = {r.d: r.summary for r in summaries.extractive_summary(df, ["d"], max_words=5).collect()}
    assert s[1] == "Cats sleep. Cats eat fish" and s[2] == "One two three"
    plain = {r.d: r.summary for r in summaries.abstractive_summary(df, ["d"], max_words=5).collect()}
    assert plain == s
    hooked = {r.d: r.summary for r in summaries.abstractive_summary(df, ["d"], model=lambda ts: [t.upper() for t in ts]).collect()}
    assert hooked[2] == "ONE TWO THREE"


def test_default_taxonomy(spark):
    nodes, words = knowledge.default_taxonomy(spark)
    ai = knowledge.find_category(nodes, "AI")
    assert [(r.ancestor, r.depth) for r in knowledge.ancestors(nodes, ai).collect()] == [("technology", 1)]
    assert {r.category for r in knowledge.children(nodes, "business").collect()} == {"finance", "startups"}
    kw = {r.keyword for r in knowledge.inherited_keywords(nodes, words, ai).collect()}
    assert {"deep learning", "software"} <= kw
    assert knowledge.ancestors(nodes, knowledge.find_category(nodes, "none")).count() == 0


def test_cyclic_taxonomy(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "category string, parent string")
    with pytest.raises(ValueError):
        knowledge.ancestors(loop, loop.filter("category = 'a'"))
    deep = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(12)], "category string, parent string")
    assert knowledge.ancestors(deep, deep.filter("category = 'n11'")).count() == 11


def test_summary_of_a_group_of_texts(spark):
    docs = spark.createDataFrame([("g", 1, "Cats chase mice. Dogs sleep."), ("g", 2, "Cats like cats. Birds sing."), ("h", 1, "Only one here.")],
                                 "k string, n int, text string")
    rows = summaries.ranked_sentences(docs, ["k"], order="n").collect()
    assert len(rows) == 5 and len({(r.k, r.pos) for r in rows}) == 5
    score = {r.sentence.rstrip("."): r.score for r in rows}
    assert score["Cats like cats"] > score["Cats chase mice"] > score["Dogs sleep"]
    out = {r.k: r.summary for r in summaries.extractive_summary(docs, ["k"], max_words=6, order="n").collect()}
    assert set(out) == {"g", "h"} and out["g"].startswith("Cats chase mice") and "Cats like cats" in out["g"]


def test_words_of_a_batch_are_counted_a_part_at_a_time(monkeypatch):
    """Numpy holds the words of few texts of a batch at a time, and the scores are those of the whole batch."""
    import random

    import pyarrow as pa

    rng = random.Random(2)
    texts = [[rng.choices("abcdef", k=rng.randrange(5)) for _ in range(rng.randrange(6))] for _ in range(40)] + [None, [], [["a"] * 500]]
    want = [[sum(sum(w in s for s in [x]) * sum(y.count(w) for y in t) for w in x) / len(x) if x else 0.0 for x in t] for t in [t or [] for t in texts]]
    held = []
    means = summaries._means
    monkeypatch.setattr(summaries, "PART_WORDS", 20)
    monkeypatch.setattr(summaries, "_means", lambda part: held.append(sum(len(s) for t in part.to_pylist() for s in t or [])) or means(part))
    batch = pa.array([None, *texts], pa.list_(pa.list_(pa.string()))).slice(1)
    got = next(iter(summaries.mean_frequencies.func(iter([batch])))).to_pylist()
    assert got == [pytest.approx(w) for w in want]
    assert len(held) > 5 and max(held[:-1]) <= 20 and sum(held) == sum(len(s) for t in texts for s in t or [])


def test_near_facts_cost_no_full_edit_distance(spark):
    """Equal to the plain distance of the sorted words; words in common at both ends are left out before it is computed."""
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, q in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
        return row[-1]

    rng = random.Random(4)
    words = ["a", "ab", "abc", "b", "bcd", "cd", "é", "zz"]
    lists = [(sorted(rng.choices(words, k=rng.randrange(1, 6))), sorted(rng.choices(words, k=rng.randrange(1, 6)))) for _ in range(200)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(lists)], "i int, a array<string>, b array<string>")
    got = {r.i: r.v for r in df.select("i", x.word_list_distance(F.col("a"), F.col("b"), F.lit(99)).alias("v")).collect()}
    assert got == {i: plain(" ".join(a), " ".join(b)) for i, (a, b) in enumerate(lists)}
    near = {r.i: r.v for r in df.select("i", x.source_context(F.concat(F.lit("!"), F.array_join("a", " ")), F.array_join("b", " ")).alias("v")).collect()}
    ok = {i: 100 * (1 - plain(" ".join(a), " ".join(b)) / max(len(" ".join(a)), len(" ".join(b)))) > 80 for i, (a, b) in enumerate(lists)}
    assert near == {i: " ".join(lists[i][1]) if ok[i] else None for i in ok}
    long = " ".join(f"w{i}" for i in range(40_000))
    start = time.time()
    assert one(spark, long, x.source_context(F.concat("text", F.lit(" tail")), "text")) == long
    assert time.time() - start < 60


def test_entities_scan_finds_what_the_pattern_finds(spark):
    texts = ["$1,200.50 and $5. and $7.x, 12.5% of 12%% 3.4.5% 2024-01-02 12024-01-023", "May 3, 2024 May 33, 20245 Jane Doe Smith McDonald Ann Lee A b XAnn Lee",
             "Ann\nLee Ann  Lee Élan Vital 9" * 3, "", "1" * 3000, "Ann Lee " * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", x.entities("text").alias("e"))
    assert all(r.e == [m.group() for m in re.finditer(x.ENTITY_RE, r.text)] for r in df.collect())


def test_category_evidence_is_cut_once_and_not_shuffled_by_keyword(spark):
    from __spark_entry__ import queries

    names = ("E4_keyword_taxonomy_join", "H24_normalised_category_scores", "G9_category_ranking")
    for name in names:
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        assert plan.optimizedPlan().toString().count("January|February") == 1, name
        assert not re.search(r"hashpartitioning\(doc_id#\d+L?, keyword", plan.executedPlan().toString()), name


def test_category_matches_sum_repeated_evidence(spark):
    docs = spark.createDataFrame([(1, ["A b"], ["a b", "c"], ["c", "c", "none"]), (2, [], [], ["none"]), (3, None, ["c"], [])],
                                 "d long, keywords array<string>, entities array<string>, phrases array<string>")
    tax = spark.createDataFrame([("a b", "travel"), ("c", "travel"), ("c", "health")], "keyword string, category string")
    got = {(r.d, r.category): round(r.score, 9) for r in knowledge.category_matches(docs, tax, "d").collect()}
    assert got == {(1, "travel"): 3.8, (1, "health"): 2.0}
    assert knowledge.categorise(docs, tax, "d").count() == 3


def test_quality_cuts_each_text_once(spark):
    from __spark_entry__ import queries

    plan = queries()["H39_overall_quality"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"lower\(text#\d+\)", plan)) == 1
    assert plan.count(f"{x.TOKEN_RE}, 0)") == 2 and f"regexp_count(text, {x.TOKEN_RE})" not in plan


def test_quality_arrays_on_odd_texts(spark):
    texts = ["...Ein Élan 9a! the Cat's | hat?? - . \x0b . and  good\tnews\nx1y", "", " . ! ", "A", None, "\U0001d400b C² ٣ the the. Of", "a  b\f\tthe \r\nc||d | e"]
    p = quality.text_profile(spark.createDataFrame([(t,) for t in texts], "text string")).select(
        "text", "_shapes", "_phrases", "_lengths", "_marked", "_tok", "_stok").collect()

    def runs(s, kinds):
        return ["".join(g) for inside, g in groupby(s, lambda c: unicodedata.category(c)[0] in kinds) if inside]

    def shape(s):
        return "".join("N" if w[0] in string.digits else "C" if w[0] in string.ascii_uppercase else "w" for w in runs(s, "LN"))

    def phrases(text):
        kind = lambda c: "l" if unicodedata.category(c)[0] == "L" else " " if c in x.WS else "|"
        words = [(k, "".join(g)) for k, g in groupby(text.lower(), kind)]
        line = " ".join("|" if k == "|" or w in ENGLISH_STOP_WORDS else w for k, w in words if k != " ")
        return [w.strip() for w in line.split("|") if w.strip()]

    for r in p:
        if r.text is not None:
            pieces = [s.strip(x.WS) for s in re.split("[.!?]+", r.text) if s.strip(x.WS)]
            assert r._shapes == [shape(s) for s in pieces] and r._phrases == phrases(r.text)
            assert len(r._marked) == len(pieces) and r._lengths == [len(s) for s in r._shapes] and sum(r._stok, []) == r._tok
    empty = next(r for r in quality.score_quality(spark.createDataFrame([(None,)], "text string")).collect())
    assert empty.readability_score == 0.0 and empty.coherence_score is None and empty.error == "empty text"

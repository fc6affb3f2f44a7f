"""Readability, coherence, quality, keyword and summary queries over whole texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contentflow.functions import text as x
from contentflow.operators import normalize, quality, summaries
from contentflow.operators.ordering import top_per_key
from contentflow.plans.registry import query
from contentflow.sources.views import CHAT_SQL
from contentflow.vocab import ENGLISH_STOP_WORDS, LANGUAGE_PROFILES, NEGATIVE_WORDS, POSITIVE_WORDS


def r6(c, name):
    return F.round(c, 6).alias(name)


WS = "' ' || chr(9)||chr(10)||chr(13)||chr(12)"


def in_list(words):
    return "(" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


STOP = in_list(ENGLISH_STOP_WORDS)
POS, NEG = in_list(POSITIVE_WORDS), in_list(NEGATIVE_WORDS)


def words_sql(c):
    return f"len(regexp_extract_all({c}, '[^ \\t\\n\\r\\f]+'))"


def tok_sql(c):
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"


def ntok_sql(c):
    return f"len(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+'))"


def sents_sql(c):
    return f"list_filter(list_transform(string_split_regex({c}, '[.!?]+'), lambda s: trim(s, {WS})), lambda s: s <> '')"


def ideal_sql(c):
    return f"(CASE WHEN {words_sql(c)} > 0 THEN 1 - least(abs({words_sql(c)}::DOUBLE / len(string_split({c}, '. ')) - 15)/10, 1.0) ELSE 0 END)"


def flesch_sql(w, s, v):
    return f"(CASE WHEN {w} > 0 AND {s} > 0 THEN least(greatest(206.835 - 1.015*({w}::DOUBLE/{s}) - 84.6*({v}::DOUBLE/{w}), 0), 100) ELSE 0 END)"


CLEAN_SQL = f"trim(regexp_replace(text, '[^a-zA-Z \\t\\n\\r\\f.]', '', 'g'), {WS})"
SYLL_SQL = """list_transform(regexp_extract_all(lower(c), '[^ \\t\\n\\r\\f]+'), lambda w: CASE WHEN
 len(regexp_extract_all(w,'[aeiouy]+')) - ends_with(w,'e')::INT + regexp_matches(w,'[^aeiouy]le$')::INT = 0 THEN 1 ELSE
 len(regexp_extract_all(w,'[aeiouy]+')) - ends_with(w,'e')::INT + regexp_matches(w,'[^aeiouy]le$')::INT END)"""


@query("H15_flesch_syllable_groups", f"""
WITH a AS (SELECT doc_id, {CLEAN_SQL} AS c FROM documents), b AS (SELECT doc_id, {words_sql('c')} AS w,
 len(list_filter(string_split_regex(c, '[.!?]+'), lambda s: trim(s, {WS}) <> '')) AS s, coalesce(list_sum({SYLL_SQL}),0) AS v FROM a)
SELECT doc_id, CAST(v AS BIGINT) AS syllables, round({flesch_sql('w', 's', 'v')}, 6) AS flesch FROM b""")
def flesch_groups(t):
    d = t.documents().select("doc_id", x.clean_for_reading("text").alias("c"))
    d = d.select("doc_id", x.syllables("c").alias("v"), x.word_count("c").alias("w"), x.terminal_sentence_count("c").alias("s"))
    return d.select("doc_id", F.col("v").cast("bigint").alias("syllables"), r6(x.flesch(F.col("w"), F.col("s"), F.col("v")), "flesch"))


@query("H16_flesch_vowel_letters", f"""
WITH b AS (SELECT doc_id, {ntok_sql('text')} AS w, len({sents_sql('text')}) AS s, len(regexp_extract_all(lower(text),'[aeiou]')) AS v FROM documents)
SELECT doc_id, round({flesch_sql('w', 's', 'v')}, 6) AS flesch, round({flesch_sql('w', 's', 'v')}/100, 6) AS normalised FROM b""")
def flesch_letters(t):
    f = x.flesch_by_letters("text")
    return t.documents().select("doc_id", r6(f, "flesch"), r6(f / 100, "normalised"))


@query("H17_readability_ideal_length", f"SELECT doc_id, round({ideal_sql('text')}, 6) AS readability FROM documents")
def ideal_length(t):
    return t.documents().select("doc_id", r6(x.readability_ideal_length("text"), "readability"))


@query("H18_readability_penalties", f"""
WITH b AS (SELECT doc_id, text, {words_sql('text')} AS w, len(string_split(text,'.')) AS s, length(regexp_replace(text,'[ \\t\\n\\r\\f]+','','g')) AS ch FROM documents)
SELECT doc_id, round(CASE WHEN length(text)=0 THEN 0 WHEN w=0 THEN 0.8 ELSE
 least(greatest(1 - (greatest(0,(w::DOUBLE/s-20)/20) + greatest(0,(ch::DOUBLE/w-6)/4))/2, 0), 1) END, 6) AS readability FROM b""")
def penalties(t):
    return t.documents().select("doc_id", r6(x.readability_with_penalties("text"), "readability"))


@query("H19_text_statistics", f"""
WITH b AS (SELECT doc_id, {words_sql('text')} AS w, len(string_split(text,'.')) AS s, length(regexp_replace(text,'[ \\t\\n\\r\\f]+','','g')) AS ch FROM documents)
SELECT doc_id, CAST(w AS BIGINT) AS word_count, CAST(s AS BIGINT) AS sentence_count, round(w::DOUBLE/greatest(s,1),6) AS avg_words_per_sentence, round(ch::DOUBLE/greatest(w,1),6) AS avg_word_length FROM b""")
def text_statistics(t):
    w, s = x.word_count("text"), F.size(F.split("text", r"\."))
    chars = F.length(F.regexp_replace("text", x.WS_RE, ""))
    return t.documents().select("doc_id", w.cast("bigint").alias("word_count"), s.cast("bigint").alias("sentence_count"),
                                r6(w / F.greatest(s, F.lit(1)), "avg_words_per_sentence"), r6(chars / F.greatest(w, F.lit(1)), "avg_word_length"))


@query("H20_clean_text", f"""
SELECT doc_id, {CLEAN_SQL} AS cleaned, CAST(len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: trim(s, {WS}) <> '')) AS BIGINT) AS sentence_count FROM documents""")
def clean_text(t):
    return t.documents().select("doc_id", x.clean_for_reading("text").alias("cleaned"), x.terminal_sentence_count("text").cast("bigint").alias("sentence_count"))


@query("H21_sentences", f"""
SELECT doc_id, CAST(unnest(range(len(s))) AS BIGINT) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {sents_sql('text')} AS s FROM documents)""")
def sentence_rows(t):
    return t.documents().select("doc_id", F.posexplode(x.sentences("text")).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("bigint"))


@query("H22_content_tokens", f"""
SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({tok_sql('text')}) AS token FROM documents) WHERE token NOT IN {STOP} GROUP BY 1, 2""")
def content_token_counts(t):
    return t.documents().select("doc_id", F.explode(x.content_tokens("text")).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


LANG_COUNTS = ", ".join(f"len(list_filter(tok, lambda w: w IN {in_list(ws)})) AS {lang}" for lang, ws in sorted(LANGUAGE_PROFILES.items()))


@query("H23_language", f"""
WITH a AS (SELECT doc_id, lang, {tok_sql('text')} AS tok FROM documents), b AS (SELECT doc_id, lang AS stated, {LANG_COUNTS} FROM a)
SELECT stated, CASE WHEN greatest(de,en,es,fr)=0 THEN 'en' WHEN de=greatest(de,en,es,fr) THEN 'de' WHEN en=greatest(de,en,es,fr) THEN 'en'
 WHEN es=greatest(de,en,es,fr) THEN 'es' ELSE 'fr' END AS language, count(*) AS n FROM b GROUP BY 1, 2""")
def language(t):
    """Function-word profile against the stated language."""
    d = t.documents().select(F.col("lang").alias("stated"), x.tokens("text").alias("tok"))
    return d.select("stated", x.language_of("tok", LANGUAGE_PROFILES).alias("language")).groupBy("stated", "language").agg(F.count(F.lit(1)).alias("n"))


PAIRS_SQL = CHAT_SQL + """,
pairs AS (SELECT a.group_id, a.pos, a.text AS first, b.text AS second FROM chat a JOIN chat b ON b.group_id=a.group_id AND b.pos=a.pos+1)"""


def turn_pairs(t):
    """Each turn with the next one of the same conversation."""
    c = t.chat()
    return (c.select("group_id", "pos", F.col("text").alias("first"))
            .join(c.select("group_id", (F.col("pos") - 1).alias("pos"), F.col("text").alias("second")), ["group_id", "pos"]))


def jac_sql(a, b):
    return f"(CASE WHEN len(list_distinct(list_concat({a},{b}))) > 0 THEN len(list_intersect({a},{b}))::DOUBLE / len(list_distinct(list_concat({a},{b}))) ELSE 0 END)"


@query("H25_summary_agreement", "WITH " + PAIRS_SQL + f""",
w AS (SELECT *, list_distinct(regexp_extract_all(lower(first),'[^ \\t\\n\\r\\f]+')) AS a, list_distinct(regexp_extract_all(lower(second),'[^ \\t\\n\\r\\f]+')) AS b FROM pairs)
SELECT group_id, pos, round(least(greatest(0.4*{jac_sql('a', 'b')} + 0.3*(CASE WHEN greatest({words_sql('first')},{words_sql('second')})>0 THEN least({words_sql('first')},{words_sql('second')})::DOUBLE/greatest({words_sql('first')},{words_sql('second')}) ELSE 0 END)
 + 0.3*({ideal_sql('first')}+{ideal_sql('second')})/2, 0), 1), 6) AS confidence FROM w""")
def summary_agreement(t):
    return turn_pairs(t).select("group_id", "pos", r6(x.agreement_confidence("first", "second"), "confidence"))


SUMMARY_SQL = "CASE WHEN length(text) <= 200 THEN text ELSE substring(text,1,200) || '...' END"


def coh_sql(c):
    pieces = f"string_split({c}, '. ')"
    sets = f"list_transform({pieces}, lambda s: list_distinct(regexp_extract_all(lower(s),'[^ \\t\\n\\r\\f]+')))"
    return f"coherence_of({sets})"


def neighbour_mean_sql(sets):
    """Mean Jaccard of neighbours in a list column named ``sets``; null when none is usable."""
    return f"""list_avg(list_transform(list_filter(range(1, len({sets})), lambda i: len({sets}[i])>0 AND len({sets}[i+1])>0),
 lambda i: len(list_intersect({sets}[i],{sets}[i+1]))::DOUBLE/len(list_distinct(list_concat({sets}[i],{sets}[i+1])))))"""


SETS_SQL = "list_transform(string_split({c}, '. '), lambda s: list_distinct(regexp_extract_all(lower(s),'[^ \\t\\n\\r\\f]+')))"


@query("G11_coherence", f"""
WITH s AS (SELECT doc_id, {SETS_SQL.format(c='text')} AS sets FROM documents)
SELECT doc_id, round(CASE WHEN len(sets) < 2 THEN 1.0 ELSE coalesce({neighbour_mean_sql('sets')}, 0.5) END, 6) AS coherence FROM s""")
def coherence(t):
    return t.documents().select("doc_id", r6(x.coherence("text"), "coherence"))


@query("H27_summary_record", f"""
WITH d AS (SELECT doc_id, text, CASE WHEN {words_sql('text')} <= 3 THEN text ELSE {SUMMARY_SQL} END AS s FROM documents WHERE trim(text,{WS}) <> ''),
e AS (SELECT *, {words_sql('text')} AS n, {words_sql('s')} AS m, {SETS_SQL.format(c='s')} AS sets FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS original_length, CAST(m AS BIGINT) AS summary_length, round(CASE WHEN n<=3 THEN 1.0 ELSE m::DOUBLE/n END, 6) AS compression_ratio,
 round({ideal_sql('s')}, 6) AS readability_score, round(CASE WHEN n<=3 OR len(sets) < 2 THEN 1.0 ELSE coalesce({neighbour_mean_sql('sets')}, 0.5) END, 6) AS coherence_score FROM e""")
def summary_record(t):
    d = t.documents().select("doc_id", "text", x.short_summary("text").alias("summary"))
    out = summaries.summary_record(d, "text", "summary")
    return out.select("doc_id", "original_length", "summary_length", r6(F.col("compression_ratio"), "compression_ratio"),
                      r6(F.col("readability_score"), "readability_score"), r6(F.col("coherence_score"), "coherence_score"))


TOKSETS_SQL = f"list_transform({sents_sql('text')}, lambda s: list_distinct({tok_sql('s')}))"


def SHIFT_SQL(sets):
    return f"""list_transform(range(1, len({sets})), lambda i: CASE WHEN len({sets}[i])=0 OR len({sets}[i+1])=0 THEN 0
 ELSE len(list_intersect({sets}[i],{sets}[i+1]))::DOUBLE/len(list_distinct(list_concat({sets}[i],{sets}[i+1]))) END)"""


SHIFT_VALUE = """(CASE WHEN len(sets) < 2 THEN 1.0 ELSE coalesce(least(greatest((list_avg(sc) + 1 - len(list_filter(sc, lambda v: v < 0.3))::DOUBLE/len(sc))/2, 0), 1), 0.5) END)"""


@query("G12_topic_shift_coherence", f"""
WITH s AS (SELECT doc_id, {TOKSETS_SQL} AS sets FROM documents), c AS (SELECT doc_id, sets, {SHIFT_SQL('sets')} AS sc FROM s)
SELECT doc_id, round({SHIFT_VALUE}, 6) AS coherence FROM c""")
def shift_coherence(t):
    return t.documents().select("doc_id", r6(x.shift_coherence("text"), "coherence"))


MARKED_SENTS = f"list_filter(list_transform(regexp_extract_all(text,'[^.!?]+[.!?]*'), lambda s: trim(s,{WS})), lambda s: regexp_matches(s,'[^ \\t\\n\\r\\f.!?]'))"
ENGAGE_CTE = f"""
g AS (SELECT *, {MARKED_SENTS} AS ms, list_filter(tok, lambda w: regexp_matches(w,'^\\p{{L}}+$')) AS al FROM base),
g2 AS (SELECT *, list_transform(ms, lambda s: {ntok_sql('s')}::DOUBLE) AS ls FROM g),
eng AS (SELECT *, least(greatest(0.4*(CASE WHEN len(al)>0 THEN len(list_distinct(al))::DOUBLE/len(al) ELSE 0 END)
 + 0.2*least(coalesce(greatest(list_avg(list_transform(ls, lambda v: v*v)) - list_avg(ls)*list_avg(ls), 0), 0)/100, 1.0)
 + 0.4*least(2*(CASE WHEN len(ms)>0 THEN len(list_filter(ms, lambda s: ends_with(s,'?') OR ends_with(s,'!')))::DOUBLE/len(ms) ELSE 0 END), 1.0), 0), 1) AS engagement_score FROM g2)"""
BASE_CTE = f"base AS (SELECT doc_id, text, {tok_sql('text')} AS tok FROM documents)"


@query("H35_engagement", f"WITH {BASE_CTE}, {ENGAGE_CTE} SELECT doc_id, round(engagement_score, 6) AS engagement FROM eng")
def engagement(t):
    p = quality.text_profile(t.documents().select("doc_id", "text"))
    return p.select("doc_id", r6(x.engagement_of("_marked", "_alpha", "_lengths"), "engagement"))


PHRASES_SQL = f"""list_filter(list_transform(string_split(array_to_string(list_transform(regexp_extract_all(lower(text), '\\p{{L}}+|[^\\p{{L}} \\t\\n\\r\\f]+'),
 lambda w: CASE WHEN w IN {STOP} OR NOT regexp_matches(w,'^\\p{{L}}') THEN '|' ELSE w END), ' '), '|'), lambda p: trim(p,{WS})), lambda p: p <> '')"""
SHAPES_SQL = f"""list_transform({sents_sql('text')}, lambda s: array_to_string(list_transform(regexp_extract_all(s,'[\\p{{L}}\\p{{N}}]+'),
 lambda w: CASE WHEN regexp_matches(w,'^[0-9]') THEN 'N' WHEN regexp_matches(w,'^[A-Z]') THEN 'C' ELSE 'w' END), ''))"""
ORIG_VALUE = """least(greatest(0.6*(CASE WHEN len(ph)>0 THEN len(list_distinct(ph))::DOUBLE/len(ph) ELSE 0 END) + 0.4*(CASE WHEN len(sh)>0 THEN len(list_distinct(sh))::DOUBLE/len(sh) ELSE 0 END), 0), 1)"""


@query("H36_originality", f"WITH o AS (SELECT doc_id, {PHRASES_SQL} AS ph, {SHAPES_SQL} AS sh FROM documents) SELECT doc_id, round({ORIG_VALUE}, 6) AS originality FROM o")
def originality(t):
    p = quality.text_profile(t.documents().select("doc_id", "text"))
    return p.select("doc_id", r6(x.originality_of("_phrases", "_shapes"), "originality"))


ENT_SQL = f"regexp_extract_all(text, '{x.ENTITY_RE}')"
LABEL_SQL = """(CASE WHEN starts_with({e},'$') THEN 'MONEY' WHEN ends_with({e},'%') THEN 'PERCENT' WHEN regexp_matches({e},'[0-9]') THEN 'DATE'
 WHEN regexp_matches({e},' (Inc|Corp|Ltd|Company|University)$') THEN 'ORG' ELSE 'PERSON' END)"""
FACT_VALUE = f"""(CASE WHEN nt > 0 THEN least(3.0*(len(ents) + nums + len(list_filter(ents, lambda e: {LABEL_SQL.format(e='e')} IN ('DATE','GPE','ORG','MONEY','PERCENT'))))/nt, 1.0) ELSE 0 END)"""


@query("H37_fact_density", f"""
WITH f AS (SELECT doc_id, {ENT_SQL} AS ents, len(regexp_extract_all(text,'[0-9]+')) AS nums, {ntok_sql('text')} AS nt FROM documents)
SELECT doc_id, round(({FACT_VALUE})::DOUBLE, 6) AS fact_density FROM f""")
def fact_density(t):
    p = quality.text_profile(t.documents().select("doc_id", "text"))
    return p.select("doc_id", r6(x.fact_density_of("_ents", "_numbers", F.size("_tok")), "fact_density"))


def content_cte(src):
    return f"cw AS (SELECT *, list_filter(tok, lambda w: regexp_matches(w,'^\\p{{L}}+$') AND w NOT IN {STOP}) AS cwords FROM {src})"


TOP_SQL = "coalesce(list_max(map_values(list_histogram(cwords))), 0)"


@query("F19_word_repetition", f"""
WITH {BASE_CTE}, {content_cte('base')},
c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(cwords) AS w FROM cw) GROUP BY 1, 2),
m AS (SELECT doc_id, max(n) AS top FROM c GROUP BY 1)
SELECT b.doc_id, CAST(coalesce(m.top,0) AS BIGINT) AS top_count, coalesce(m.top,0) > len(b.tok)*0.1 AS repetitive FROM base b LEFT JOIN m USING (doc_id)""")
def word_repetition(t):
    p = quality.text_profile(t.documents().select("doc_id", "text"))
    top = F.coalesce(x.most_repeated("_content"), F.lit(0))
    return p.withColumn("top", top).select("doc_id", F.col("top").cast("bigint").alias("top_count"), (F.col("top") > F.size("_tok") * 0.1).alias("repetitive"))


QUALITY_SQL = f"""
WITH {BASE_CTE}, {ENGAGE_CTE}, {content_cte('eng')},
tops AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(cwords) AS w FROM cw) GROUP BY 1,2) GROUP BY 1),
p1 AS (SELECT cw.*, coalesce(tops.top, 0) AS top, {sents_sql('text')} AS ss, {TOKSETS_SQL} AS sets, {PHRASES_SQL} AS ph, {SHAPES_SQL} AS sh, {ENT_SQL} AS ents,
 len(regexp_extract_all(text,'[0-9]+')) AS nums, len(tok) AS nt, len(list_filter(tok, lambda w: w IN {POS})) AS ps, len(list_filter(tok, lambda w: w IN {NEG})) AS ng,
 len(regexp_extract_all(lower(text),'[aeiou]')) AS vow FROM cw LEFT JOIN tops USING (doc_id)),
p2 AS (SELECT *, {SHIFT_SQL('sets')} AS sc, CASE WHEN ps+ng > 0 THEN (ps-ng)::DOUBLE/(ps+ng) ELSE 0 END AS compound, {flesch_sql('nt', 'len(ss)', 'vow')}/100 AS readability_score FROM p1),
p3 AS (SELECT *, {SHIFT_VALUE} AS coherence_score, {ORIG_VALUE} AS originality_score, {FACT_VALUE}::DOUBLE AS fact_density, (compound+1)/2 AS sentiment_score,
 CASE WHEN len(ss)>0 THEN nt::DOUBLE/len(ss) END AS msl FROM p2),
q AS (SELECT *, concat_ws(',', CASE WHEN top > nt*0.1 THEN 'excessive_repetition' END, CASE WHEN msl > 40 THEN 'long_sentences' WHEN msl < 10 THEN 'short_sentences' END,
 CASE WHEN nt < 100 THEN 'insufficient_length' END, CASE WHEN readability_score < 0.3 THEN 'low_readability' END, CASE WHEN abs(compound) > 0.8 THEN 'extreme_sentiment' END) AS flags,
 least(greatest(0.2*readability_score+0.2*coherence_score+0.15*engagement_score+0.15*originality_score+0.15*fact_density+0.15*sentiment_score, 0), 1) AS overall FROM p3)"""


@query("H38_quality_flags", QUALITY_SQL + " SELECT doc_id, flags FROM q")
def quality_flag_rows(t):
    return quality.score_quality(t.documents().select("doc_id", "text")).select("doc_id", F.array_join("quality_flags", ",").alias("flags"))


@query("H39_overall_quality", QUALITY_SQL + """ SELECT doc_id, round(readability_score,6) AS readability_score, round(coherence_score,6) AS coherence_score,
 round(engagement_score,6) AS engagement_score, round(originality_score,6) AS originality_score, round(fact_density,6) AS fact_density, round(sentiment_score,6) AS sentiment_score, round(overall,6) AS overall_score FROM q""")
def overall_quality(t):
    q = quality.score_quality(t.documents().select("doc_id", "text"))
    return q.select("doc_id", *[r6(F.col(c), c) for c in quality.WEIGHTS], r6(F.col("overall_score"), "overall_score"))


@query("H56_keyword_density", f"""
WITH {BASE_CTE}, {content_cte('base')}
SELECT doc_id, CAST(len({sents_sql('text')}) AS BIGINT) AS sentence_count, round(CASE WHEN len({sents_sql('text')})>0 THEN len(tok)::DOUBLE/len({sents_sql('text')}) ELSE 0 END, 6) AS avg_sentence_length,
 CAST(len(list_distinct({ENT_SQL})) AS BIGINT) AS unique_entities, round(CASE WHEN len(tok)>0 THEN least(len(list_distinct(list_filter(cwords, lambda w: length(w) > 2))), 10)::DOUBLE/len(tok) ELSE 0 END, 6) AS keyword_density FROM cw""")
def keyword_density(t):
    p = quality.text_profile(t.documents().select("doc_id", "text")).withColumns(quality.detail_columns())
    return p.select("doc_id", "sentence_count", r6(F.col("avg_sentence_length"), "avg_sentence_length"), "unique_entities", r6(F.col("keyword_density"), "keyword_density"))


@query("H40_enhancement_score", """
SELECT doc_id, round_even(0.3*least(length(text)/1000.0,1.0) + 0.4*(length(text)>0)::INT + 0.3*least(len(regexp_extract_all(text,'[0-9]+'))/5.0,1.0), 2)::DOUBLE AS score FROM documents""")
def enhancement_score(t):
    return t.documents().select("doc_id", normalize.enhancement_score(F.length("text"), F.length("text") > 0, F.regexp_count("text", F.lit("[0-9]+"))).alias("score"))


@query("H43_fact_source_context", "WITH " + PAIRS_SQL + f""",
sp AS (SELECT group_id, pos, first, second, {sents_sql('first')} AS s FROM pairs),
f AS (SELECT group_id, pos, i, which, fact, content FROM (
  SELECT group_id, pos, i, 0 AS which, s[i] AS fact, first AS content FROM sp, unnest(range(1, len(s) + 1)) n(i)
  UNION ALL SELECT group_id, pos, i, 1, s[i], second FROM sp, unnest(range(1, len(s) + 1)) n(i)
  UNION ALL SELECT group_id, pos, 0, 2, first || ' tail', first FROM pairs)),
s AS (SELECT *, strpos(content, fact) - 1 AS hit, array_to_string(list_sort({tok_sql('fact')}),' ') AS a, array_to_string(list_sort({tok_sql('content')}),' ') AS b FROM f)
SELECT group_id, pos, CAST(i AS INTEGER) AS i, CAST(which AS INTEGER) AS which, coalesce(CASE WHEN hit >= 0 THEN substring(content, greatest(0, hit-50)+1, least(length(content), hit+length(fact)+50)-greatest(0,hit-50))
 WHEN greatest(length(a),length(b)) > 0 AND 100*(1-levenshtein(a,b)::DOUBLE/greatest(length(a),length(b))) > 80 THEN content END, '-') AS context FROM s""")
def fact_source_context(t):
    """Every sentence of a turn as a fact, looked for in the turn and in the next one."""
    p = turn_pairs(t)
    sides = F.array(*[F.struct(F.col(c).alias("content"), x.sorted_tokens(c).alias("tokens")) for c in ("first", "second")])
    facts = p.select("group_id", "pos", sides.alias("sides"), F.posexplode_outer(x.sentences("first")).alias("i", "fact")).filter(F.col("fact").isNotNull())
    rows = facts.select("group_id", "pos", (F.col("i") + 1).alias("i"), "fact", F.posexplode("sides").alias("which", "side")).select(
        "group_id", "pos", "i", "fact", "which", "side.content", "side.tokens")
    tails = p.select("group_id", "pos", F.lit(0).alias("i"), F.concat("first", F.lit(" tail")).alias("fact"), F.lit(2).alias("which"),
                     F.col("first").alias("content"), x.sorted_tokens("first").alias("tokens"))
    context = x.source_context("fact", "content", content_tokens_sorted="tokens")
    return rows.unionByName(tails).select("group_id", "pos", "i", "which", F.coalesce(context, F.lit("-")).alias("context"))


@query("H44_claims", f"""
SELECT doc_id, sentence AS claim FROM (SELECT doc_id, unnest({sents_sql('text')}) AS sentence FROM documents) WHERE {words_sql('sentence')} > 5""")
def claims(t):
    return t.documents().select("doc_id", F.explode(x.sentences("text")).alias("claim")).filter(x.word_count("claim") > 5)


@query("H59_summary_relevance", "WITH " + PAIRS_SQL + f""",
w AS (SELECT group_id, pos, list_distinct(list_filter({tok_sql('first')}, lambda w: w NOT IN {STOP})) AS own, list_distinct({tok_sql('second')}) AS body FROM pairs)
SELECT group_id, pos, round(CASE WHEN len(own)=0 THEN 0.8 ELSE len(list_intersect(own, body))::DOUBLE/len(own) END, 6) AS relevance FROM w""")
def summary_relevance(t):
    return turn_pairs(t).select("group_id", "pos", r6(x.relevance("first", "second"), "relevance"))


KEYWORD_SQL = f"""
WITH {BASE_CTE}, {content_cte('base')},
tf AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(cwords, lambda w: length(w) > 2)) AS w FROM cw) GROUP BY 1, 2),
ew AS (SELECT DISTINCT doc_id, unnest({tok_sql('e')}) AS w FROM (SELECT doc_id, unnest({ENT_SQL}) AS e FROM documents)),
sc AS (SELECT tf.doc_id, tf.w AS keyword, tf.n * CASE WHEN ew.w IS NOT NULL THEN 1.3::DOUBLE ELSE 1 END AS score FROM tf LEFT JOIN ew USING (doc_id, w))"""


def keyword_scores(docs):
    """Frequency, raised by 1.3 for words that are part of an entity."""
    p = quality.text_profile(docs)
    in_entity = F.array_distinct(F.flatten(F.transform("_ents", lambda e: x.tokens(e))))
    words = p.select("doc_id", in_entity.alias("ew"), F.explode(F.filter("_content", lambda w: F.length(w) > 2)).alias("keyword"))
    counted = words.groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_contains("ew", F.col("keyword"))).alias("named"))
    return counted.select("doc_id", "keyword", (F.col("n") * F.when(F.col("named"), 1.3).otherwise(1.0)).alias("score"))


@query("G7_top_keywords", KEYWORD_SQL + """
SELECT doc_id, keyword, round(score,6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword) AS rn FROM sc) WHERE rn <= 10""")
def top_keywords(t):
    k = keyword_scores(t.documents().select("doc_id", "text"))
    return top_per_key(k, ["doc_id"], [F.col("score").desc(), F.col("keyword")], 10).withColumn("score", F.round("score", 6))


PHRASE_UNION = f"list_distinct(list_concat({PHRASES_SQL}, list_transform({ENT_SQL}, lambda e: lower(e))))"


def phrase_union(c="text"):
    return F.array_union(x.phrases(c), F.transform(x.entities(c), F.lower))


@query("G8_longest_phrases", f"""
SELECT doc_id, array_to_string(list_transform(list_sort(list_transform({PHRASE_UNION}, lambda p: {{'k': -length(p), 'p': p}}))[1:10], lambda z: z.p), '; ') AS phrases FROM documents""")
def longest_phrases(t):
    return t.documents().select("doc_id", F.array_join(x.longest_first(phrase_union(), 10), "; ").alias("phrases"))


@query("G18_phrase_entity_union", f"SELECT doc_id, CAST(len({PHRASE_UNION}) AS BIGINT) AS n FROM documents")
def phrase_entity_union(t):
    return t.documents().select("doc_id", F.size(phrase_union()).cast("bigint").alias("n"))


EXTRACT_SQL = f"""
WITH s AS (SELECT doc_id, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM (SELECT doc_id, {sents_sql('text')} AS ss FROM documents)),
w AS (SELECT doc_id, pos, unnest(list_filter({tok_sql('sentence')}, lambda w: regexp_matches(w,'^\\p{{L}}+$') AND w NOT IN {STOP})) AS term FROM s),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
sc AS (SELECT w.doc_id, w.pos, sum(tf.tf)::DOUBLE/count(*) AS score FROM w JOIN tf USING (doc_id, term) GROUP BY 1, 2),
r AS (SELECT s.*, {words_sql('sentence')} AS n_words, coalesce(sc.score, 0) AS score FROM s LEFT JOIN sc USING (doc_id, pos))"""


@query("H28_extractive_summary", EXTRACT_SQL + """,
o AS (SELECT *, sum(n_words) OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM r)
SELECT doc_id, string_agg(sentence, '. ' ORDER BY pos) AS summary, CAST(sum(n_words) AS BIGINT) AS summary_words FROM o WHERE total <= 150 OR rn = 1 GROUP BY 1""")
def extractive_summary(t):
    return summaries.extractive_summary(t.documents().select("doc_id", "text"), ["doc_id"]).select("doc_id", "summary", F.col("summary_words").cast("bigint").alias("summary_words"))


@query("H30_key_points", EXTRACT_SQL + """
SELECT doc_id, CAST(pos // 5 AS BIGINT) AS point, arg_max(sentence, score - pos * 1e-9) AS sentence FROM r GROUP BY 1, 2""")
def key_points(t):
    return summaries.key_points(t.documents().select("doc_id", "text"), ["doc_id"])

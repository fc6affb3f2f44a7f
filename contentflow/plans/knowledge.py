"""Taxonomy, category, sentiment and entity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.functions import text as x
from contentflow.functions.mentions import phrase_mentions
from contentflow.operators import knowledge as kn
from contentflow.plans.registry import query
from contentflow.plans.textstats import (ENT_SQL, LABEL_SQL, NEG, PHRASE_UNION, PHRASES_SQL, POS, STOP, phrase_union, sents_sql, tok_sql,
                                         words_sql)
from contentflow.vocab import CATEGORIES

NODES_SQL = """
nodes AS (SELECT r_name AS category, NULL AS parent FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON r_regionkey=n_regionkey
 UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON n_nationkey=c_nationkey),
keywords AS (SELECT r_name AS category, lower(r_name) AS keyword FROM region UNION ALL SELECT n_name, lower(n_name) FROM nation UNION ALL SELECT c_name, lower(c_mktsegment) FROM customer)"""


def nodes(t):
    """Regions, nations and customers as a three-level taxonomy."""
    r, n, c = t.read("region"), t.read("nation"), t.read("customer")
    rn = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return (r.select(F.col("r_name").alias("category"), F.lit(None).cast("string").alias("parent"))
            .unionByName(rn.select(F.col("n_name").alias("category"), F.col("r_name").alias("parent")))
            .unionByName(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("category"), F.col("n_name").alias("parent"))))


def node_keywords(t):
    return (t.read("region").select(F.col("r_name").alias("category"), F.lower("r_name").alias("keyword"))
            .unionByName(t.read("nation").select(F.col("n_name").alias("category"), F.lower("n_name").alias("keyword")))
            .unionByName(t.read("customer").select(F.col("c_name").alias("category"), F.lower("c_mktsegment").alias("keyword"))))


@query("E12_taxonomy_ancestors", "WITH RECURSIVE " + NODES_SQL + """,
a(category, ancestor, depth) AS (SELECT category, parent, 1 FROM nodes WHERE parent IS NOT NULL
 UNION ALL SELECT a.category, n.parent, a.depth + 1 FROM a JOIN nodes n ON n.category = a.ancestor WHERE n.parent IS NOT NULL)
SELECT category, ancestor, CAST(depth AS INTEGER) AS depth FROM a""")
def taxonomy_ancestors(t):
    n = nodes(t)
    return kn.ancestors(n, n)


@query("E13_taxonomy_children", "WITH " + NODES_SQL + " SELECT category FROM nodes WHERE lower(parent) = 'nation_3'")
def taxonomy_children(t):
    return kn.children(nodes(t), "Nation_3").select("category")


@query("E14_inherited_keywords", "WITH RECURSIVE " + NODES_SQL + """,
a(category, ancestor) AS (SELECT category, category FROM nodes UNION ALL SELECT a.category, n.parent FROM a JOIN nodes n ON n.category = a.ancestor WHERE n.parent IS NOT NULL)
SELECT DISTINCT a.category, k.keyword FROM a JOIN keywords k ON k.category = a.ancestor""")
def inherited_keywords(t):
    n = nodes(t)
    return kn.inherited_keywords(n, node_keywords(t), n)


@query("E15_category_lookup", "WITH " + NODES_SQL + " SELECT category, parent FROM nodes WHERE lower(category) = 'customer#000000007'")
def category_lookup(t):
    return kn.find_category(nodes(t), "CUSTOMER#000000007")


CATS = "[" + ",".join(f"'{c}'" for c in CATEGORIES) + "]"
TAX_SQL = f"""
tax AS (SELECT DISTINCT keyword, {CATS}[1 + CAST(item_id % 10 AS INTEGER)] AS category FROM (SELECT item_id, unnest({tok_sql('text')}) AS keyword FROM benchmark)),
arr AS (SELECT doc_id, list_transform(list_sort(list_transform({PHRASE_UNION}, lambda p: {{'k': -length(p), 'p': p}}))[1:10], lambda z: z.p) AS keywords,
 list_transform({ENT_SQL}, lambda e: lower(e)) AS entities, {PHRASES_SQL} AS phrases FROM documents),
ev AS (SELECT doc_id, unnest(keywords) AS keyword, 1.0::DOUBLE AS w FROM arr UNION ALL SELECT doc_id, unnest(entities), 0.8 FROM arr UNION ALL SELECT doc_id, unnest(phrases), 0.6 FROM arr),
sc AS (SELECT doc_id, category, round(sum(w), 9) AS score FROM ev JOIN tax USING (keyword) GROUP BY 1, 2),
cat AS (SELECT unnest({CATS}) AS category, unnest(range(10)) AS i),
full_sc AS (SELECT d.doc_id, c.category, c.i, coalesce(s.score, 0) AS score, max(coalesce(s.score, 0)) OVER (PARTITION BY d.doc_id) AS top FROM documents d, cat c LEFT JOIN sc s ON s.doc_id=d.doc_id AND s.category=c.category),
norm AS (SELECT doc_id, category, i, CASE WHEN top > 0 THEN score/top ELSE score END AS score FROM full_sc)"""


def category_input(t):
    """Documents with their evidence arrays, and a keyword table drawn from the benchmark texts."""
    cut = t.documents().select("doc_id", F.transform(x.entities("text"), F.lower).alias("entities"), x.phrases("text").alias("phrases"))
    d = cut.select("doc_id", x.longest_first(F.array_union("phrases", "entities"), 10).alias("keywords"), "entities", "phrases")
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    tax = t.read("benchmark").select(F.explode(x.tokens("text")).alias("keyword"), F.get(cats, (F.col("item_id") % 10).cast("int")).alias("category")).distinct()
    return d, tax


@query("E4_keyword_taxonomy_join", "WITH " + TAX_SQL + " SELECT doc_id, category, round(score, 6) AS score FROM sc")
def keyword_taxonomy_join(t):
    d, tax = category_input(t)
    return kn.category_matches(d, tax, "doc_id").select("doc_id", "category", F.round("score", 6).alias("score"))


@query("H24_normalised_category_scores", "WITH " + TAX_SQL + " SELECT doc_id, category, round(score, 6) AS score FROM norm")
def normalised_category_scores(t):
    d, tax = category_input(t)
    return kn.categorise(d, tax, "doc_id").select("doc_id", F.explode("scores").alias("category", "score")).withColumn("score", F.round("score", 6))


@query("G9_category_ranking", "WITH " + TAX_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS place FROM norm)
SELECT doc_id, max(CASE WHEN place=1 THEN category END) AS primary_category, max(CASE WHEN place=2 THEN category END) || ',' || max(CASE WHEN place=3 THEN category END) AS secondary FROM r GROUP BY 1""")
def category_ranking(t):
    d, tax = category_input(t)
    return kn.categorise(d, tax, "doc_id").select("doc_id", "primary_category", F.array_join("secondary_categories", ",").alias("secondary"))


@query("H32_sentiment_scale", """
SELECT event_id, round(CASE WHEN event_type='error' THEN -value/500 ELSE value/500 END, 6) AS score, ((event_id % 5 + 1) - 3)/2.0::DOUBLE AS stars FROM events""")
def sentiment_scale(t):
    label = F.when(F.col("event_type") == "error", "NEGATIVE").otherwise("POSITIVE")
    stars = F.concat((F.col("event_id") % 5 + 1).cast("string"), F.lit(" stars"))
    return t.read("events").select("event_id", F.round(kn.signed_score(F.col("value") / 500, label), 6).alias("score"), kn.star_score(stars).alias("stars"))


def bal_sql(c):
    tk = tok_sql(c)
    p, n = f"len(list_filter({tk}, lambda w: w IN {POS}))", f"len(list_filter({tk}, lambda w: w IN {NEG}))"
    return f"(CASE WHEN {p}+{n} > 0 THEN ({p}-{n})::DOUBLE/({p}+{n}) ELSE 0 END)"


WSX = "' ' || chr(9)||chr(10)||chr(13)||chr(12)"


@query("H33_document_sentiment", f"""
WITH d AS (SELECT doc_id, text, {tok_sql('text')} AS tok, list_filter(string_split(text, '. '), lambda s: trim(s,{WSX}) <> '') AS pieces FROM documents),
e AS (SELECT *, len(list_filter(tok, lambda w: w IN {POS})) AS p, len(list_filter(tok, lambda w: w IN {NEG})) AS n FROM d)
SELECT doc_id, round({bal_sql('text')}, 6) AS overall, CAST(len(pieces) AS BIGINT) AS sentences, CAST(len(list_filter(pieces, lambda s: {bal_sql('s')} < 0)) AS BIGINT) AS negative_sentences,
 round(CASE WHEN len(tok)>0 THEN p::DOUBLE/len(tok) ELSE 0 END, 6) AS positive, round(CASE WHEN len(tok)>0 THEN n::DOUBLE/len(tok) ELSE 0 END, 6) AS negative,
 round(1 - CASE WHEN len(tok)>0 THEN (p+n)::DOUBLE/len(tok) ELSE 0 END, 6) AS neutral FROM e""")
def document_sentiment(t):
    s = kn.document_sentiment(t.documents().select("doc_id", "text"))
    return s.select("doc_id", F.round("overall", 6).alias("overall"), F.size("sentences").cast("bigint").alias("sentences"),
                    F.size(F.filter("sentences", lambda r: r["score"] < 0)).cast("bigint").alias("negative_sentences"),
                    *[F.round(c, 6).alias(c) for c in ("positive", "negative", "neutral")])


def starts_sql(e):
    return f"""list_transform(range(1, len(string_split(lower(text), '{e}'))), lambda i: list_sum(list_transform(string_split(lower(text), '{e}')[1:i], lambda p: length(p))) + (i-1)*{len(e)})"""


@query("H34_entity_mentions", f"""
SELECT doc_id, CAST(hit AS INTEGER) AS start, substring(text, CAST(greatest(0, hit-50)+1 AS BIGINT), CAST(least(length(text), hit+14+50)-greatest(0,hit-50) AS BIGINT)) AS context
FROM (SELECT doc_id, text, unnest({starts_sql('apache license')}) AS hit FROM documents)
UNION ALL SELECT doc_id, CAST(hit AS INTEGER), substring(text, CAST(greatest(0, hit-50)+1 AS BIGINT), CAST(least(length(text), hit+5+50)-greatest(0,hit-50) AS BIGINT))
FROM (SELECT doc_id, text, unnest({starts_sql('idiot')}) AS hit FROM documents)""")
def entity_mentions(t):
    found = phrase_mentions(t.spark, "text", ["Apache License", "idiot"], 50)
    return t.documents().select("doc_id", F.inline(found)).select("doc_id", "start", F.col("around").alias("context"))


ASPECTS = {"motion": ["tion", "ering"], "place": ["onth", "inth"], "insult": ["stupid", "moron", "trash"]}


@query("F20_entity_and_aspect_sentiment", f"""
WITH m AS (SELECT doc_id, text, 'idiot' AS name, unnest({starts_sql('idiot')}) AS hit, 5 AS n FROM documents UNION ALL SELECT doc_id, text, 'the', unnest({starts_sql('the')}), 3 FROM documents),
c AS (SELECT doc_id, name, substring(text, CAST(greatest(0, hit-50)+1 AS BIGINT), CAST(least(length(text), hit+n+50)-greatest(0,hit-50) AS BIGINT)) AS s FROM m),
p AS (SELECT doc_id, unnest(string_split(text, '. ')) AS s FROM documents),
a AS (SELECT doc_id, name, s FROM p JOIN (VALUES {",".join(f"('{k}', {v!r})" for k, v in ASPECTS.items())}) a(name, words) ON len(list_filter(words, lambda w: contains(lower(s), w))) > 0)
SELECT 'entity' AS kind, doc_id, name, count(*) AS n, round(avg({bal_sql('s')}::DOUBLE), 6) AS sentiment FROM c GROUP BY 2, 3
UNION ALL SELECT 'aspect', doc_id, name, count(*), round(avg({bal_sql('s')}::DOUBLE), 6) FROM a GROUP BY 2, 3""")
def entity_and_aspect_sentiment(t):
    d = t.documents().select("doc_id", "text")
    e = kn.entity_sentiment(d, ["idiot", "the"], ["doc_id"]).select(F.lit("entity").alias("kind"), "doc_id", F.col("entity").alias("name"), F.col("mentions").cast("bigint").alias("n"), F.round("sentiment", 6).alias("sentiment"))
    a = kn.aspect_sentiment(d, ASPECTS, ["doc_id"]).select(F.lit("aspect").alias("kind"), "doc_id", F.col("aspect").alias("name"), F.col("sentences").cast("bigint").alias("n"), F.round("sentiment", 6).alias("sentiment"))
    return e.unionByName(a)


@query("F26_entity_and_claim_counts", f"""
SELECT doc_id, CAST(len({ENT_SQL}) AS BIGINT) AS entity_count, CAST(len(list_distinct({ENT_SQL})) AS BIGINT) AS unique_entities,
 CAST(len(list_filter({sents_sql('text')}, lambda s: {words_sql('s')} > 5)) AS BIGINT) AS fact_check_count FROM documents""")
def entity_and_claim_counts(t):
    e = x.entities("text")
    return t.documents().select("doc_id", F.size(e).cast("bigint").alias("entity_count"), F.size(F.array_distinct(e)).cast("bigint").alias("unique_entities"),
                                F.size(F.filter(x.sentences("text"), lambda s: x.word_count(s) > 5)).cast("bigint").alias("fact_check_count"))


@query("H22_entity_annotations", f"""
SELECT doc_id, e AS entity, {LABEL_SQL.format(e='e')} AS label, count(*) AS n FROM (SELECT doc_id, unnest({ENT_SQL}) AS e FROM documents) GROUP BY ALL""")
def entity_annotations(t):
    return kn.entity_rows(t.documents(), ["doc_id"]).groupBy("doc_id", "entity", "label").agg(F.count(F.lit(1)).alias("n"))


PAGE_ENT_SQL = f"""
pe AS (SELECT page_id, url, body, unnest({ENT_SQL}) AS name FROM (SELECT page_id, url, html AS text, regexp_replace(html,'<[^>]+>',' ','g') AS body FROM pages)),
kb AS (SELECT lower(name) AS lname, {LABEL_SQL.format(e='name')} AS label, arg_min(url, page_id) AS kb_id, substring(arg_min(body, page_id),1,200) AS description FROM pe GROUP BY 1, 2)"""


def page_entities(t):
    """Names of each page with the part of its body that is ever shown; a name counts once for a page."""
    body = F.substring(F.regexp_replace("html", "<[^>]+>", " "), 1, 500)
    return t.pages().select("page_id", "url", body.alias("body"), F.explode_outer(F.array_distinct(x.entities("html"))).alias("name")).filter(F.col("name").isNotNull())


def knowledge_base(t):
    """Names found on pages, described by the first page that has them."""
    p = page_entities(t).withColumn("label", x.entity_label("name"))
    return p.groupBy(F.lower("name").alias("name"), "label").agg(F.min_by("url", "page_id").alias("kb_id"), F.min_by("body", "page_id").alias("description"))


@query("E16_linked_entities", "WITH " + PAGE_ENT_SQL + f""",
de AS (SELECT doc_id, e AS entity, {LABEL_SQL.format(e='e')} AS label FROM (SELECT doc_id, unnest({ENT_SQL}) AS e FROM documents))
SELECT doc_id, entity, de.label, coalesce(kb_id,'-') AS kb_id, coalesce(description,'-') AS description, CASE WHEN kb_id IS NOT NULL THEN 0.8::DOUBLE ELSE 0.6 END AS confidence
FROM de LEFT JOIN kb ON kb.lname = lower(de.entity) AND kb.label = de.label""")
def linked_entities(t):
    e = kn.link_entities(kn.entity_rows(t.documents(), ["doc_id"]), knowledge_base(t))
    return e.select("doc_id", "entity", "label", F.coalesce("kb_id", F.lit("-")).alias("kb_id"), F.coalesce("description", F.lit("-")).alias("description"), "confidence")


def claim_table(t):
    return (t.documents().select("doc_id", F.posexplode(x.sentences("text")).alias("pos", "claim"))
            .filter(x.word_count("claim") > 5))


CLAIM_SQL = PAGE_ENT_SQL + f""",
cl AS (SELECT * FROM (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS claim FROM (SELECT doc_id, {sents_sql('text')} AS s FROM documents)) WHERE {words_sql('claim')} > 5),
ce AS (SELECT doc_id, pos, claim, unnest(list_distinct({ENT_SQL.replace('text', 'claim')})) AS entity FROM cl),
pg AS (SELECT * FROM (SELECT name, page_id, body, row_number() OVER (PARTITION BY name ORDER BY page_id) AS rn FROM (SELECT DISTINCT name, page_id, body FROM pe)) WHERE rn <= 2),
evd AS (SELECT doc_id, pos, claim, entity, page_id AS source, substring(body,1,500) AS evidence FROM ce JOIN pg ON lower(pg.name)=lower(entity) WHERE {LABEL_SQL.format(e='entity')} IN ('ORG','PERSON','GPE','PRODUCT','EVENT'))"""


@query("E17_claim_evidence", "WITH " + CLAIM_SQL + " SELECT doc_id, CAST(pos AS BIGINT) AS pos, entity, source, evidence FROM evd")
def claim_evidence(t):
    pages = page_entities(t).select("name", F.col("page_id").alias("source"), "body").distinct()
    return kn.claim_evidence(claim_table(t), pages, ["doc_id", "pos"]).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "entity", "source", "evidence")


@query("F25_fact_verdicts", "WITH " + CLAIM_SQL + f""",
js AS (SELECT *, list_distinct(list_filter({tok_sql('claim')}, lambda w: w NOT IN {STOP})) AS own, list_distinct({tok_sql('evidence')}) AS body FROM evd),
jd AS (SELECT *, CASE WHEN len(own)=0 THEN 0 ELSE len(list_intersect(own, body))::DOUBLE/len(own) END AS score,
 (len(list_filter({tok_sql('claim')}, lambda w: w IN ('not','no','never','none','neither'))) > 0) <> (len(list_filter({tok_sql('evidence')}, lambda w: w IN ('not','no','never','none','neither'))) > 0) AS neg FROM js),
mn AS (SELECT doc_id, pos, avg(CASE WHEN neg THEN -score ELSE score END) AS mean, count(*) AS n FROM jd WHERE score > 0.6 GROUP BY 1, 2)
SELECT cl.doc_id, CAST(cl.pos AS BIGINT) AS pos, coalesce(n,0) AS n_evidence, CASE WHEN mean > 0.6 THEN 'VERIFIED' WHEN mean < -0.6 THEN 'REFUTED' ELSE 'UNCERTAIN' END AS status,
 round(CASE WHEN abs(mean) > 0.6 THEN abs(mean) WHEN mean IS NOT NULL THEN 0.5 ELSE 0.3 END::DOUBLE, 6) AS confidence FROM cl LEFT JOIN mn USING (doc_id, pos)""")
def fact_verdicts(t):
    claims = claim_table(t)
    pages = page_entities(t).select("name", F.col("page_id").alias("source"), "body").distinct()
    judged = kn.judge_evidence(kn.claim_evidence(claims, pages, ["doc_id", "pos"]))
    v = kn.fact_verdicts(claims, judged, ["doc_id", "pos"])
    return v.withColumn("pos", F.col("pos").cast("bigint")).withColumn("confidence", F.round("confidence", 6))


@query("J3_custom_entities", f"""
WITH e AS (SELECT doc_id, text, {ENT_SQL} AS names FROM documents),
w AS (SELECT doc_id, text, names, list_transform(range(1, len(names) + 1), lambda i: names[i]) AS n FROM e),
walk AS (SELECT doc_id, text, list_reduce(list_prepend({{'at': 1::BIGINT, 's': []::STRUCT(a BIGINT, b BIGINT)[], 'x': ''}}, list_transform(n, lambda v: {{'at': 0::BIGINT, 's': []::STRUCT(a BIGINT, b BIGINT)[], 'x': v}})),
 lambda p, q: {{'at': p.at + strpos(substring(text, p.at), q.x) - 1 + length(q.x), 's': list_append(p.s, {{'a': p.at + strpos(substring(text, p.at), q.x) - 2, 'b': p.at + strpos(substring(text, p.at), q.x) - 2 + length(q.x)}}), 'x': ''}}).s AS spans FROM w),
m AS (SELECT doc_id, 'ORG' AS label, 'license' AS phrase, unnest({starts_sql('license')}) AS start, spans FROM walk
 UNION ALL SELECT doc_id, 'INSULT', 'idiot', unnest({starts_sql('idiot')}), spans FROM walk)
SELECT doc_id, label, phrase, CAST(start AS BIGINT) AS start FROM m WHERE len(list_filter(spans, lambda s: start < s.b AND start + length(phrase) > s.a)) = 0""")
def custom_entities(t):
    found = kn.with_custom_entities(t.documents(), [("ORG", "license"), ("INSULT", "idiot")], ["doc_id"])
    return found.withColumn("start", F.col("start").cast("bigint"))

"""Topic queries. The exact ones take the source of a document as its given label."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.operators import tfidf, topics
from contentflow.plans.registry import query
from contentflow.plans.textstats import STOP, tok_sql
from contentflow.session import shared_table

CORPUS_SQL = f"""
tk AS (SELECT doc_id, list_filter({tok_sql('text')}, lambda w: length(w) > 1 AND w NOT IN {STOP}) AS t FROM documents),
tm AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1]))) AS term FROM tk),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tm GROUP BY 1, 2),
vo AS (SELECT term, count(*) AS df, sum(tf) AS ctf, (SELECT count(*) FROM documents) AS n FROM tf GROUP BY 1 HAVING count(*) <= 0.9 * (SELECT count(*) FROM documents) ORDER BY ctf DESC, term LIMIT 100),
rw AS (SELECT doc_id, term, tf.tf * (ln((1+n)::DOUBLE/(1+df))+1) AS w FROM tf JOIN vo USING (term)),
ww AS (SELECT doc_id, term, w / sqrt(sum(w*w) OVER (PARTITION BY doc_id)) AS w FROM rw),
lab AS (SELECT doc_id, source AS label FROM documents),
sz AS (SELECT label, count(*) AS document_count FROM lab GROUP BY 1),
ct AS (SELECT label, term, sum(w)/any_value(document_count) AS c FROM ww JOIN lab USING (doc_id) JOIN sz USING (label) GROUP BY 1, 2),
kw AS (SELECT * FROM (SELECT label, term, row_number() OVER (PARTITION BY label ORDER BY round(c,9) DESC, term) AS place FROM ct) WHERE place <= 10 AND length(term) > 1),
ts AS (SELECT sz.label, document_count, document_count::DOUBLE/(SELECT count(*) FROM documents) AS confidence FROM sz),
scored AS (SELECT doc_id, label, sum(w*c)/(sqrt(sum(w*w))*any_value(nc)) AS score FROM ww JOIN lab USING (doc_id) JOIN ct USING (label, term)
 JOIN (SELECT label, sqrt(sum(c*c)) AS nc FROM ct GROUP BY 1) USING (label) GROUP BY 1, 2)"""


def given_topics(t):
    """(weights, centres, labels) with the source as the label."""
    d = t.documents().select("doc_id", "text", F.col("source").alias("label"))
    words = tfidf.corpus_words(d, ["doc_id"])
    vocab = tfidf.corpus_vocabulary(d, words=words)
    w, _ = shared_table(tfidf.corpus_weights(d, "doc_id", vocab, words=words), "topic-weights")  # at most 100 rows per text, read by several steps
    labels = d.select("doc_id", "label")
    return w, topics.topic_centres(w, labels, "doc_id"), labels


def words_of(topic_rows):
    return topic_rows.select("label", F.explode("keywords").alias("term"))


# The leader rule as a walk through the texts in id order; w.leaders holds the leaders so far.
LEADER_SQL = CORPUS_SQL.replace("lab AS (SELECT doc_id, source AS label FROM documents),", """
vk AS (SELECT term, row_number() OVER (ORDER BY term) AS k FROM vo),
vc AS (SELECT d.doc_id, list(coalesce(ww.w, 0) ORDER BY k) AS v FROM (SELECT DISTINCT doc_id FROM ww) d CROSS JOIN vk LEFT JOIN ww ON ww.doc_id = d.doc_id AND ww.term = vk.term GROUP BY 1),
sq AS (SELECT doc_id, v, row_number() OVER (ORDER BY doc_id) AS rn FROM vc),
walk(rn, leaders) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, v DOUBLE[])[]
 UNION ALL SELECT sq.rn, CASE WHEN len(w.leaders) < (SELECT greatest(2, count(*) // 2) FROM documents)
   AND coalesce(list_max(list_transform(w.leaders, lambda l: list_dot_product(l.v, sq.v))), -1) < 0.5 THEN list_append(w.leaders, {'id': sq.doc_id, 'v': sq.v}) ELSE w.leaders END
  FROM walk w JOIN sq ON sq.rn = w.rn + 1),
ld AS (SELECT l.id AS leader, l.v AS v, i - 1 AS label FROM (SELECT leaders FROM walk ORDER BY rn DESC LIMIT 1), unnest(range(1, len(leaders) + 1)) t(i), LATERAL (SELECT leaders[i] AS l)),
pick AS (SELECT sq.doc_id, ld.label, ld.leader, CASE WHEN ld.leader = sq.doc_id THEN 1.0 ELSE least(list_dot_product(ld.v, sq.v), 1.0) END AS similarity,
  row_number() OVER (PARTITION BY sq.doc_id ORDER BY ld.leader = sq.doc_id DESC, list_dot_product(ld.v, sq.v) DESC, ld.label) AS place FROM sq JOIN ld ON ld.leader <= sq.doc_id),
led AS (SELECT d.doc_id, CAST(coalesce(label, 0) AS INTEGER) AS label, coalesce(leader, (SELECT min(leader) FROM ld)) AS leader, round(greatest(coalesce(similarity, 0), 0), 6) AS similarity
  FROM documents d LEFT JOIN (SELECT * FROM pick WHERE place = 1) p USING (doc_id)),
lab AS (SELECT doc_id, label FROM led),""")
SUMMARY_SQL = """
SELECT ts.label, string_agg(term, ' + ' ORDER BY place) FILTER (WHERE rn <= 3) AS name, string_agg(term, ',' ORDER BY place) AS keywords, document_count, round(confidence, 6) AS confidence
FROM ts LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY place) AS rn FROM kw) USING (label) GROUP BY ALL"""


@query("F21_topic_extraction", "WITH RECURSIVE " + LEADER_SQL + SUMMARY_SQL)
def topic_extraction(t):
    """Topics of the leader clusters of all documents."""
    s = topics.extract_topics(t.documents().select("doc_id", "text"), "doc_id")["topics"]
    return s.select("label", F.nullif("name", F.lit("")).alias("name"), F.nullif(F.array_join("keywords", ","), F.lit("")).alias("keywords"), "document_count", F.round("confidence", 6).alias("confidence"))


@query("E10_leader_assignment", "WITH RECURSIVE " + LEADER_SQL + " SELECT doc_id, label, leader, similarity FROM led")
def leader_assignment(t):
    labels = topics.extract_topics(t.documents().select("doc_id", "text"), "doc_id")["labels"]
    return labels.withColumn("similarity", F.round("similarity", 6))


@query("F22_topic_summary", "WITH " + CORPUS_SQL + """
SELECT ts.label, string_agg(term, ' + ' ORDER BY place) FILTER (WHERE rn <= 3) AS name, string_agg(term, ',' ORDER BY place) AS keywords, document_count, round(confidence, 6) AS confidence
FROM ts JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY place) AS rn FROM kw) USING (label) GROUP BY ALL""")
def topic_summary(t):
    w, c, labels = given_topics(t)
    s = topics.topic_summary(c, labels)
    return s.select("label", "name", F.array_join("keywords", ",").alias("keywords"), "document_count", F.round("confidence", 6).alias("confidence"))


@query("F23_document_topic_score", "WITH " + CORPUS_SQL + " SELECT doc_id, label, round(score, 6) AS score FROM scored")
def document_topic_score(t):
    w, c, labels = given_topics(t)
    return topics.topic_scores(w, c, labels, "doc_id").withColumn("score", F.round("score", 6))


@query("F24_topic_coherence", "WITH " + CORPUS_SQL + """,
pr AS (SELECT a.label, a.term AS t1, b.term AS t2 FROM kw a JOIN kw b ON a.label=b.label AND a.place < b.place),
co AS (SELECT pr.label, t1, t2, (SELECT count(*) FROM scored s WHERE s.label=pr.label AND s.score >= 0.3) AS n FROM pr),
per AS (SELECT label, avg(n::DOUBLE/document_count) AS coherence FROM co JOIN sz USING (label) WHERE n > 0 GROUP BY 1)
SELECT label, round(coherence, 6) AS coherence FROM per UNION ALL SELECT 'overall', round(avg(coherence), 6) FROM per""")
def topic_coherence(t):
    w, c, labels = given_topics(t)
    per = topics.topic_coherence(topics.topic_summary(c, labels), topics.topic_scores(w, c, labels, "doc_id"))
    both = per.unionByName(topics.overall_coherence(per).select(F.lit("overall").alias("label"), "coherence"))
    return both.withColumn("coherence", F.round("coherence", 6))


@query("E8_document_topic_match", "WITH " + CORPUS_SQL + f""",
dt AS (SELECT conv_id, turn, list_distinct({tok_sql('text')}) AS t FROM conversations),
ov AS (SELECT conv_id, turn, len(t) AS nd, label, count(*) AS overlap FROM dt JOIN kw ON list_contains(t, kw.term) GROUP BY 1, 2, 3, 4),
nt AS (SELECT label, count(*) AS nt FROM kw GROUP BY 1)
SELECT conv_id || ':' || turn AS turn_id, label, overlap, round(overlap::DOUBLE/(nt+nd-overlap), 6) AS similarity FROM ov JOIN nt USING (label) WHERE overlap::DOUBLE/(nt+nd-overlap) >= 0.05""")
def document_topic_match(t):
    w, c, labels = given_topics(t)
    words = words_of(topics.topic_summary(c, labels))
    turns = t.chat().select(F.concat_ws(":", "group_id", "pos").alias("turn_id"), "text")
    return topics.match_topics(turns, words, "turn_id", at_least=0.05).withColumn("similarity", F.round("similarity", 6))


@query("E9_related_topics", "WITH " + CORPUS_SQL + """,
nk AS (SELECT label, count(*) AS n FROM kw GROUP BY 1),
pt AS (SELECT a.label AS a, b.label AS b, sum((contains(a.term, b.term) OR contains(b.term, a.term))::INT) AS part, sum((a.term = b.term)::INT) AS same FROM kw a JOIN kw b ON a.label <> b.label GROUP BY 1, 2)
SELECT a, b, round((same::DOUBLE/(na.n+nb.n-same) + part::DOUBLE/(na.n+nb.n))/2, 6) AS similarity FROM pt JOIN nk na ON na.label=a JOIN nk nb ON nb.label=b
WHERE (same::DOUBLE/(na.n+nb.n-same) + part::DOUBLE/(na.n+nb.n))/2 > 0.1""")
def related_topics(t):
    w, c, labels = given_topics(t)
    return topics.related_topics(words_of(topics.topic_summary(c, labels))).withColumn("similarity", F.round("similarity", 6))


@query("G10_topic_ranking", "WITH " + CORPUS_SQL + """
SELECT label, document_count, row_number() OVER (ORDER BY document_count DESC, confidence DESC, label) AS place FROM ts""")
def topic_ranking(t):
    w, c, labels = given_topics(t)
    return topics.ranked_topics(topics.topic_summary(c, labels)).select("label", "document_count", "place")


@query("G13_emerging_topics", "WITH " + CORPUS_SQL + """,
dn AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM scored),
dp AS (SELECT doc_id, CAST((rn-1) // (n // 3) AS INT) AS p, CAST((n-1) // (n // 3) AS INT) AS lastp FROM dn),
gr AS (SELECT s.label, g.p, (SELECT max(lastp) FROM dp) AS lastp FROM (SELECT DISTINCT label FROM scored) s, (SELECT DISTINCT p FROM dp) g),
fq AS (SELECT gr.label, gr.p, any_value(gr.lastp) AS lastp, coalesce(sum(CASE WHEN score >= 0.2 THEN score END), 0) AS f, count(CASE WHEN score >= 0.2 THEN 1 END) AS n
 FROM gr LEFT JOIN (scored JOIN dp USING (doc_id)) x ON x.label=gr.label AND x.p=gr.p GROUP BY 1, 2),
gw AS (SELECT *, (f - lag(f) OVER (PARTITION BY label ORDER BY p))/greatest(lag(f) OVER (PARTITION BY label ORDER BY p), 0.01) AS g FROM fq)
SELECT label, round(max(g), 6) AS growth, CAST(max(CASE WHEN p=0 THEN n END) AS BIGINT) AS first_count, CAST(max(CASE WHEN p=lastp THEN n END) AS BIGINT) AS last_count,
 max(g) > 0.1 AND sum(n) >= 1 AND max(CASE WHEN p=lastp THEN n END) >= max(CASE WHEN p=0 THEN n END) AS emerging FROM gw GROUP BY 1""")
def emerging_topics(t):
    w, c, labels = given_topics(t)
    return topics.emerging_topics(topics.topic_scores(w, c, labels, "doc_id"), "doc_id").withColumn("growth", F.round("growth", 6))

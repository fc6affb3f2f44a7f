"""Validation queries: every rule returns the row with its errors, nothing fails the job."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.functions import checks
from contentflow.operators import queueing
from contentflow.plans.registry import query
from contentflow.sources.views import CONTENT_SQL, ERRORS_SQL, ITEMS_SQL
from contentflow.vocab import NOTICE_RANKS

FILLED = "(x IS NOT NULL AND length(x) > 0)"


@query("D2_non_empty_fields", "WITH " + CONTENT_SQL + """
SELECT doc_id, coalesce(length(item_key) > 0 AND length(title) > 0 AND length(text) > 0 AND length(feed) > 0, false) AS valid FROM content""")
def non_empty_fields(t):
    ok = F.lit(True)
    for c in ["item_key", "title", "text", "feed"]:
        ok = ok & checks.filled(c)
    return t.content().select("doc_id", ok.alias("valid"))


TITLE_ERROR_SQL = """CASE WHEN x IS NULL OR length(x) = 0 THEN 'Title is required'
 WHEN length(x) > 255 THEN 'Title exceeds maximum length of 255 characters'
 WHEN regexp_matches(x, '<[^>]+>') THEN 'Title contains HTML tags' END"""
URL_ERROR_SQL = """CASE WHEN u IS NULL OR length(u) = 0 THEN 'URL is required'
 WHEN length(u) > 2048 THEN 'URL exceeds maximum length of 2048 characters'
 WHEN NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN 'Invalid URL format' END"""


@query("D4_title_rule", f"""
SELECT key, coalesce({TITLE_ERROR_SQL}, 'ok') AS outcome FROM (
  SELECT 'doc' || doc_id AS key, regexp_extract(text, '^([^.!?\\n]*)', 1) AS x FROM documents
  UNION ALL SELECT 'page' || page_id, html FROM pages
  UNION ALL SELECT 'text' || doc_id, text FROM documents)""")
def title_rule(t):
    rows = (
        t.content().select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("key"), F.col("title").alias("x"))
        .unionByName(t.pages().select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("key"), F.col("html").alias("x")))
        .unionByName(t.documents().select(F.concat(F.lit("text"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("x")))
    )
    return rows.select("key", F.coalesce(checks.title_error("x"), F.lit("ok")).alias("outcome"))


@query("D5_url_rule", "WITH " + ITEMS_SQL + f"""
SELECT key, coalesce({URL_ERROR_SQL}, 'ok') AS outcome FROM (SELECT 'item' || id AS key, url AS u FROM items
 UNION ALL SELECT 'page' || page_id, url FROM pages)""")
def url_rule(t):
    rows = t.items().select(F.concat(F.lit("item"), F.col("id").cast("string")).alias("key"), "url").unionByName(
        t.pages().select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("key"), "url"))
    return rows.select("key", F.coalesce(checks.url_error("url"), F.lit("ok")).alias("outcome"))


CTYPE_MSG = "Invalid content type. Must be one of: BLOG, VIDEO, SOCIAL"
PRIO_MSG = "Invalid priority. Must be one of: High, Medium, Low"


@query("D6_content_type_membership", "WITH " + ITEMS_SQL + f"""
SELECT id, CASE WHEN ct <> '' AND ct NOT IN ('BLOG','VIDEO','SOCIAL') THEN '{CTYPE_MSG}' ELSE 'ok' END AS outcome
FROM (SELECT id, CASE category WHEN 'view' THEN 'VIDEO' WHEN 'click' THEN 'SOCIAL' WHEN 'signup' THEN NULL ELSE upper(category) END AS ct FROM items)
WHERE true""")
def content_type_membership(t):
    ct = (F.when(F.col("category") == "view", "VIDEO").when(F.col("category") == "click", "SOCIAL")
          .when(F.col("category") != "signup", F.upper("category")))
    return t.items().select("id", F.coalesce(checks.content_type_error(ct), F.lit("ok")).alias("outcome"))


@query("D7_priority_membership", "WITH " + ITEMS_SQL + f"""
SELECT id, CASE WHEN category IN ('purchase','click') THEN '{PRIO_MSG}' ELSE 'ok' END AS outcome FROM items""")
def priority_membership(t):
    p = (F.when(F.col("category") == "view", "High").when(F.col("category") == "error", "Low")
         .when(F.col("category") == "purchase", "URGENT").when(F.col("category") == "click", "high"))
    return t.items().select("id", F.coalesce(checks.priority_error(p), F.lit("ok")).alias("outcome"))


@query("D8_tag_rules", """
WITH d AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS tags FROM documents)
SELECT doc_id, CAST((len(tags) > 10)::INT + len(list_filter(tags, lambda x: length(x) > 50)) AS BIGINT) AS n_errors,
       len(tags) > 10 AS too_many FROM d""")
def tag_rules(t):
    """The distinct words of a text serve as its tags."""
    tags = F.array_distinct(F.split(F.lower("text"), " "))
    errs = t.documents().select("doc_id", checks.tag_errors(tags).alias("errors"))
    return errs.select("doc_id", F.size("errors").cast("bigint").alias("n_errors"),
                       F.array_contains("errors", "Maximum of 10 tags allowed").alias("too_many"))


RECORD_SQL = """CASE WHEN content_type IS NULL OR content_type NOT IN ('BLOG','VIDEO','SOCIAL') THEN 'Invalid content type'
 WHEN priority IS NULL OR priority NOT IN ('High','Medium','Low') THEN 'Invalid priority'
 WHEN length(title) > 255 THEN 'Title must not exceed 255 characters'
 WHEN length(brief) > 2000 THEN 'Brief must not exceed 2000 characters' END"""


@query("D9_record_constraints", "WITH " + CONTENT_SQL + f"""
SELECT doc_id, coalesce({RECORD_SQL}, 'ok') AS outcome FROM (SELECT doc_id, title, text AS brief,
 CASE lang WHEN 'de' THEN 'PODCAST' WHEN 'fr' THEN 'VIDEO' ELSE 'BLOG' END AS content_type,
 CASE feed WHEN 'src1' THEN 'Urgent' WHEN 'src2' THEN 'High' ELSE 'Low' END AS priority FROM content)""")
def record_constraints(t):
    ct = F.when(F.col("lang") == "de", "PODCAST").when(F.col("lang") == "fr", "VIDEO").otherwise("BLOG")
    pr = F.when(F.col("feed") == "src1", "Urgent").when(F.col("feed") == "src2", "High").otherwise("Low")
    return t.content().select("doc_id", F.coalesce(checks.record_error("title", ct, "text", pr), F.lit("ok")).alias("outcome"))


@query("D11_delivery_batch_check", "WITH " + CONTENT_SQL + """
SELECT feed AS batch, count(*) AS n_items, bool_and(lang IN ('en','es') AND length(title) <= 255) AS accepted,
       CAST(count(*) FILTER (WHERE NOT (lang IN ('en','es') AND length(title) <= 255)) AS BIGINT) AS bad_items FROM content GROUP BY 1""")
def delivery_batch_check(t):
    """One bad item rejects its whole batch; here a batch is the feed's items."""
    kinds = F.array(F.when(F.col("lang").isin("en", "es"), "BLOG").otherwise("VIDEO"))
    ok = checks.deliverable("title", kinds, "text")
    return t.content().groupBy(F.col("feed").alias("batch")).agg(
        F.count(F.lit(1)).alias("n_items"), F.bool_and(ok).alias("accepted"), F.count_if(~ok).alias("bad_items"))


@query("D13_minimum_length", "SELECT doc_id FROM documents WHERE length(text) >= 100")
def minimum_length(t):
    return t.documents().filter(F.length("text") >= 100).select("doc_id")


@query("D14_item_constraints", "WITH " + ITEMS_SQL + r"""
SELECT id, CASE WHEN length(title) = 0 THEN 'Title cannot be empty' WHEN length(payload) = 0 THEN 'Content cannot be empty'
 WHEN NOT regexp_matches(url, '(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$') THEN 'Invalid URL format' ELSE 'ok' END AS outcome
FROM items""")
def item_constraints(t):
    err = (F.when(~checks.filled("title"), "Title cannot be empty").when(~checks.filled("payload"), "Content cannot be empty")
           .when(~F.col("url").rlike(checks.URL_RE), "Invalid URL format").otherwise("ok"))
    return t.items().select("id", err.alias("outcome"))


@query("D15_enhancement_constraints", """
SELECT doc_id, concat_ws('; ', CASE WHEN length(trim(coalesce(text, ''))) = 0 OR n_chars < 40 THEN 'summary must not be empty' END,
 CASE WHEN NOT n_chars / 4000.0 BETWEEN 0 AND 1 THEN 'credibility must be between 0 and 1' END,
 CASE WHEN NOT n_chars / 8000.0 BETWEEN 0 AND 1 THEN 'quality must be between 0 and 1' END,
 CASE WHEN quality IS NULL THEN 'each fact needs fact and confidence' END) AS errors FROM documents LEFT JOIN labels USING (doc_id)""")
def enhancement_constraints(t):
    """Documents as enhancement results: short ones have no summary, unlabelled ones a fact without confidence."""
    d = t.documents().join(t.read("labels").select("doc_id", "quality"), "doc_id", "left")
    row = d.select("doc_id", F.when(F.col("n_chars") >= 40, F.col("text")).alias("summary"), (F.col("n_chars") / 4000).alias("credibility"),
                   (F.col("n_chars") / 8000).alias("score"), F.array(F.struct(F.lit("f").alias("fact"), F.col("quality").cast("double").alias("confidence"))).alias("facts"))
    return row.select("doc_id", F.array_join(checks.enhancement_errors("summary", "credibility", "score", "facts"), "; ").alias("errors"))


@query("D17_source_content_constraints", """
SELECT doc_id, concat_ws('; ', CASE WHEN NOT n_chars / 8000.0 BETWEEN 0 AND 1 THEN 'quality must be between 0 and 1' END,
 CASE WHEN NOT n_chars / 40.0 BETWEEN 0 AND 100 THEN 'readability must be between 0 and 100' END,
 CASE WHEN NOT n_chars / 2000.0 - 1 BETWEEN -1 AND 1 THEN 'sentiment must be between -1 and 1' END,
 CASE WHEN lang = 'de' THEN 'content lacks title' END, CASE WHEN source = 'src0' THEN 'content lacks url' END) AS errors FROM documents""")
def source_content_constraints(t):
    row = t.documents().select("doc_id", (F.col("n_chars") / 8000).alias("q"), (F.col("n_chars") / 40).alias("r"), (F.col("n_chars") / 2000 - 1).alias("s"), content_fields())
    return row.select("doc_id", F.array_join(checks.source_content_errors("q", "r", "s", "content"), "; ").alias("errors"))


@query("D18_generated_content_constraints", """
SELECT doc_id, concat_ws('; ', CASE WHEN NOT n_chars / 3000.0 BETWEEN 0 AND 1 THEN 'temperature must be between 0 and 1' END,
 CASE WHEN NOT n_chars / 8000.0 BETWEEN 0 AND 1 THEN 'review score must be between 0 and 1' END,
 CASE WHEN lang = 'de' THEN 'content lacks title' END) AS errors FROM documents""")
def generated_content_constraints(t):
    row = t.documents().select("doc_id", (F.col("n_chars") / 3000).alias("t"), (F.col("n_chars") / 8000).alias("r"), content_fields())
    return row.select("doc_id", F.array_join(checks.generated_content_errors("t", "r", "content"), "; ").alias("errors"))


def content_fields():
    """Fields of a stored content; German ones lack the title, those of one source the link."""
    fields = F.create_map(F.lit("title"), F.when(F.col("lang") != "de", F.col("lang")), F.lit("body"), F.col("text"), F.lit("url"), F.when(F.col("source") != "src0", F.col("source")))
    return F.map_filter(fields, lambda _, v: v.isNotNull()).alias("content")


@query("D19_training_selection", """
SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality >= 1 AND d.n_chars >= 500 AND d.lang IN ('en','fr')""")
def training_selection(t):
    """Minimum quality and engagement, optional topic list."""
    topics = F.array(F.lit("en"), F.lit("fr"))
    wanted = (F.col("quality") >= 1) & (F.col("n_chars") >= 500) & ((F.size(topics) == 0) | F.arrays_overlap(F.array("lang"), topics))
    return t.documents().select("doc_id", "n_chars", "lang").join(t.read("labels").select("doc_id", "quality"), "doc_id").filter(wanted).select("doc_id")


@query("D20_webhook_url", "WITH " + ITEMS_SQL + r" SELECT id, regexp_matches(url, '^https?://[^\s]+$') AS valid FROM items")
def webhook_url(t):
    return t.items().select("id", F.col("url").rlike(checks.WEBHOOK_URL_RE).alias("valid"))


@query("D21_severity_threshold", "WITH " + ERRORS_SQL + """
SELECT error_no, level FROM (SELECT error_no, CASE severity WHEN 'low' THEN 'info' WHEN 'medium' THEN 'warning' WHEN 'high' THEN 'error' ELSE 'critical' END AS level FROM errors)
WHERE level IN ('error','critical')""")
def severity_threshold(t):
    s = F.col("severity")
    level = F.when(s == "low", "info").when(s == "medium", "warning").when(s == "high", "error").otherwise("critical")
    return t.errors().select("error_no", level.alias("level")).filter(checks.at_least("level", "error", NOTICE_RANKS))


@query("D22_good_and_quarantined", "WITH " + ITEMS_SQL + f"""
SELECT CASE WHEN e1 IS NULL AND e2 IS NULL THEN 'good' ELSE 'quarantine' END AS part,
 concat_ws('; ', e1, e2) AS errors, count(*) AS n FROM (SELECT {URL_ERROR_SQL.replace(' u ', ' url ').replace('(u', '(url')} AS e1,
 CASE WHEN value < 1 THEN 'Value too small' END AS e2 FROM items) GROUP BY 1, 2""")
def good_and_quarantined(t):
    checked = t.items().withColumn("errors", checks.errors(
        checks.url_error("url"), F.when(F.col("value") < 1, "Value too small")))
    part = F.when(F.size("errors") == 0, "good").otherwise("quarantine")  # one pass for both parts
    return checked.groupBy(part.alias("part"), F.array_join("errors", "; ").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query("G20_missing_fields", """
SELECT event_id, concat_ws(',', CASE WHEN event_type='error' THEN 'title' END, CASE WHEN value < 5 THEN 'brief' END) AS missing FROM events""")
def missing_fields(t):
    present = checks.present_fields({
        "title": F.when(F.col("event_type") != "error", F.col("event_type")),
        "brief": F.when(F.col("value") >= 5, F.col("props")),
        "url": F.col("props")})
    return t.read("events").select("event_id", F.array_join(checks.missing(["title", "brief", "url"], present), ",").alias("missing"))

"""Source scans, reshaping and labelling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.functions import dates, rules, text
from contentflow.operators import chain, normalize, ordering, storage
from contentflow.plans.registry import query
from contentflow.sources.views import AS_OF, ATTEMPTS_SQL, CONTENT_SQL, ERRORS_SQL, ITEMS_SQL, as_of, small_table
from contentflow.vocab import LOG_LEVELS, MIME_TYPES, NOTICE_COLOURS, RETRY_LIMITS, SENSITIVE_KEYS

TS = "yyyy-MM-dd HH:mm:ss"
ASOF_SQL = f"TIMESTAMP '{AS_OF}'"
FMT = "'%Y-%m-%d %H:%M:%S'"


def stamp(c):
    return F.date_format(c, TS)


def raw_items(t):
    """Items in the nested reading-list form: epoch seconds, structs and arrays."""
    return t.items().select(
        F.concat(F.lit("tag:"), F.col("id").cast("string")).alias("id"), "title",
        F.when(F.col("k") % 3 == 0, F.lit(None)).otherwise(F.col("feed")).alias("author"),
        F.unix_seconds("published").alias("published"),
        F.struct(F.concat(F.lit("<p>"), F.col("title"), F.lit("</p> "), F.col("payload")).alias("content")).alias("summary"),
        F.array(F.struct(F.col("url").alias("href"))).alias("canonical"),
        F.array(F.struct(F.col("category").alias("label")), F.struct(F.lit(None).cast("string").alias("label"))).alias("categories"),
        F.array(F.struct(F.col("category").alias("label"))).alias("tags"),
        F.col("published").alias("at"),
    )


RAW_SQL = ITEMS_SQL + """,
raw AS (SELECT 'tag:' || id AS id, title, CASE WHEN k % 3 = 0 THEN NULL ELSE feed END AS author,
               CAST(floor(epoch(published)) AS BIGINT) AS published,
               '<p>' || title || '</p> ' || payload AS content, url, category FROM items)"""

CTYPE_SQL = """CASE WHEN regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)),
  'youtube\\.com|vimeo\\.com|dailymotion\\.com') THEN 'VIDEO'
  WHEN regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)),
  'twitter\\.com|linkedin\\.com|facebook\\.com|instagram\\.com') THEN 'SOCIAL' ELSE 'BLOG' END"""

CATALOG_SQL = CONTENT_SQL + """,
feeds AS (SELECT item_key AS id, title, text, feed, lang,
                 TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id % 40000 AS INTEGER)) AS pub_date, doc_id FROM content),
names AS (SELECT item_key AS feed_id, lang AS name FROM content UNION SELECT item_key, feed FROM content)"""


def catalog(t):
    """(feeds, feed_tags, tags) of the stored catalogue; tags are language and source."""
    c = t.content()
    feeds = c.select(F.col("item_key").alias("id"), "title", "text",
                     F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
                                        + (F.col("doc_id") % 40000) * 60000000).alias("pub_date"))
    pairs = c.select(F.col("item_key").alias("feed_id"), F.explode(F.array("lang", "feed")).alias("name"))
    tags = pairs.select("name").distinct().withColumn("tag_id", F.xxhash64("name"))
    bridge = pairs.select("feed_id", F.xxhash64("name").alias("tag_id"))
    return feeds, bridge, tags


# --- scans ------------------------------------------------------------------------

@query("A3_unread_items", "WITH " + ITEMS_SQL + """
SELECT i.id, i.title FROM items i
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type='purchase' AND e.event_id = i.id)""")
def unread_items(t):
    """Items minus those in the read state."""
    seen = t.events().filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("id"))
    return t.items().select("id", "title").join(seen, "id", "left_anti")


@query("A4_mark_as_read", "WITH " + ITEMS_SQL + """
SELECT DISTINCT id FROM (SELECT id FROM items WHERE category='purchase' UNION ALL
                         SELECT id FROM items WHERE rank=1)""")
def mark_as_read(t):
    """Newly read ids join the read state once."""
    i = t.items()
    return i.filter("category = 'purchase'").select("id").union(i.filter("rank = 1").select("id")).distinct()


@query("A5_oldest_page_per_feed", "WITH " + ITEMS_SQL + """
SELECT feed, id, place FROM (SELECT feed, id, row_number() OVER (PARTITION BY feed ORDER BY published, id) AS place
FROM items) WHERE place <= 20""")
def oldest_page(t):
    return storage.oldest_per_feed(t.items().select("feed", "id", "published"), "feed", 20, "published", "id").select(
        "feed", "id", F.col("place").cast("bigint").alias("place"))


@query("A12_items_by_status", "WITH " + ITEMS_SQL + """
SELECT id, title, url FROM items WHERE category = 'error' ORDER BY id LIMIT 25""")
def items_by_status(t):
    rows = t.items().withColumn("processed_status", F.col("category"))
    return storage.by_status(rows, "error", 25).select("id", "title", "url")


@query("A13_feed_listing_with_tags", "WITH " + CATALOG_SQL + """
SELECT f.id, strftime(f.pub_date, '%Y-%m-%d %H:%M:%S') AS pub_date, f.title,
       coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM names n WHERE n.feed_id=f.id), '') AS tags,
       CAST(len(list_filter(string_split_regex(f.text, '[.!?]+'), lambda s: trim(s, ' ' || chr(9)||chr(10)||chr(13)||chr(12)) <> '')) AS BIGINT) AS sentence_count,
       round(CASE WHEN w > 0 THEN 1 - least(abs(w * 1.0 / p - 15) / 10, 1.0) ELSE 0 END, 6) AS readability
FROM (SELECT *, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS w, len(string_split(text, '. ')) AS p
      FROM feeds WHERE length(text) >= 100) f
ORDER BY f.pub_date DESC, f.id LIMIT 20""")
def feed_listing(t):
    """Accepted feeds with tags and text scores, newest first."""
    feeds, bridge, tags = catalog(t)
    page = storage.listing(feeds.filter(F.length("text") >= 100), bridge, tags, limit=20)
    return page.select(
        "id", stamp("pub_date").alias("pub_date"), "title", F.array_join("tags", ",").alias("tags"),
        text.terminal_sentence_count("text").cast("bigint").alias("sentence_count"),
        F.round(text.readability_ideal_length("text"), 6).alias("readability"))


@query("A14_feed_by_id", "WITH " + CATALOG_SQL + """
SELECT f.id, f.title, coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM names n WHERE n.feed_id=f.id), '') AS tags
FROM feeds f WHERE f.id = 'item-17'""")
def feed_by_id(t):
    feeds, bridge, tags = catalog(t)
    one = storage.listing(feeds.filter("id = 'item-17'"), bridge.filter("feed_id = 'item-17'"), tags)
    return one.select("id", "title", F.array_join("tags", ",").alias("tags"))


@query("A17_feed_metadata_lookup", "WITH " + ITEMS_SQL + """
SELECT i.id, i.feed, c.c_name AS name, c.c_mktsegment AS segment FROM items i
JOIN customer c ON i.feed = 'feed/' || c.c_custkey""")
def feed_metadata(t):
    """Items with the metadata of their feed; AQE broadcasts the dimension when it is small."""
    dim = t.read("customer").select(F.concat(F.lit("feed/"), F.col("c_custkey").cast("string")).alias("feed"),
                                    F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return t.items().select("id", "feed").join(dim, "feed").select("id", "feed", "name", "segment")


# --- reshaping --------------------------------------------------------------------

@query("C1_normalised_item", "WITH " + RAW_SQL + """
SELECT id, title, coalesce(author,'') AS author, content, url,
       strftime(to_timestamp(published) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS published,
       category || ',' AS categories FROM raw""")
def normalised_item(t):
    out = normalize.reading_list_item(raw_items(t), as_of())
    return out.withColumn("categories", F.array_join("categories", ",")).drop("processed_at")


@query("C2_content_item", "WITH " + RAW_SQL + f"""
SELECT title, {CTYPE_SQL} AS content_type, substring(content,1,2000) AS brief, id AS feed_id, url AS original_url,
       strftime(to_timestamp(published) AT TIME ZONE 'UTC', {FMT}) AS publish_date, coalesce(author,'-') AS author, category AS tags
FROM raw""")
def content_item(t):
    m = F.col("sourceMetadata")
    return normalize.content_item(raw_items(t)).select(
        "title", "content_type", "brief", m["feedId"].alias("feed_id"), m["originalUrl"].alias("original_url"),
        stamp(m["publishDate"]).alias("publish_date"), F.coalesce(m["author"], F.lit("-")).alias("author"),
        F.array_join(m["tags"], ",").alias("tags"))


@query("C5_migrated_source", """
SELECT 'd' || doc_id AS content_id, coalesce(nullif(source,'src3'),'unknown') AS source, text AS body,
       coalesce(nullif(lang,'de'),'en') AS language,
       CAST(len(regexp_extract_all(text,'[^ \\t\\n\\r\\f]+')) AS BIGINT) AS word_count,
       CAST(len(regexp_extract_all(text,'[^ \\t\\n\\r\\f]+')) // 200 AS BIGINT) AS read_time, 0.0::DOUBLE AS engagement_score,
       'migrated' AS status
FROM documents""")
def migrated_source(t):
    none = F.lit(None).cast("string")
    old = t.documents().select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.nullif(F.col("source"), F.lit("src3")).alias("source"), none.alias("title"), F.col("text").alias("content"),
        none.alias("summary"), none.alias("url"), none.alias("author"), F.lit(None).cast("timestamp").alias("pub_date"),
        F.nullif(F.col("lang"), F.lit("de")).alias("lang"), F.lit(None).cast("array<string>").alias("categories"),
        F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("double").alias("engagement"))
    return normalize.migrated_source(old, as_of()).select(
        "content_id", "source", "content.body", "metadata.language",
        F.col("metrics.word_count").cast("bigint").alias("word_count"),
        F.col("metrics.read_time").alias("read_time"), "metrics.engagement_score", "processing.status")


GENERATED_SQL = """
SELECT 'g' || doc_id AS content_id, 'd' || doc_id AS source_id, coalesce(nullif(source, 'src3'), '') AS title, text AS body,
 coalesce(quality, 0)::DOUBLE AS coherence_score, CASE WHEN toxic = 1 THEN 'rejected' ELSE 'pending' END AS review_status
FROM documents LEFT JOIN labels USING (doc_id)"""


def old_contents(t):
    """Documents in the columns of both old record forms; every third one is a generated content."""
    text_null, d = F.lit(None).cast("string"), t.documents().join(t.read("labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return d.select(
        "doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "g").otherwise("d"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("doc_id") % 3 == 0, "generated").otherwise("source").alias("kind"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.nullif("source", F.lit("src3")).alias("gen_title"),
        F.col("text").alias("gen_content"), text_null.alias("gen_summary"), text_null.alias("model_version"), text_null.alias("prompt_id"),
        F.struct(F.col("quality").cast("double").alias("coherence"), F.lit(None).cast("double").alias("relevance"), F.lit(None).cast("double").alias("creativity")).alias("quality"),
        F.when(F.col("toxic") == 1, "rejected").alias("status"), F.lit(None).cast("boolean").alias("published"),
        F.nullif("source", F.lit("src3")).alias("source"), text_null.alias("title"), F.col("text").alias("content"), text_null.alias("summary"),
        text_null.alias("url"), text_null.alias("author"), F.lit(None).cast("timestamp").alias("pub_date"), F.nullif("lang", F.lit("de")).alias("lang"),
        F.lit(None).cast("array<string>").alias("categories"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("double").alias("engagement"))


@query("C6_migrated_generated", GENERATED_SQL)
def migrated_generated(t):
    out = normalize.migrated_generated(old_contents(t).withColumn("id", F.concat(F.lit("g"), F.col("doc_id").cast("string"))), as_of())
    return out.select("content_id", "source_id", "content.title", "content.body", "quality_metrics.coherence_score", "status.review_status")


@query("C7_migrated_batch", """
SELECT CASE WHEN doc_id % 3 = 0 THEN 'generated' ELSE 'source' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'g' ELSE 'd' END || doc_id AS content_id,
 text AS body, CASE WHEN doc_id % 3 <> 0 THEN coalesce(nullif(lang, 'de'), 'en') ELSE '-' END AS language FROM documents""")
def migrated_batch(t):
    out = normalize.migrate_mixed(old_contents(t), as_of())
    return out.select("kind", "content_id", F.get_json_object("record", "$.content.body").alias("body"),
                      F.coalesce(F.get_json_object("record", "$.metadata.language"), F.lit("-")).alias("language"))


@query("D16_migration_check", """
SELECT 'd' || doc_id AS content_id, source <> 'src0' AND lang <> 'de' AS complete FROM documents""")
def migration_check(t):
    """Migrated records of which some lack the content or the metadata."""
    rows = t.documents().select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("content_id"),
                                F.when(F.col("source") != "src0", F.struct("text")).alias("content"),
                                F.when(F.col("lang") != "de", F.struct("lang")).alias("metadata"))
    return rows.select("content_id", normalize.migration_complete(rows).alias("complete"))


@query("C8_database_record", "WITH " + RAW_SQL + f"""
SELECT title, {CTYPE_SQL} AS content_type, substring(content,1,2000) AS brief, id AS feed_id, url AS original_url,
       strftime(to_timestamp(published) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS publish_date,
       coalesce(author,'-') AS author, 'new' AS processed_status FROM raw""")
def database_record(t):
    return normalize.db_record(normalize.content_item(raw_items(t))).withColumn(
        "author", F.coalesce("author", F.lit("-")))


@query("C9_item_metadata", f"""
SELECT doc_id, CAST(len(list_filter(string_split_regex(text,'[ \\t\\n\\r\\f]+'), lambda w: w <> '')) AS BIGINT) AS word_count,
       '{AS_OF}' AS processed_at FROM documents""")
def item_metadata(t):
    return t.documents().select("doc_id", text.word_count("text").cast("bigint").alias("word_count"),
                                stamp(as_of()).alias("processed_at"))


PRIORITY_SQL = f"""CAST(least(greatest(5 + CASE WHEN likes>1000 THEN 1 ELSE 0 END + CASE WHEN likes>5000 THEN 1 ELSE 0 END
 + CASE WHEN shares>500 THEN 1 ELSE 0 END + CASE WHEN shares>2000 THEN 1 ELSE 0 END + CASE WHEN comments>100 THEN 1 ELSE 0 END
 + CASE content_type WHEN 'VIDEO' THEN 2 WHEN 'NEWS' THEN 1 WHEN 'SOCIAL' THEN 1 ELSE 0 END
 + CASE WHEN epoch({ASOF_SQL}) - epoch(published) < 3600 THEN 2 WHEN epoch({ASOF_SQL}) - epoch(published) < 21600 THEN 1 ELSE 0 END,
 1), 10) AS BIGINT)"""

PAYLOAD_KEYS_SQL = ITEMS_SQL + """,
typed AS (SELECT *, CASE category WHEN 'view' THEN 'VIDEO' WHEN 'click' THEN 'SOCIAL' WHEN 'error' THEN 'NEWS' ELSE 'GENERAL' END AS content_type FROM items)"""


def typed_items(t):
    """Items with a JSON payload whose keys give the type away."""
    key = (F.when(F.col("category") == "view", "youtube_id").when(F.col("category") == "click", "likes")
           .when(F.col("category") == "error", "news_score").otherwise("other"))
    i = t.items().withColumn("json", F.concat(F.lit('{"'), key, F.lit('": null, "k": '), F.col("k").cast("string"), F.lit("}")))
    return i.withColumn("content_type", rules.content_type_of_payload("json"))


@query("C10_enriched_item", "WITH " + PAYLOAD_KEYS_SQL + f"""
SELECT id, content_type, {PRIORITY_SQL} AS priority, '{AS_OF}' AS processed_at FROM typed""")
def enriched_item(t):
    return typed_items(t).select(
        "id", "content_type",
        rules.priority_score("likes", "shares", "comments", "content_type", "published", as_of()).alias("priority"),
        stamp(as_of()).alias("processed_at"))


@query("C11_enhancement_result", r"""
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substring(text,1,200) || '...' END AS summary,
       facts AS fact_count,
       round_even(0.3*least(length(text)/1000.0,1.0)+0.4+0.3*least(facts/5.0,1.0), 2) AS quality_score
FROM (SELECT doc_id, text, CAST(len(regexp_extract_all(text,'[0-9]+')) AS BIGINT) AS facts FROM documents WHERE length(text) >= 100)""")
def enhancement_result(t):
    facts = F.regexp_count("text", F.lit("[0-9]+"))
    return normalize.enhanced(t.documents().select("doc_id", "text"), "text", facts).select(
        "doc_id", "summary", "fact_count", "quality_score")


@query("C13_webhook_payload", "WITH " + RAW_SQL + f"""
SELECT id AS feed_id, title, {CTYPE_SQL} AS content_type, content AS brief, url AS original_url,
       CASE WHEN regexp_matches(lower(title),'breaking|urgent') THEN 'High' WHEN regexp_matches(lower(title),'new|update') THEN 'Medium' ELSE 'Low' END AS priority
FROM raw""")
def webhook_payload(t):
    m = F.col("sourceMetadata")
    return normalize.webhook_payload(raw_items(t), as_of()).select(
        m["feedId"].alias("feed_id"), "title", F.array_join("contentType", ",").alias("content_type"), "brief",
        m["originalUrl"].alias("original_url"), "priority")


# --- labels -----------------------------------------------------------------------

@query("H1_content_type_by_url", "WITH " + ITEMS_SQL + f" SELECT id, {CTYPE_SQL} AS content_type FROM items UNION ALL SELECT page_id + 1000000000, {CTYPE_SQL} FROM pages")
def content_type_by_url(t):
    both = t.items().select("id", "url").unionByName(
        t.pages().select((F.col("page_id") + 1000000000).alias("id"), "url"))
    return both.select("id", rules.content_type_of_url("url").alias("content_type"))


@query("H2_content_type_by_fields", "WITH " + PAYLOAD_KEYS_SQL + " SELECT content_type, count(*) AS n FROM typed GROUP BY 1")
def content_type_by_fields(t):
    return typed_items(t).groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))


@query("H3_priority_score", "WITH " + PAYLOAD_KEYS_SQL + f" SELECT id, {PRIORITY_SQL} AS priority FROM typed")
def priority_score(t):
    return typed_items(t).select("id", rules.priority_score(
        "likes", "shares", "comments", "content_type", "published", as_of()).alias("priority"))


@query("H4_priority_level", "WITH " + ITEMS_SQL + """
SELECT id, CASE WHEN category='signup' THEN 'HIGH' WHEN published > TIMESTAMP '2024-01-30 00:00:00' THEN 'NORMAL' ELSE 'LOW' END AS priority FROM items""")
def priority_level(t):
    cats = F.array(F.when(F.col("category") == "signup", "Breaking News").otherwise(F.col("category")))
    return t.items().select("id", rules.priority_level(
        cats, "published", F.lit("2024-01-30 18:30:00").cast("timestamp")).alias("priority"))


@query("H5_priority_label", "WITH " + ITEMS_SQL + f"""
SELECT id, CASE WHEN category='error' THEN 'High' WHEN epoch_us({ASOF_SQL}) - epoch_us(published) < 86400000000 THEN 'Medium' ELSE 'Low' END AS priority FROM items""")
def priority_label(t):
    cats = F.array(F.when(F.col("category") == "error", "important").otherwise(F.col("category")))
    return t.items().select("id", rules.priority_label(cats, "published", as_of()).alias("priority"))


@query("H6_ruleset_priority", "WITH " + ITEMS_SQL + f"""
SELECT id, CASE WHEN contains(lower(title),'report 7') THEN 'HIGH'
  WHEN lower(feed) IN ('feed/3','feed/5') AND epoch_us({ASOF_SQL}) - epoch_us(published) <= 3600000000 THEN 'HIGH'
  WHEN category IN ('purchase') THEN 'HIGH'
  WHEN epoch_us({ASOF_SQL}) - epoch_us(published) <= 86400000000 THEN 'NORMAL' ELSE 'LOW' END AS priority FROM items""")
def ruleset_priority(t):
    return t.items().select("id", rules.ruleset_priority(
        "title", "feed", F.array("category"), "published", as_of(), ["report 7"], ["feed/3", "feed/5"],
        ["purchase"]).alias("priority"))


WS_TRIM = "' ' || chr(9)||chr(10)||chr(13)||chr(12)"


@query("H7_brief_and_summary", f"""
SELECT doc_id, trim(substring(text,1,200), {WS_TRIM}) || '...' AS brief,
       CASE WHEN length(text) <= 200 THEN text ELSE substring(text,1,200) || '...' END AS summary FROM documents""")
def brief_and_summary(t):
    return t.documents().select("doc_id", text.brief("text").alias("brief"), text.short_summary("text").alias("summary"))


@query("H8_tags_stripped", "SELECT page_id, regexp_replace(html,'<[^>]+>','','g') AS body, regexp_matches(html,'<[^>]+>') AS had_tags FROM pages")
def tags_stripped(t):
    return t.pages().select("page_id", text.strip_tags("html").alias("body"), F.col("html").rlike("<[^>]+>").alias("had_tags"))


@query("H9_epoch_to_iso", "WITH " + RAW_SQL + """
SELECT id, strftime(to_timestamp(published) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM raw""")
def epoch_to_iso(t):
    return raw_items(t).select("id", dates.iso_utc(F.timestamp_seconds("published")).alias("iso"))


@query("H10_utc_date", "WITH " + ITEMS_SQL + " SELECT id, strftime(published, '%Y-%m-%d') AS day FROM items")
def utc_date(t):
    return t.items().select("id", dates.utc_date("published").alias("day"))


# RE2 has no look-around, so both sides use the same pattern text.
MENTION_SQL = dates.MENTION_RE.replace("'", "''")
CONF_SQL = dates.CONFIDENCE_RE.replace("'", "''")
SENT_SQL = f"list_filter(list_transform(string_split_regex(text,'[.!?]+'), lambda s: trim(s, {WS_TRIM})), lambda s: s <> '')"
RESOLVED_SQL = f"""resolved AS (SELECT *, CASE lower(mention) WHEN 'yesterday' THEN {ASOF_SQL} - INTERVAL 1 DAY WHEN 'today' THEN {ASOF_SQL}
  WHEN 'tomorrow' THEN {ASOF_SQL} + INTERVAL 1 DAY WHEN 'last week' THEN {ASOF_SQL} - INTERVAL 7 DAY
  WHEN 'this week' THEN {ASOF_SQL} WHEN 'next week' THEN {ASOF_SQL} + INTERVAL 7 DAY
  WHEN 'last month' THEN {ASOF_SQL} - INTERVAL 30 DAY WHEN 'this month' THEN {ASOF_SQL} WHEN 'next month' THEN {ASOF_SQL} + INTERVAL 30 DAY
  WHEN 'last year' THEN {ASOF_SQL} - INTERVAL 365 DAY WHEN 'this year' THEN {ASOF_SQL} WHEN 'next year' THEN {ASOF_SQL} + INTERVAL 365 DAY
  ELSE coalesce(try_strptime(mention, '%Y-%m-%d'), try_strptime(mention, '%Y/%m/%d'), try_strptime(mention, '%m/%d/%Y'),
    try_strptime(mention, '%d/%m/%Y'), try_strptime(mention, '%B %d, %Y'), try_strptime(mention, '%b %d, %Y'),
    try_strptime(mention, '%Y'), TIMESTAMP '9999-12-31 23:59:59') END AS when_ts FROM mentions)"""

DATED_SQL = f"""
dated AS (SELECT 'doc' || doc_id AS key, text FROM documents
          UNION ALL SELECT 'ord' || o_orderkey, 'Order placed on ' || strftime(o_orderdate, '%Y-%m-%d') || ' and due '
                || CASE WHEN o_orderkey % 4 = 0 THEN 'last week' WHEN o_orderkey % 4 = 1 THEN 'Tomorrow'
                        WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%B %d, %Y') END
                || '. Priority ' || o_orderpriority || '!' FROM orders),
sents AS (SELECT key, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM (SELECT key, {SENT_SQL} AS s FROM dated)),
mentions AS (SELECT key, pos, sentence, unnest(m) AS mention, unnest(range(len(m))) AS nth
             FROM (SELECT *, regexp_extract_all(sentence, '{MENTION_SQL}') AS m FROM sents)),
{RESOLVED_SQL}"""


def dated_sentences(t):
    """Sentences of documents and of order notes that carry dates of every kind."""
    o = t.read("orders")
    d = F.col("o_orderdate").cast("timestamp")
    kind = F.col("o_orderkey") % 4
    due = (F.when(kind == 0, "last week").when(kind == 1, "Tomorrow").when(kind == 2, F.date_format(d, "MM/dd/yyyy"))
           .otherwise(F.date_format(d, "MMMM dd, yyyy")))
    notes = o.select(
        F.concat(F.lit("ord"), F.col("o_orderkey").cast("string")).alias("key"),
        F.concat(F.lit("Order placed on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" and due "), due, F.lit(". Priority "),
                 F.col("o_orderpriority"), F.lit("!")).alias("text"))
    docs = t.documents().select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("key"), "text")
    return docs.unionByName(notes).select("key", F.posexplode(text.sentences("text")).alias("pos", "sentence"))


def mentions(t):
    return dated_sentences(t).select("key", "pos", "sentence", F.posexplode(dates.date_mentions("sentence")).alias("nth", "mention"))


@query("H12_date_mentions", "WITH " + DATED_SQL + """
SELECT key, CAST(pos AS BIGINT) AS pos, CAST(nth AS BIGINT) AS nth, mention, sentence FROM mentions""")
def date_mentions(t):
    return mentions(t).select("key", F.col("pos").cast("bigint").alias("pos"), F.col("nth").cast("bigint").alias("nth"), "mention", "sentence")


@query("H13_resolved_mentions", "WITH " + DATED_SQL + f"""
SELECT mention, strftime(when_ts, {FMT}) AS resolved, count(*) AS n FROM resolved GROUP BY 1, 2""")
def resolved_mentions(t):
    return (mentions(t).groupBy("mention").agg(F.count(F.lit(1)).alias("n"))
            .select("mention", stamp(dates.resolve_mention("mention", as_of())).alias("resolved"), "n"))


@query("H14_mention_confidence", "WITH " + DATED_SQL + f"""
SELECT key, CAST(pos AS BIGINT) AS pos, round(CASE WHEN regexp_matches(sentence, '{CONF_SQL}') THEN 0.6 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(sentence,'[^ \\t\\n\\r\\f]+')) > 5 THEN 0.4 ELSE 0 END::DOUBLE, 6)::DOUBLE AS confidence FROM sents""")
def mention_confidence(t):
    return dated_sentences(t).select("key", F.col("pos").cast("bigint").alias("pos"),
                                     F.round(dates.mention_confidence("sentence"), 6).alias("confidence"))


@query("G16_timeline_order", "WITH " + DATED_SQL + """
SELECT key, mention, CAST(row_number() OVER (PARTITION BY key ORDER BY when_ts, pos, nth) AS BIGINT) AS place FROM resolved""")
def timeline_order(t):
    """Events of one text by resolved date; a text is bounded by its own length."""
    from pyspark.sql import Window
    m = mentions(t).withColumn("at", dates.resolve_mention("mention", as_of()))
    w = Window.partitionBy("key").orderBy("at", "pos", "nth")
    return m.select("key", "mention", F.row_number().over(w).cast("bigint").alias("place"))


@query("H41_content_hash", """SELECT event_id, sha256('{"kind":"' || event_type || '","payload":"' || replace(props,'"','\\"') || '"}') AS hash FROM events""")
def content_hash(t):
    """Maps written in different key order hash alike."""
    e = t.read("events")
    one = F.create_map(F.lit("payload"), F.col("props"), F.lit("kind"), F.col("event_type"))
    other = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("payload"), F.col("props"))
    return e.select("event_id", rules.content_hash(F.when(F.col("event_id") % 2 == 0, one).otherwise(other)).alias("hash"))


@query("H42_redacted_message", "WITH " + ERRORS_SQL + """
SELECT error_no, regexp_replace(regexp_replace(regexp_replace(message,'token=[a-zA-Z0-9_-]+','token=REDACTED','g'),
 'password=[a-zA-Z0-9_-]+','password=REDACTED','g'),'key=[a-zA-Z0-9_-]+','key=REDACTED','g') AS message FROM errors
UNION ALL SELECT -1 - doc_id, regexp_replace(regexp_replace(regexp_replace(text,'token=[a-zA-Z0-9_-]+','token=REDACTED','g'),
 'password=[a-zA-Z0-9_-]+','password=REDACTED','g'),'key=[a-zA-Z0-9_-]+','key=REDACTED','g') FROM documents""")
def redacted_message(t):
    both = t.errors().select("error_no", "message").unionByName(
        t.documents().select((-1 - F.col("doc_id")).alias("error_no"), F.col("text").alias("message")))
    return both.select("error_no", rules.redact("message").alias("message"))


# Fixed values: (policy, base seconds, cap seconds).
BACKOFF = [("webhook", 1.0, 8.0), ("delivery", 5.0, None), ("errors", 1.0, 60.0), ("fetch", 1.0, 300.0), ("api", 0.2, 60.0)]
BACKOFF_SQL = ", ".join(f"('{p}', {b}::DOUBLE, {'NULL' if c is None else c}::DOUBLE)" for p, b, c in BACKOFF)


@query("H45_backoff_schedule", "WITH " + ATTEMPTS_SQL + f""",
f AS (SELECT item_id, count(*) AS failures FROM attempts WHERE NOT ok GROUP BY 1),
a AS (SELECT attempt, count(*) AS n FROM (SELECT unnest(range(0, failures)) AS attempt FROM f) GROUP BY 1)
SELECT policy, attempt, least(base * pow(2, attempt), coalesce(cap, 1e300)) AS delay, n FROM a, (VALUES {BACKOFF_SQL}) p(policy, base, cap)""")
def backoff_schedule(t):
    """Delay before each retry that took place, under each policy, and how many items waited for it."""
    from contentflow.plans.metrics import attempts_reached

    failures = t.attempts().filter(~F.col("ok")).groupBy("item_id").agg(F.count(F.lit(1)).alias("failures"))
    plan = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(b).alias("base"), F.lit(c).cast("double").alias("cap")) for p, b, c in BACKOFF])
    rows = attempts_reached(failures, "failures").select((F.col("attempt") - 1).alias("attempt"), "n", F.inline(plan))
    delay = F.col("base") * F.pow(F.lit(2.0), F.col("attempt"))
    return rows.select("policy", "attempt", F.least(delay, F.coalesce("cap", F.lit(1e300))).alias("delay"), "n")


@query("H48_severity_presentation", "WITH " + ERRORS_SQL + """
SELECT error_no, CASE severity WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'ERROR' WHEN 'medium' THEN 'WARNING' ELSE 'INFO' END AS log_level,
 CASE severity WHEN 'critical' THEN '#7b001c' ELSE '#000000' END AS colour FROM errors""")
def severity_presentation(t):
    return t.errors().select("error_no", rules.mapped("severity", LOG_LEVELS, "INFO").alias("log_level"),
                             rules.mapped("severity", NOTICE_COLOURS, "#000000").alias("colour"))


MIME_PATH_SQL = "CASE page_id % 7 WHEN 0 THEN '/a.json' WHEN 1 THEN '/b.TXT' WHEN 2 THEN '/c.md' WHEN 3 THEN '/d.pdf' WHEN 4 THEN '/e.doc' WHEN 5 THEN '/f.x.docx' ELSE '/.hidden' END"


@query("H49_mime_type", f"""
SELECT page_id, CASE ext WHEN '.json' THEN 'application/json' WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown'
 WHEN '.pdf' THEN 'application/pdf' WHEN '.doc' THEN 'application/msword'
 WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS mime
FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url,'[?#].*$','') || {MIME_PATH_SQL}, '[^/](\\.[^./]+)$', 1)) AS ext FROM pages)""")
def mime_type(t):
    names = ["/a.json", "/b.TXT", "/c.md", "/d.pdf", "/e.doc", "/f.x.docx", "/.hidden"]
    path = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % 7 + 1).cast("int")))
    return t.pages().select("page_id", rules.mapped(rules.extension(path), MIME_TYPES, "application/octet-stream").alias("mime"))


@query("H50_endpoint_key", """SELECT page_id, regexp_extract(url,'^[a-z]+://([^/?#]*)',1) || regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1) AS endpoint FROM pages""")
def endpoint_key(t):
    return t.pages().select("page_id", F.concat(
        F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1),
        F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)).alias("endpoint"))


@query("H51_payload_size", """SELECT doc_id, CAST(strlen(to_json({'id': doc_id, 'text': text})) AS BIGINT) AS payload_bytes FROM documents""")
def payload_size(t):
    return t.documents().select("doc_id", F.octet_length(F.to_json(F.struct(F.col("doc_id").alias("id"), "text"))).cast("bigint").alias("payload_bytes"))


@query("H52_error_id", "WITH " + ERRORS_SQL + """
SELECT error_no, 'err_' || (epoch_us(ts) // 1000) || '_' || (1000 + CAST('0x' || substr(md5(error_no || '|' || service), 1, 8) AS BIGINT) % 9000) AS error_id FROM errors""")
def error_ids(t):
    return t.errors().select("error_no", rules.error_id("ts", "error_no", "service").alias("error_id"))


@query("H53_age_hours", "WITH " + ITEMS_SQL + f" SELECT id, round((epoch_us({ASOF_SQL}) - epoch_us(published))/3600000000.0, 6) AS age_hours FROM items")
def age_hours(t):
    return t.items().select("id", F.round(rules.age_hours("published", as_of()), 6).alias("age_hours"))


@query("H54_read_time", "SELECT doc_id, CAST(len(regexp_extract_all(text,'[^ \\t\\n\\r\\f]+')) // 200 AS BIGINT) AS read_time FROM documents")
def read_time(t):
    return t.documents().select("doc_id", normalize.read_minutes(text.word_count("text")).alias("read_time"))


@query("H57_headline_priority", """SELECT doc_id, CASE WHEN regexp_matches(lower(text),'breaking|urgent') THEN 'High' WHEN regexp_matches(lower(text),'new|update') THEN 'Medium' ELSE 'Low' END AS priority FROM documents""")
def headline_priority(t):
    return t.documents().select("doc_id", rules.headline_priority("text").alias("priority"))


@query("H58_fact_category", f"""
SELECT category, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(s),'[0-9]+(\\.[0-9]+)?( ?%| percent)|[0-9]{{2,}}') THEN 'STATISTICAL'
 WHEN regexp_matches(lower(s),'(^|[^a-z])(year|years|month|months|week|weeks|today|yesterday|recent|recently|century)($|[^a-z])') THEN 'TEMPORAL' ELSE 'GENERAL' END AS category
 FROM (SELECT unnest({SENT_SQL}) AS s FROM documents)) GROUP BY 1""")
def fact_category(t):
    s = t.documents().select(F.explode(text.sentences("text")).alias("s"))
    return s.groupBy(rules.fact_category("s").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("H60_sensitive_keys_removed", """SELECT event_id, 'kind=' || event_type || ',k=' || props AS details FROM events""")
def sensitive_keys_removed(t):
    details = F.create_map(F.lit("api_key"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"),
                           F.lit("password"), F.lit("x"), F.lit("k"), F.col("props"))
    left = F.map_entries(rules.drop_keys(details, SENSITIVE_KEYS))
    return t.read("events").select("event_id", F.array_join(
        F.transform(left, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("details"))


@query("H47_retry_limits", "WITH " + ERRORS_SQL + """
SELECT e.error_no, CAST(coalesce(l.n, 1) AS BIGINT) AS max_retries FROM (SELECT *, CASE service WHEN 'svc0' THEN 'inoreader' WHEN 'svc1' THEN 'webhook' WHEN 'svc2' THEN 'test_service' ELSE service END AS system FROM errors) e
LEFT JOIN (VALUES ('inoreader','rate_limit_error',5),('inoreader','api_error',3),('inoreader','system_error',2),
 ('webhook','rate_limit_error',5),('webhook','delivery_error',3),('webhook','system_error',2),
 ('test_service','processing_error',1),('test_service','system_error',1)) l(s,c,n) ON l.s=e.system AND l.c=e.category""")
def retry_limits(t):
    limits = small_table(t.spark, RETRY_LIMITS, "system string, category string, n int")
    system = (F.when(F.col("service") == "svc0", "inoreader").when(F.col("service") == "svc1", "webhook")
              .when(F.col("service") == "svc2", "test_service").otherwise(F.col("service")))
    return (t.errors().withColumn("system", system).join(F.broadcast(limits), ["system", "category"], "left")
            .select("error_no", F.coalesce("n", F.lit(1)).cast("bigint").alias("max_retries")))


@query("H46_delivery_outcome", "WITH " + ATTEMPTS_SQL + """
SELECT attempt_id, CASE WHEN status_code = 429 THEN 'rate_limited' WHEN status_code >= 400 THEN 'http_error' ELSE 'success' END AS outcome,
 status_code >= 400 AS retry_any, status_code >= 500 AS retry_server FROM attempts""")
def delivery_outcome(t):
    c = F.col("status_code")
    return t.attempts().select("attempt_id", rules.delivery_outcome(c).alias("outcome"),
                               (c >= 400).alias("retry_any"), (c >= 500).alias("retry_server"))


CHAIN_PAGES_SQL = """
paged AS (SELECT event_id // 40 % 20 AS chain, event_id // 800 AS nr, count(*) AS n_items FROM events GROUP BY 1, 2),
pages AS (SELECT *, max(nr) OVER (PARTITION BY chain) AS last FROM paged),
here AS (SELECT * FROM pages WHERE (nr * 20 + chain) % 13 <> 5)"""


def event_pages(t):
    """Events as pages of 40 dealt over 20 chains; each page names the next one, and some pages have not landed."""
    e = t.read("events").select(F.col("event_id").cast("bigint").alias("id"))
    at, chain = F.floor(F.col("id") / 800), F.floor(F.col("id") / 40) % 20
    pages = e.groupBy(chain.alias("chain"), at.alias("at")).agg(F.count(F.lit(1)).alias("n_items"))
    last = pages.groupBy("chain").agg(F.max("at").alias("last"))
    token = lambda c: F.when(c == 0, F.lit("")).otherwise(F.concat(F.lit("p"), c.cast("string")))
    named = pages.join(last, "chain").select(
        "chain", "at", token(F.col("at")).alias("page_token"), F.when(F.col("at") < F.col("last"), token(F.col("at") + 1)).alias("continuation"), "n_items")
    return named.filter((F.col("at") * 20 + F.col("chain")) % 13 != 5)


@query("A2_page_chain", "WITH" + CHAIN_PAGES_SQL + """,
runs AS (SELECT chain, nr, nr - row_number() OVER (PARTITION BY chain ORDER BY nr) AS run, last FROM here),
r AS (SELECT chain, min(nr) AS lo, max(nr) AS hi, count(*) AS n, max(last) AS top FROM runs GROUP BY chain, run)
SELECT chain, CAST(coalesce(sum(n) FILTER (WHERE lo = 0), 0) AS BIGINT) AS reached,
 CASE WHEN count(*) FILTER (WHERE lo = 0) = 0 THEN '' ELSE max(CASE WHEN lo = 0 AND hi < top THEN 'p' || (hi + 1) END) END AS waits_for,
 bool_or(lo = 0 AND hi = top) AS complete, count(*) FILTER (WHERE lo > 0) AS n_waiting, CAST(coalesce(sum(n) FILTER (WHERE lo > 0), 0) AS BIGINT) AS waiting_pages
FROM r GROUP BY 1""")
def page_chain(t):
    """Chains of pages that land out of order in two batches: pieces are joined as they come."""
    pages, pieces = event_pages(t), None
    late = (F.col("at") * 7 + F.col("chain")) % 2 == 0
    for batch in (pages.filter(~late), pages.filter(late)):
        pieces = chain.landed(pieces, batch, ["chain"])
    return chain.chain_status(pieces, ["chain"])

"""Declared schemas of every external input and stored table; nothing is inferred."""

READING_LIST = """page_token STRING, continuation STRING, items ARRAY<STRUCT<id STRING, title STRING, author STRING,
published BIGINT, summary STRUCT<content STRING>, canonical ARRAY<STRUCT<href STRING>>,
categories ARRAY<STRUCT<label STRING>>, tags ARRAY<STRUCT<label STRING>>>>"""

SUBSCRIPTIONS = "subscriptions ARRAY<STRUCT<id STRING, title STRING, url STRING, htmlUrl STRING>>"

RSS = """channel STRUCT<title STRING, link STRING, description STRING, pubDate STRING,
item ARRAY<STRUCT<title STRING, link STRING, description STRING, guid STRING, pubDate STRING, published STRING,
image STRING, category ARRAY<STRING>>>>, _bad STRING"""

ATOM = """title STRING, link STRUCT<_href STRING>, id STRING, updated STRING,
entry ARRAY<STRUCT<title STRING, link STRUCT<_href STRING>, id STRING, updated STRING, summary STRING>>, _bad STRING"""

JSON_FEED = """version STRING, title STRING, home_page_url STRING, feed_url STRING,
items ARRAY<STRUCT<id STRING, title STRING, content_text STRING, url STRING, date_published STRING>>"""

DELIVERY = """title STRING, contentType STRING, brief STRING, priority STRING,
sourceMetadata STRUCT<feedId STRING, originalUrl STRING, publishDate STRING, author STRING, tags ARRAY<STRING>>,
research_status STRING, quality_score DOUBLE"""

PUSHED_ITEM = "id STRING, title STRING, content STRING, url STRING, priority STRING"

FEED_CONFIG = """feeds ARRAY<STRUCT<url STRING, name STRING, content_type STRING>>, fetch_interval_seconds INT,
max_items_per_fetch INT, retry_interval_seconds INT, log_level STRING"""

FEED_ITEMS = """id BIGINT, title STRING, content_type STRING, brief STRING, feed_id STRING, original_url STRING,
publish_date TIMESTAMP, author STRING, created_at TIMESTAMP, processed_status STRING"""

OLD_SOURCE = """id STRING, source STRING, title STRING, content STRING, summary STRING, url STRING, author STRING,
pub_date TIMESTAMP, lang STRING, categories ARRAY<STRING>, tags ARRAY<STRING>, engagement DOUBLE"""

OLD_GENERATED = """id STRING, source_id STRING, gen_title STRING, gen_content STRING, gen_summary STRING,
model_version STRING, prompt_id STRING, quality STRUCT<coherence DOUBLE, relevance DOUBLE, creativity DOUBLE>,
status STRING, published BOOLEAN"""

SOURCE_CONTENT = """id STRING, content MAP<STRING,STRING>, metrics STRUCT<quality_score DOUBLE, readability_score DOUBLE>,
analysis STRUCT<sentiment DOUBLE, content_type STRING>"""

GENERATED_CONTENT = """id STRING, content MAP<STRING,STRING>, generation STRUCT<temperature DOUBLE, model STRING>,
review STRUCT<status STRING, score DOUBLE>"""

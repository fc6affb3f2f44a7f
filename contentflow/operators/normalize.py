"""Reshaping of raw items into the stored, delivered and migrated forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.functions import dates, rules, text
from contentflow.functions.text import col



def _no_strings() -> Column:
    return F.array().cast("array<string>")


def labels(structs) -> Column:
    """Labels of an array of ``{label}``; a missing label is an empty string."""
    return F.coalesce(F.transform(col(structs), lambda x: F.coalesce(x["label"], F.lit(""))), _no_strings())


def reading_list_item(raw: DataFrame, as_of: Column) -> DataFrame:
    """Standard item of a reading-list entry (epoch seconds, nested summary and links)."""
    return raw.select(
        "id", "title",
        F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("summary.content", F.lit("")).alias("content"),
        F.coalesce(F.get("canonical", F.lit(0))["href"], F.lit("")).alias("url"),
        dates.iso_utc(F.timestamp_seconds(F.coalesce("published", F.lit(0)))).alias("published"),
        labels("categories").alias("categories"),
        as_of.alias("processed_at"),
    )


def content_item(raw: DataFrame, whole_url: bool = False) -> DataFrame:
    """Stored content item: type by link, first 2000 characters, labels as tags."""
    url = F.get("canonical", F.lit(0))["href"]
    return raw.select(
        "title",
        rules.content_type_of_url(url, whole_url).alias("content_type"),
        F.substring(F.coalesce("summary.content", F.lit("")), 1, 2000).alias("brief"),
        F.struct(
            F.col("id").alias("feedId"), url.alias("originalUrl"),
            F.timestamp_seconds("published").alias("publishDate"), F.col("author"),
            labels("tags").alias("tags"),
        ).alias("sourceMetadata"),
    )


def legacy_payload(raw: DataFrame, as_of: Column) -> DataFrame:
    """Flat payload of the first delivery format."""
    published = F.timestamp_seconds("published")
    return raw.select(
        "title",
        F.lit("BLOG").alias("contentType"),
        text.brief("content.content").alias("brief"),
        rules.priority_label("categories", published, as_of).alias("priority"),
        F.struct(
            F.col("origin.streamId").alias("feedId"),
            F.get("canonical", F.lit(0)).alias("originalUrl"),
            F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss").alias("publishDate"),
            F.col("author"), F.coalesce("categories", _no_strings()).alias("tags"),
        ).alias("sourceMetadata"),
    )


def feed_header(raw: DataFrame, feed_type: str, as_of: Column) -> DataFrame:
    """Normalised feed header. ``raw``: id, guid, title, content, summary, link, author,
    language, feed_id, tags, updated, pubDate, date_published (all nullable)."""
    stamp = {"atom": "updated", "rss": "pubDate"}.get(feed_type, "date_published")

    def text_or_empty(c):
        return F.coalesce(c, F.lit(""))

    return raw.select(
        F.coalesce("id", "guid").alias("id"), "title",
        F.struct(
            text_or_empty("content").alias("full"),
            F.substring(text_or_empty("summary"), 1, 2000).alias("brief"),
            F.lit("text" if feed_type == "json" else "html").alias("format"),
        ).alias("content"),
        F.struct(
            F.struct(
                text_or_empty("feed_id").alias("feedId"), F.coalesce("link", "id").alias("url"),
                dates.parse_feed_date(stamp).alias("publishDate"), text_or_empty("author").alias("author"),
                text_or_empty("language").alias("language"), F.coalesce("tags", _no_strings()).alias("tags"),
            ).alias("source"),
            F.struct(
                as_of.alias("receivedAt"), F.lit(None).cast("timestamp").alias("processedAt"),
                F.lit(0).alias("attempts"), F.lit("pending").alias("status"),
            ).alias("processing"),
        ).alias("metadata"),
        F.struct(
            F.lit(None).cast("string").alias("contentType"), F.lit("Medium").alias("priority"),
            F.lit(None).cast("double").alias("readabilityScore"), F.lit(None).cast("double").alias("sentimentScore"),
            _no_strings().alias("categories"), _no_strings().alias("keywords"),
        ).alias("analysis"),
    )


def migrated_source(old: DataFrame, as_of: Column) -> DataFrame:
    n = text.word_count(F.coalesce("content", F.lit("")))

    def or_(name, default):
        return F.coalesce(F.col(name), F.lit(default))

    return old.select(
        F.col("id").alias("content_id"), or_("source", "unknown").alias("source"),
        F.struct(or_("title", "").alias("title"), or_("content", "").alias("body"),
                 or_("summary", "").alias("summary"), or_("url", "").alias("url")).alias("content"),
        F.struct(or_("author", "").alias("author"), F.coalesce("pub_date", as_of).alias("published_date"),
                 or_("lang", "en").alias("language"), F.coalesce("categories", _no_strings()).alias("categories"),
                 F.coalesce("tags", _no_strings()).alias("tags")).alias("metadata"),
        F.struct(n.alias("word_count"), read_minutes(n).alias("read_time"),
                 or_("engagement", 0.0).alias("engagement_score")).alias("metrics"),
        F.struct(F.lit("migrated").alias("status"), as_of.alias("last_updated"),
                 F.lit("1.0").alias("version")).alias("processing"),
    )


def read_minutes(words_n: Column) -> Column:
    return F.floor(words_n / 200)


def migrated_generated(old: DataFrame, as_of: Column) -> DataFrame:
    def or_(name, default):
        return F.coalesce(F.col(name), F.lit(default))

    return old.select(
        F.col("id").alias("content_id"), "source_id",
        F.struct(or_("gen_title", "").alias("title"), or_("gen_content", "").alias("body"),
                 or_("gen_summary", "").alias("summary")).alias("content"),
        F.struct(as_of.alias("generated_date"), or_("model_version", "1.0").alias("model_version"),
                 F.col("prompt_id")).alias("metadata"),
        F.struct(or_("quality.coherence", 0.0).alias("coherence_score"),
                 or_("quality.relevance", 0.0).alias("relevance_score"),
                 or_("quality.creativity", 0.0).alias("creativity_score")).alias("quality_metrics"),
        F.struct(or_("status", "pending").alias("review_status"), or_("published", False).alias("publish_status"),
                 as_of.alias("last_updated")).alias("status"),
    )


def migrate_mixed(old: DataFrame, as_of: Column, kind: str = "kind") -> DataFrame:
    """Rows of both old forms as (kind, content_id, record JSON); an unknown kind stops the job.

    ``old`` carries the columns of both forms."""
    known = F.when(F.col(kind).isin("source", "generated"), F.col(kind)).otherwise(
        F.raise_error(F.concat(F.lit("Unknown content type: "), F.coalesce(F.col(kind), F.lit("null")))))
    checked = old.withColumn(kind, known)
    parts = [
        migrated_source(checked.filter(F.col(kind) == "source"), as_of).select(
            F.lit("source").alias("kind"), "content_id", F.to_json(F.struct("*")).alias("record")),
        migrated_generated(checked.filter(F.col(kind) != "source"), as_of).select(
            F.lit("generated").alias("kind"), "content_id", F.to_json(F.struct("*")).alias("record")),
    ]
    return parts[0].unionByName(parts[1])


def migration_complete(df: DataFrame) -> Column:
    return F.col("content_id").isNotNull() & F.col("content").isNotNull() & F.col("metadata").isNotNull()


def db_record(items: DataFrame) -> DataFrame:
    m = F.col("sourceMetadata")
    return items.select(
        "title", "content_type", "brief", m["feedId"].alias("feed_id"), m["originalUrl"].alias("original_url"),
        dates.iso_utc(m["publishDate"]).alias("publish_date"), m["author"].alias("author"),
        F.lit("new").alias("processed_status"))


def external_record(title, content_type, description, feed_id, link, published, author) -> list[Column]:
    """Columns of the external table: cut to its limits, tags stripped, plain UTC date."""
    return [
        F.coalesce(F.substring(col(title), 1, 99), F.lit("")).alias("Title"),
        col(content_type).alias("Content Type"),
        F.substring(text.strip_tags(F.coalesce(col(description), F.lit(""))), 1, 500).alias("Description"),
        col(feed_id).alias("FeedID"),
        col(link).alias("Link"),
        dates.utc_date(published).alias("PublishDate"),
        F.substring(F.coalesce(col(author), F.lit("")), 1, 99).alias("Author"),
    ]


def queue_record(items: DataFrame) -> DataFrame:
    """Flat content item as a queue record with a nested feed entry."""
    m = F.col("sourceMetadata")
    return items.select(
        m["feedId"].alias("id"),
        F.struct(F.col("title"), F.col("brief").alias("description"), m["originalUrl"].alias("link"),
                 dates.iso_utc(m["publishDate"]).alias("pubDate"), m["author"].alias("author"),
                 m["tags"].alias("tags")).alias("feed"))


def queued_to_content(queue: DataFrame, as_of: Column) -> DataFrame:
    """Queue record back to a content item; a missing date becomes the processing time."""
    return queue.select(
        F.col("id").alias("feed_id"), F.col("feed.title").alias("title"), F.col("feed.description").alias("brief"),
        F.col("feed.link").alias("original_url"),
        F.coalesce(dates.parse_feed_date("feed.pubDate"), as_of).alias("publish_date"),
        F.col("feed.author").alias("author"), F.coalesce("feed.tags", _no_strings()).alias("tags"),
        F.lit("BLOG").alias("content_type"))


def webhook_payload(raw: DataFrame, as_of: Column) -> DataFrame:
    """Delivery payload of a reading-list entry: type as a one-element array."""
    url = F.get("canonical", F.lit(0))["href"]
    return raw.select(
        "title",
        F.array(rules.content_type_of_url(url)).alias("contentType"),
        F.col("summary.content").alias("brief"),
        rules.headline_priority("title").alias("priority"),
        F.struct(F.col("id").alias("feedId"), url.alias("originalUrl"),
                 dates.iso_utc(F.timestamp_seconds(F.coalesce("published", F.lit(0)))).alias("publishDate"),
                 F.coalesce("author", F.lit("")).alias("author"), labels("categories").alias("tags"),
                 ).alias("sourceMetadata"))


def enhanced(content: DataFrame, body: str = "text", facts_n: Column | None = None, min_length: int = 100) -> DataFrame:
    """Accepted documents with summary, fact count and quality score."""
    facts = facts_n if facts_n is not None else F.lit(0)
    summary = text.short_summary(body)
    return (
        content.filter(F.length(body) >= min_length)
        .withColumn("summary", summary)
        .withColumn("has_summary", F.length("summary") > 0)
        .withColumn("fact_count", facts.cast("bigint"))
        .withColumn("quality_score", enhancement_score(F.length(body), F.col("has_summary"), F.col("fact_count")))
    )


def enhancement_score(length: Column, has_summary: Column, facts_n: Column) -> Column:
    return F.bround(0.3 * F.least(length / 1000, F.lit(1.0)) + 0.4 * has_summary.cast("double")
                    + 0.3 * F.least(facts_n / 5, F.lit(1.0)), 2)

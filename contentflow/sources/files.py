"""Landed files as DataFrames: reading-list pages, subscriptions, pushed items, stored
documents and the feed registry. Fetching over the network is a landing job outside."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.functions import checks
from contentflow.operators.ordering import top_per_key
from contentflow.operators.stateful import mark_path


def or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """What ``read()`` gives, or an empty frame where its path doesn't exist; any other fault is raised."""
    try:
        return read()
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """Declared-schema JSON; a missing path is an empty frame."""
    return or_empty(spark, lambda: spark.read.schema(schema).option("multiLine", multiline).json(path), schema)


def reading_list_pages(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Landed pages: a file each, or a line each (``multiline=False``), which lets a large file be split."""
    return read_json(spark, path, schemas.READING_LIST, multiline)


def chained_pages(pages: DataFrame, first_token: str = "") -> DataFrame:
    """Pages reached from the first one through their continuation tokens; the chain ends
    at a page without a token or without items."""
    p = pages.withColumn("page_token", F.coalesce("page_token", F.lit("")))
    links = p.filter(F.col("continuation").isNotNull() & (F.size("items") > 0)).select(
        F.lit(0).alias("k"), F.col("page_token").alias("node"), F.col("continuation").alias("nxt"))
    start = p.filter(F.col("page_token") == first_token).select(F.lit(0).alias("k"), F.col("page_token").alias("node"))
    reached = mark_path(start, links, ["k"], "node").select(F.col("node").alias("page_token"))
    return p.join(reached, "page_token", "left_semi")


def page_items(pages: DataFrame) -> DataFrame:
    """One row per item with ``errors``; a broken item never stops the page."""
    rows = pages.select("page_token", F.explode("items").alias("i")).select("page_token", "i.*")
    return rows.withColumn("errors", checks.errors(
        F.when(F.col("id").isNull() | F.col("title").isNull() | F.col("summary").isNull(), "Missing required fields"),
        F.when(F.coalesce(F.size("canonical"), F.lit(0)) < 1, "Invalid canonical URL format")))


def read_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good items, quarantined items) of all chained pages below ``path``."""
    return checks.split_valid(page_items(chained_pages(reading_list_pages(spark, path))))


def subscriptions(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Rows of ``subscriptions[]``; anything that is not such a document gives none."""
    raw = read_json(spark, path, schemas.SUBSCRIPTIONS, multiline)
    return raw.select(F.explode("subscriptions").alias("s")).select("s.*")


def pushed_items(raw: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Parsed pushed items with ``errors``; batch or stream, ``value`` is the JSON text,
    ``keep`` names further columns to carry along."""
    parsed = raw.withColumn("_p", F.from_json(F.col(value).cast("string"), schemas.PUSHED_ITEM))
    blank = F.col(value).isNull() | (F.length(F.trim(F.col(value).cast("string"))) == 0)
    broken = F.try_parse_json(F.col(value).cast("string")).isNull()
    return parsed.select(
        *(keep or []), F.coalesce("_p.id", F.lit("unknown")).alias("id"), "_p.title", "_p.content", "_p.url", "_p.priority", value,
        checks.errors(F.when(blank, "No data provided").when(broken, "Invalid JSON")).alias("errors"))


def document_named(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The stored JSON document of one name below ``root/name=<name>``; empty when missing."""
    return read_json(spark, f"{root}/name={name}", schema)


def documents_named(spark: SparkSession, root: str, names: DataFrame, schema: str) -> DataFrame:
    """The stored JSON documents (a line each) below ``root/name=<name>`` whose name is in ``names(name)``.

    A filtered ``names`` is known before the scan starts, so only its folders are listed and read (dynamic partition
    pruning). A name without a folder gives no rows, nor does a missing root; a null name is in no folder."""
    stored = read_json(spark, root, f"{schema}, name STRING", multiline=False)
    return stored.join(names.select("name"), "name", "left_semi")


def feed_registry(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(url, name, content_type, intervals, cap): one row per configured feed."""
    conf = read_json(spark, path, schemas.FEED_CONFIG, multiline)
    return conf.select(
        F.explode("feeds").alias("f"),
        F.coalesce("fetch_interval_seconds", F.lit(300)).alias("fetch_interval_seconds"),
        F.coalesce("max_items_per_fetch", F.lit(30)).alias("max_items_per_fetch"),
        F.coalesce("retry_interval_seconds", F.lit(60)).alias("retry_interval_seconds"),
    ).select("f.*", "fetch_interval_seconds", "max_items_per_fetch", "retry_interval_seconds")


def capped_per_feed(items: DataFrame, registry: DataFrame, ts: str, key: str) -> DataFrame:
    """Newest items of each configured feed, up to its cap."""
    top = registry.agg(F.max("max_items_per_fetch")).first()[0] or 0
    # the common upper cap lets Spark cut each task's rows before the shuffle
    ranked = top_per_key(items, ["feed"], [F.col(ts).desc(), F.col(key).desc()], int(top), out="_pos")
    caps = registry.select(F.col("url").alias("feed"), "max_items_per_fetch")
    return ranked.join(caps, "feed").filter(F.col("_pos") <= F.col("max_items_per_fetch")).drop("_pos", "max_items_per_fetch")

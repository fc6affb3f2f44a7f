"""Stored-table semantics: insert-if-new, upsert, tag bridge, listing, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentflow.operators.ordering import numbered


def first_per_key(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key by an aggregate (combined before the shuffle, so a hot
    key sends one row per task); rows with a null key are all kept."""
    cols = [c for c in batch.columns if c != key]
    rank = F.struct(*order)
    firsts = (batch.filter(F.col(key).isNotNull()).groupBy(key)
              .agg(F.min_by(F.struct(*cols), rank).alias("_row")).select(key, "_row.*"))
    return firsts.select(*batch.columns).unionByName(batch.filter(F.col(key).isNull()))


def insert_if_new(batch: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows a unique-key store would accept: first per key, not stored yet."""
    return first_per_key(batch, key, order).join(
        stored.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def latest_per_key(df: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """Upsert: the row with the highest sequence wins for every key."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), seq).alias("_row")).select(*keys, "_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, F.struct("_new", *seq)).drop("_new")


def maintain_tags(feed_tags: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tag dimension, bridge): unseen names get ids after the known ones; pairs are unique.

    ``feed_tags(feed_id, name)``, ``known(tag_id, name)``. Ids follow name order."""
    fresh = feed_tags.select("name").distinct().join(known.select("name"), "name", "left_anti")
    top = known.agg(F.coalesce(F.max("tag_id"), F.lit(0))).scalar()
    added = numbered(fresh, ["name"], out="_n").select((top + F.col("_n")).alias("tag_id"), "name")
    tags = known.select("tag_id", "name").unionByName(added)
    bridge = feed_tags.distinct().join(tags, "name").select("feed_id", "tag_id")
    return tags, bridge


def listing(feeds: DataFrame, feed_tags: DataFrame, tags: DataFrame, limit: int | None = None,
            offset: int = 0) -> DataFrame:
    """Feeds with their tag names, newest first.

    The page of feeds is cut before the joins, so only its rows meet the bridge."""
    page = feeds.orderBy(F.col("pub_date").desc(), "id")
    if offset:
        page = page.offset(offset)
    if limit is not None:
        page = page.limit(limit)
    names = (page.select("id").join(feed_tags, page["id"] == feed_tags["feed_id"])
             .join(tags, "tag_id").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("tags")))
    return page.join(names, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def by_status(items: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    rows = items.filter(F.col("processed_status") == status)
    return rows.orderBy("id").limit(limit) if limit is not None else rows


def keep_recent(df: DataFrame, ts: str, as_of: Column, days: int = 30) -> DataFrame:
    """Retention: rows not older than ``days`` days. A date-partitioned table drops whole folders."""
    return df.filter(F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def oldest_per_feed(items: DataFrame, feed: str, n: int, ts: str, key: str, cap: int = 50) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(feed).orderBy(ts, key))
    return items.withColumn("place", place).filter(F.col("place") <= min(n, cap))

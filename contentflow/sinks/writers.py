"""Writers and message forms of the stored and outgoing data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.functions import rules
from contentflow.vocab import IDEA_AREAS, NOTICE_COLOURS


def append_errors(errors: DataFrame, path: str, ts: str = "ts") -> None:
    """Append-only log, one folder per day."""
    errors.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path)


def idea_manifest(ideas: DataFrame, idea: str = "idea_id") -> DataFrame:
    """(idea, area, path): the sub-areas kept for every idea."""
    return ideas.select(idea, F.explode(F.array(*[F.lit(a) for a in IDEA_AREAS])).alias("area")).withColumn(
        "path", F.concat_ws("/", idea, "area"))


def idea_metadata(ideas: DataFrame, as_of: Column) -> DataFrame:
    return ideas.select("idea_id", F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.lit("New").alias("status"),
                        "content_type", "priority", F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"))


def write_idea_metadata(ideas: DataFrame, as_of: Column, path: str) -> None:
    """Metadata by idea. Ideas are hashed into folders, so their number is not bound by folders."""
    meta = idea_metadata(ideas, as_of).withColumn("bucket", F.pmod(F.xxhash64("idea_id"), F.lit(256)))
    meta.repartition("bucket").write.mode("append").partitionBy("bucket").json(path)


def alert_messages(events: DataFrame) -> DataFrame:
    """Adds ``message``: text, colour and metadata fields of (level, title, message, metadata, ts)."""
    fields = F.transform(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda e: F.struct(
        e["key"].alias("title"), e["value"].alias("value"), F.lit(True).alias("short")))
    body = F.struct(
        F.concat(F.lit("*"), "title", F.lit("*\n"), "message").alias("text"),
        F.array(F.struct(rules.mapped("level", NOTICE_COLOURS, "#000000").alias("color"), fields.alias("fields"),
                         F.unix_seconds("ts").alias("ts"))).alias("attachments"))
    return events.withColumn("payload", F.to_json(body))

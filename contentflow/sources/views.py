"""Logical feed views over the supplied tables.

The queries read items, content, delivery attempts and metric samples; none of
these exists as a file, so each is a projection of one supplied table. All of
them are narrow (no shuffle), so filters and column pruning reach the scan.
``*_SQL`` holds the same projection for the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentflow.session import use_utc

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed dimension as a local relation; its size is that of the literal list."""
    names, kinds = zip(*[c.strip().split(" ") for c in schema.split(",")])
    structs = [F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(r, names, kinds)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


class Tables:
    """Lazily opened tables of one scale-factor folder plus the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        use_utc(spark)
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def read_text(self, name: str) -> DataFrame:
        """A text table as the scan gives it. Where ``spark.contentflow.text.partitions`` is set, its rows are dealt over so
        many tasks first: a setting for single machines with small files of one row group, not for clusters."""
        df = self.read(name)
        spread = self.spark.conf.get("spark.contentflow.text.partitions", None)
        return df.repartition(int(spread)) if spread else df

    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def items(self) -> DataFrame:
        """Feed items: one per event; several items share a URL and a payload."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        kind = F.col("event_type")
        return self.events().select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("feed/"), F.col("user_id").cast("string")).alias("feed"),
            F.col("ts").alias("published"),
            kind.alias("category"),
            F.concat(kind, F.lit(" report "), k.cast("string")).alias("title"),
            F.when(kind == "view", F.concat(F.lit("https://www.youtube.com/watch?v="), k.cast("string")))
            .when(kind == "click", F.concat(F.lit("https://twitter.com/user/status/"), k.cast("string")))
            .when(kind == "signup", F.concat(F.lit("https://example.com/blog/"), k.cast("string")))
            .when(kind == "purchase", F.concat(F.lit("http://localhost:8080/shop?id="), k.cast("string")))
            .otherwise(F.concat(F.lit("not a link "), k.cast("string"))).alias("url"),
            F.col("props").alias("payload"),
            k.alias("k"),
            F.col("value"),
            F.floor(F.col("value") * 100).alias("likes"),
            F.floor(F.col("value") * 20).alias("shares"),
            F.floor(F.col("value") * 5).alias("comments"),
            F.when(kind == "error", 2).when(kind.isin("purchase", "signup"), 1).otherwise(0).alias("rank"),
        )

    def documents(self) -> DataFrame:
        return self.read_text("documents")

    def content(self) -> DataFrame:
        """Documents as stored feed entries; the title is the first sentence."""
        return self.documents().select(
            "doc_id",
            F.concat(F.lit("item-"), F.col("doc_id").cast("string")).alias("item_key"),
            F.col("source").alias("feed"),
            "lang",
            "text",
            F.regexp_extract("text", r"^([^.!?\n]*)", 1).alias("title"),
        )

    def pages(self) -> DataFrame:
        return self.read_text("pages")

    def chat(self) -> DataFrame:
        """Small groups of related texts: one group per conversation."""
        return self.read_text("conversations").select(
            F.col("conv_id").alias("group_id"), F.col("turn").alias("pos"), "role", "text"
        )

    def attempts(self) -> DataFrame:
        """Delivery attempts: one per event, five services, errors are failures."""
        return self.events().select(
            F.col("event_id").alias("attempt_id"),
            F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("service"),
            F.col("user_id").alias("item_id"),
            "ts",
            (F.col("event_type") != "error").alias("ok"),
            (F.col("value") / 10).alias("seconds"),
            F.when(F.col("event_type") != "error", 200)
            .when(F.get_json_object("props", "$.k").cast("int") < 30, 429)
            .when(F.get_json_object("props", "$.k").cast("int") < 60, 404)
            .otherwise(503).alias("status_code"),
        )

    def samples(self) -> DataFrame:
        """Metric samples: processing seconds labelled by status."""
        return self.events().select(
            F.col("event_id").alias("sample_id"), "ts", F.col("event_type").alias("status"),
            (F.col("value") / 10).alias("value"),
        )

    def errors(self) -> DataFrame:
        """Error log: failed events with a category, severity and message."""
        k = F.get_json_object("props", "$.k").cast("int")
        return (
            self.events()
            .filter(F.col("event_type") == "error")
            .select(
                F.col("event_id").alias("error_no"),
                "ts",
                F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("service"),
                F.when(k < 25, "api_error").when(k < 50, "processing_error").when(k < 75, "delivery_error")
                .otherwise("rate_limit_error").alias("category"),
                F.when(F.col("value") < 5, "low").when(F.col("value") < 20, "medium")
                .when(F.col("value") < 50, "high").otherwise("critical").alias("severity"),
                F.concat(F.lit("call failed token=abc-"), k.cast("string"), F.lit(" password=p"),
                         k.cast("string"), F.lit(" key="), F.col("user_id").cast("string")).alias("message"),
            )
        )


ITEMS_SQL = """
items AS (
  SELECT id, feed, published, category,
         category || ' report ' || k AS title,
         CASE category WHEN 'view' THEN 'https://www.youtube.com/watch?v=' || k
              WHEN 'click' THEN 'https://twitter.com/user/status/' || k
              WHEN 'signup' THEN 'https://example.com/blog/' || k
              WHEN 'purchase' THEN 'http://localhost:8080/shop?id=' || k
              ELSE 'not a link ' || k END AS url,
         payload, k, value,
         CAST(floor(value*100) AS BIGINT) AS likes, CAST(floor(value*20) AS BIGINT) AS shares,
         CAST(floor(value*5) AS BIGINT) AS comments,
         CASE WHEN category='error' THEN 2 WHEN category IN ('purchase','signup') THEN 1 ELSE 0 END AS rank
  FROM (SELECT event_id AS id, 'feed/' || user_id AS feed, ts AS published, event_type AS category,
               props AS payload, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, value FROM events)
)"""

CONTENT_SQL = """
content AS (
  SELECT doc_id, 'item-' || doc_id AS item_key, source AS feed, lang, text,
         regexp_extract(text, '^([^.!?\\n]*)', 1) AS title
  FROM documents
)"""

CHAT_SQL = "chat AS (SELECT conv_id AS group_id, turn AS pos, role, text FROM conversations)"

ATTEMPTS_SQL = """
attempts AS (
  SELECT event_id AS attempt_id, 'svc' || (user_id % 5) AS service, user_id AS item_id, ts,
         event_type <> 'error' AS ok, value/10 AS seconds,
         CASE WHEN event_type <> 'error' THEN 200
              WHEN CAST(json_extract_string(props,'$.k') AS INT) < 30 THEN 429
              WHEN CAST(json_extract_string(props,'$.k') AS INT) < 60 THEN 404 ELSE 503 END AS status_code
  FROM events
)"""

SAMPLES_SQL = """
samples AS (SELECT event_id AS sample_id, ts, event_type AS status, value/10 AS value FROM events)"""

ERRORS_SQL = """
errors AS (
  SELECT event_id AS error_no, ts, 'svc' || (user_id % 5) AS service,
         CASE WHEN k < 25 THEN 'api_error' WHEN k < 50 THEN 'processing_error'
              WHEN k < 75 THEN 'delivery_error' ELSE 'rate_limit_error' END AS category,
         CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'medium'
              WHEN value < 50 THEN 'high' ELSE 'critical' END AS severity,
         'call failed token=abc-' || k || ' password=p' || k || ' key=' || user_id AS message
  FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events WHERE event_type='error')
)"""

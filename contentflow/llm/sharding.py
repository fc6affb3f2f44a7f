"""Shards of near equal bytes by sampled splitters.

Records have a place (key, uid) in one order. A sample whose chances follow the record sizes gives the quantile
boundaries that cut the order into many fine ranges; ranges that turn out overfull are sampled again and
subdivided, down to single records, so a hot key is cut as well. Exact range totals then give every record its
number of bytes and rows before it, and a shard is a run of this order. The sample decides only how evenly the
work is spread, never the result's law.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentflow.llm.common import read, run_folder, save

RANGE_ROWS = 1_000_000  # rows of a fine range, about
DRAWS = 20  # sampled records for each range; the driver holds DRAWS x ranges keys
KEEP_TOGETHER = 0.01  # a group of equal keys is not cut up to this share of a shard's bytes
SAMPLE_SEED = 7


class Bounds:
    """Ordered (key, uid) boundaries; a record's range is the number of boundaries at or before it."""

    def __init__(self, places: list[tuple[int, int]]):
        places = sorted(set(places))
        self.keys = np.array([k for k, _ in places], np.int64)
        self.uids = np.array([u for _, u in places], np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def places(self) -> list[tuple[int, int]]:
        return list(zip(self.keys.tolist(), self.uids.tolist()))

    def of(self, keys: np.ndarray, uids: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = low.copy()
        for a in np.unique(low[low < high]):  # keys that have boundaries inside
            rows = np.flatnonzero((low == a) & (low < high))
            inside = self.uids[a: high[rows[0]]]
            out[rows] = a + np.searchsorted(inside, uids[rows], "right")
        return out

    def column(self, key: str, uid: str):
        @F.pandas_udf("int")
        def range_of(k: pd.Series, u: pd.Series) -> pd.Series:
            return pd.Series(self.of(k.to_numpy(np.int64), u.to_numpy(np.int64)).astype(np.int32))

        return range_of(F.col(key), F.col(uid))


def _quantiles(sample: list, pieces: int) -> list[tuple[int, int]]:
    """The places that cut a weighted sample into ``pieces`` parts of about equal weight."""
    rows = sorted((r["key"], r["uid"], r["w"]) for r in sample)
    if not rows or pieces < 2:
        return []
    reached = np.cumsum([w for _, _, w in rows])
    at = np.searchsorted(reached, reached[-1] * np.arange(1, pieces) / pieces)
    return [rows[i][:2] for i in at.tolist()]


def splitters(records: DataFrame, ranges: int, rounds: int = 6) -> tuple[Bounds, list[tuple[int, int, int]]]:
    """Boundaries for about ``ranges`` ranges of ``records`` (key, uid, size; places unique, read several times)
    and, for each range that has records, (range, bytes, rows) in order.

    No range has over twice the mean bytes, but for single records that are larger, unless the rounds run out."""
    total = records.agg(F.sum("size").alias("b")).first()["b"] or 0
    if not total:
        return Bounds([]), []
    target = total / ranges

    def draw(df: DataFrame, size: float, pieces: int, seed: int) -> list:
        step = size / (DRAWS * pieces)  # bytes that one sampled record stands for
        return (df.filter(F.rand(seed) * step < F.col("size"))
                .select("key", "uid", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("w")).collect())

    bounds = Bounds(_quantiles(draw(records, total, ranges, SAMPLE_SEED), ranges))
    for k in range(rounds + 1):
        cut = records.withColumn("range", bounds.column("key", "uid"))
        sizes = [tuple(r) for r in cut.groupBy("range").agg(F.sum("size"), F.count(F.lit(1))).collect()]
        over = {r: b for r, b, n in sizes if b > 2 * target and n > 1}
        if not over or k == rounds:
            return bounds, sorted(sizes)
        spark = records.sparkSession
        names = spark.createDataFrame([(r,) for r in sorted(over)], "range int")
        pieces = -(-int(sum(over.values())) // int(target)) + len(over)
        sample = draw(cut.join(F.broadcast(names), "range"), sum(over.values()), pieces, SAMPLE_SEED + k + 1)
        bounds = Bounds(bounds.places() + _quantiles(sample, pieces) + [(r["key"], r["uid"]) for r in sample[:1]])


def with_prefix(records: DataFrame, bounds: Bounds, sizes: list[tuple[int, int, int]]) -> DataFrame:
    """Adds the bytes (``before``) and rows (``rank``) that come before each record; one shuffle by fine range."""
    starts, b, n = [], 0, 0
    for r, bytes_, rows in sizes:
        starts.append((r, b, n))
        b, n = b + bytes_, n + rows
    base = F.broadcast(records.sparkSession.createDataFrame(starts, "range int, base_bytes bigint, base_rows bigint"))
    inside = Window.partitionBy("range").orderBy("key", "uid")
    run = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (records.withColumn("range", bounds.column("key", "uid")).withColumn("before", run)
            .withColumn("rank", F.row_number().over(inside) - 1).join(base, "range")
            .withColumn("before", F.col("before") + F.col("base_bytes")).withColumn("rank", F.col("rank") + F.col("base_rows"))
            .drop("base_bytes", "base_rows"))


def _cut_places(placed: DataFrame, total: int, shards: int, keep_together: float) -> list[int]:
    """Bytes at which the shards begin: shares of the total, moved to the nearest edge of the group or record there."""
    wanted = [total * j // shards for j in range(1, shards)]
    if not wanted or not total:
        return []
    hit = F.pandas_udf(lambda a, s: pd.Series(np.searchsorted(wanted, a, "right") < np.searchsorted(wanted, a + s, "left")), "boolean")
    found = placed.filter(hit("before", "size")).select("key", "before", "size").collect()  # fewer than shards rows
    keys = sorted({r["key"] for r in found})
    names = placed.sparkSession.createDataFrame([(k,) for k in keys], "key bigint")
    spans = {r["key"]: (r["a"], r["b"]) for r in placed.join(F.broadcast(names), "key").groupBy("key").agg(
        F.min("before").alias("a"), F.max(F.col("before") + F.col("size")).alias("b")).collect()}
    cuts = []
    for w in wanted:
        inside = [r for r in found if r["before"] < w < r["before"] + r["size"]]
        around = [(a, b) for a, b in spans.values() if a < w < b]
        a, b = w, w
        if around and around[0][1] - around[0][0] <= keep_together * total / shards:
            a, b = around[0]
        elif inside:
            a, b = inside[0]["before"], inside[0]["before"] + inside[0]["size"]
        cuts.append(a if w - a <= b - w else b)
    return cuts


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
          keep_together: float = KEEP_TOGETHER) -> DataFrame:
    """One row for each document: id, uid, size, text_crc32, shard, slot.

    The order is that of a hash of the text, so equal texts are neighbours and stay in one shard unless their
    bytes exceed ``keep_together`` of a shard; then the group is cut between records. Shard sizes differ by less
    than two such groups, or two of the largest records.

    size is the UTF-8 bytes of the text plus 1; a null text has size 1 and the crc32 of no bytes. Ids may be null
    or repeat, rows stay apart. With fewer bytes than shards some shards are empty; an empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = save(docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("uid"),
        F.xxhash64(text).alias("key"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")), "shard-records")
    spark = docs.sparkSession
    rows = records.count()
    ranges = max(4 * shards, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    bounds, sizes = splitters(records, ranges)
    placed = save(with_prefix(records, bounds, sizes), "shard-places")
    cuts = _cut_places(placed, sum(b for _, b, _ in sizes), shards, keep_together)
    number = F.pandas_udf(lambda before: pd.Series(np.searchsorted(cuts, before, "right").astype(np.int32)), "int")
    numbered = placed.withColumn("shard", number("before"))
    first = F.broadcast(numbered.groupBy("shard").agg(F.min("rank").alias("first")))  # one row a shard
    return numbered.join(first, "shard").select("id", "uid", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, shards: int = 16, text_col: str = "text") -> str:
    """Writes the documents as a table with one folder ``_shard=n`` for each shard and returns its path. Rows
    travel by (shard, block of slots), so a shard is written by many tasks."""
    spark, names = docs.sparkSession, [f"c{i}" for i in range(len(docs.columns))]
    mine = save(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "shard-input")
    place = shard(mine, shards, "row", names[docs.columns.index(text_col)])
    placed = mine.join(place.select(F.col("id").alias("row"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")), "row")
    out = placed.repartition("_shard", F.floor(F.col("_slot") / RANGE_ROWS)).sortWithinPartitions("_shard", "_slot")
    path = run_folder(spark, "shards")
    out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], "_shard", "_slot").write.partitionBy("_shard").parquet(path)
    return path


def op7(spark, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

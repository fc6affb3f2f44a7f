"""Exact duplicates by a minimal perfect hash over the digests that are already known.

History is a set of distinct digests, each with the locator of its winner. It is cut into shards by the
digest; a shard holds a minimal perfect hash (levels of collision-free bits, the slot is the rank of the bit),
and each slot holds the full digest and the winner's locator. A digest is looked up in its shard and counts as
known only if all 32 bytes of the slot are equal, as any other digest may also land in a slot. What isn't known
forms groups of its own. A row of a known digest gets its winner from the slot and nowhere else.

Rows are combined to one per digest before they are sent to the shards, so copies never meet in one task; the
way back to the rows broadcasts the few hot digests. Shards grow in number with the history, not in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.llm.common import ROW_KEY, join_by_count, mix, read, save

SHARD_DIGESTS = 100_000
BITS_PER_KEY = 2
DIGEST = 32

ROWS = "id bigint, uid bigint, digest binary"
INDEX = "shard int, sizes array<int>, bits binary, digests binary, ids binary, known binary, uids binary"
FOUND = "digest binary, n bigint, member boolean, id bigint, uid bigint"


def normalised(text):
    """Runs of space, tab, line feed, vertical tab, form feed and carriage return become one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, uid, digest) for each document, written once: uid names the row even if ids repeat."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("uid"),
                       F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))
    return save(rows, "digests")


def one_per_digest(rows: DataFrame) -> DataFrame:
    """Winner (smallest id, nulls last, then smallest uid) and number of rows of each digest."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    return rows.groupBy("digest").agg(F.min(place).alias("w"), F.count(F.lit(1)).alias("n")).select(
        "digest", "n", F.col("w.id").alias("id"), F.col("w.uid").alias("uid"))


def to_look_up(rows: DataFrame, later: Column) -> DataFrame:
    """(digest, n, id, uid): all rows of each digest are counted, but the winner is sought among the later rows only and
    counts only if history doesn't know the digest; uid is -1 where no later row has it."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    return rows.groupBy("digest").agg(F.min(F.when(later, place)).alias("w"), F.count(F.lit(1)).alias("n")).select(
        "digest", "n", F.col("w.id").alias("id"), F.coalesce("w.uid", F.lit(-1).cast("bigint")).alias("uid"))


# ---- minimal perfect hash ------------------------------------------------------------------


def _words(digests: bytes) -> np.ndarray:
    w = np.frombuffer(digests, np.uint64).reshape(-1, DIGEST // 8)
    return mix(w[:, 0] ^ mix(w[:, 1] ^ mix(w[:, 2] ^ mix(w[:, 3]))))


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(words + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)


def build_hash(digests: bytes) -> tuple[list[int], np.ndarray]:
    """Sizes and bits of the levels for distinct digests laid end to end. On each level a digest that has a bit
    for itself is done; those that collide go on to the next level."""
    left, sizes, bits = _words(digests), [], []
    while len(left):
        size = BITS_PER_KEY * len(left) + 1
        at = _place(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(digests: bytes, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each digest: 0 to n - 1, each once for the digests of the build; any slot or -1 for others."""
    words, rank, base = _words(digests), np.cumsum(bits) - 1, 0
    out = np.full(len(words), -1, np.int64)
    open_ = np.arange(len(words))
    for level, size in enumerate(sizes):
        at = base + _place(words[open_], level, size)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_ = open_[~hit]
        base += size
    return out


def _end_to_end(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _build_shard(table: pa.Table) -> pa.Table:
    digests = _end_to_end(table["digest"])
    sizes, bits = build_hash(digests)
    order = np.argsort(slots(digests, sizes, bits))
    keys = np.frombuffer(digests, np.uint8).reshape(-1, DIGEST)[order]
    ids = np.array([x if x is not None else 0 for x in table["id"].to_pylist()], np.int64)[order]
    known = np.array([x is not None for x in table["id"].to_pylist()], np.uint8)[order]
    uids = table["uid"].to_numpy()[order]
    return pa.table({
        "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())),
        "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "digests": pa.array([keys.tobytes()], pa.binary()),
        "ids": pa.array([ids.tobytes()], pa.binary()), "known": pa.array([known.tobytes()], pa.binary()),
        "uids": pa.array([uids.tobytes()], pa.binary())})


def _look_up(asked: pa.Table, index: pa.Table) -> pa.Table:
    if not asked.num_rows:
        return pa.table({"digest": pa.array([], pa.binary()), "n": pa.array([], pa.int64()), "member": pa.array([], pa.bool_()),
                         "id": pa.array([], pa.int64()), "uid": pa.array([], pa.int64())})
    digests = _end_to_end(asked["digest"])
    ids, uids = asked["id"].to_pylist(), asked["uid"].to_numpy().copy()
    member = np.zeros(asked.num_rows, bool)
    if index.num_rows:
        row = {c: index[c][0].as_py() for c in index.column_names}
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
        slot = slots(digests, row["sizes"], bits)
        keys = np.frombuffer(row["digests"], np.uint8).reshape(-1, DIGEST)
        mine = np.frombuffer(digests, np.uint8).reshape(-1, DIGEST)
        member = (slot >= 0) & (keys[slot] == mine).all(axis=1)
        win, known, at = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8), slot[member]
        uids[member] = np.frombuffer(row["uids"], np.int64)[at]
        for i, w, k in zip(np.flatnonzero(member).tolist(), win[at].tolist(), known[at].tolist()):
            ids[i] = w if k else None
    return pa.table({"digest": asked["digest"].cast(pa.binary()), "n": asked["n"].cast(pa.int64()), "member": pa.array(member),
                     "id": pa.array(ids, pa.int64()), "uid": pa.array(uids, pa.int64())})


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """Index of distinct digests with winners (digest, id, uid), one row for each shard, written once."""
    cut = history.select(F.pmod(F.crc32("digest"), F.lit(shards)).cast("int").alias("shard"), "digest", "id", "uid")
    return save(cut.groupBy("shard").applyInArrow(_build_shard, INDEX), "digest-index")


def look_up(groups: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Groups (digest, n, id, uid) with the winner that history names; others keep their own."""
    cut = groups.withColumn("shard", F.pmod(F.crc32("digest"), F.lit(shards)).cast("int"))
    return cut.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_look_up, FOUND)


# ---- operator ------------------------------------------------------------------------------


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document, in the order of arrival that the ids give.

    The lower half of the ids is the history; its distinct digests are indexed with their winners, and the digests of
    all rows are looked up. Members of the index take the winner of their slot; of nonmembers the first later row stays.
    Columns: id, uid, digest, keep_id, keep_uid, group_size, member (its winner came from the index).

    Null text counts as empty, empty texts are one group. A null id comes after all others. Rows that repeat an
    id and a text are ties: one of them stays. An empty table gives no rows. Other columns are not read."""
    rows = digest_rows(docs, id_col, text_col)
    seen = rows.agg(F.percentile_approx("id", 0.5).alias("half"), F.count(F.lit(1)).alias("n")).first()
    early = F.coalesce(F.col("id") <= F.lit(seen["half"]).cast("bigint"), F.lit(False))
    history = one_per_digest(rows.filter(early))
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["n"] // SHARD_DIGESTS))
    index = build_index(history, shards)
    groups = save(look_up(to_look_up(rows, ~early), index, shards), "digest-groups").select(
        "digest", "member", F.col("n").alias("group_size"), F.col("id").alias("keep_id"), F.col("uid").alias("keep_uid"))
    return join_by_count(rows, groups, "digest", "group_size", seen["n"])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat an earlier text; all columns kept."""
    kept = dedup(docs, id_col, text_col).filter(F.col("uid") == F.col("keep_uid")).select("id", "digest")
    return _first_rows(docs, kept, id_col, text_col)


def _first_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each kept (id, digest); one shuffle of the documents."""
    key = lambda i, d: F.concat(F.hex(d), F.coalesce(i.cast("string"), F.lit("null")))
    mine = docs.withColumn(ROW_KEY, key(F.col(id_col).cast("bigint"), F.unhex(F.sha2(normalised(F.col(text_col)), 256))))
    names = kept.select(key(F.col("id"), F.col("digest")).alias(ROW_KEY))
    return mine.join(names, ROW_KEY).dropDuplicates([ROW_KEY]).select(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
                      (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""

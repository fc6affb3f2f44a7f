"""Importance resampling of documents towards a target corpus, on hashed word n-grams.

The features of a text are its words and its pairs of consecutive words; a feature's bucket is its CRC-32 modulo the
number of buckets. In each piece of text the distinct features are found by word numbers, their bytes are grouped by
equal length into two-dimensional arrays whose CRCs are updated column by column (``crc_columns``), and the buckets are
scattered back to all places. Bucket counts of both corpora give each bucket a gain, the floored mean of its gains
weighs a document, and Gumbel noise fixed by the id turns the highest scores into a draw without replacement.

Texts are read once: the buckets of each document are written to the shared folder (two bytes a feature), counted, and
read again for the weights. A task holds a piece of text or one text, at about twelve bytes for each byte of it, and in
words slices of ``SLICE_WORDS``. Null and empty texts have no features and weight 0. Repeated rows and ids each count and
are drawn on their own; equal ids have equal noise. A null id draws with the word null and comes after all others
among equal scores; remaining ties go by text, and rows equal in both are interchangeable. Empty tables give an empty result, an
empty target gives gains by the corpus alone. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.llm.common import give_back, pieces, read, save, text_bytes, word_spans
from contentflow.llm.crc_columns import crc32
from contentflow.llm.spans import distinct_spans, gather
from contentflow.operators.ordering import numbered

BUCKETS = 10_000
SHARE = 25  # percent of the long enough documents that are drawn
LEAST_WORDS = 20
SEED = 7
SLICE_WORDS = 200_000
COARSE = 256  # scores of one step of the threshold search

FEATURES = "id bigint, uid bigint, n_words bigint, n_features bigint, buckets binary"


# ---- features ------------------------------------------------------------------------------


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def feature_buckets(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, pair: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every word (first column) and of every word with its next one (second column, where ``pair``)."""
    out = np.zeros((len(starts), 2), _kind(buckets))
    spaced = np.append(low, np.uint8(0x20))
    for a in range(0, len(starts), SLICE_WORDS):
        b = min(a + SLICE_WORDS, len(starts))
        z = min(b + 1, len(starts))  # the word after the slice, for the last pair
        of, index = distinct_spans(low, starts[a:z], ends[a:z])
        at, size = starts[a:z][of], (ends - starts)[a:z][of]
        left = np.flatnonzero(pair[a:b])
        codes, back = np.unique(index[left] * len(of) + index[left + 1], return_inverse=True)
        first, second = np.divmod(codes, max(1, len(of)))
        froms = np.stack([at[first], np.full(len(codes), len(low)), at[second]], 1).ravel()
        sizes = np.stack([size[first], np.ones(len(codes), np.int64), size[second]], 1).ravel()
        flat = np.concatenate([gather(low, at, size), gather(spaced, froms, sizes)])
        found = crc32(flat, np.concatenate([size, size[first] + 1 + size[second]])) % np.uint32(buckets)
        out[a:b, 0] = found[: len(of)][index[: b - a]]
        out[a + left, 1] = found[len(of):][back]
    return out


def features(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """One row (id, uid, n_words, n_features, buckets) for each document; ``uid`` tells texts apart."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(text).alias("uid"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            low, starts, ends, before = word_spans(*text_bytes(batch.column("text")))
            n_words = np.diff(before)
            pair = np.ones(len(starts), bool)
            pair[before[1:][n_words > 0] - 1] = False
            there = np.stack([np.ones(len(starts), bool), pair], 1)
            found = feature_buckets(low, starts, ends, pair, buckets)[there]
            n = n_words + np.maximum(n_words - 1, 0)
            stops = np.cumsum(n)
            lists = [found[x:y].tobytes() for x, y in zip((stops - n).tolist(), stops.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("uid"), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(lists, pa.binary())],
                names=["id", "uid", "n_words", "n_features", "buckets"])

    return rows.mapInArrow(run, FEATURES)


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of all features; a task sends at most one row for each bucket."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column("buckets").to_pylist():
                total += np.bincount(np.frombuffer(raw, kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket, in thousandths: the logarithm of its smoothed share of the target over that of the corpus."""
    counts = (bucket_counts(corpus, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t"))
              .unionByName(bucket_counts(target, buckets).select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
              .groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").select(
        "bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    rows = sorted((r["bucket"], r["s"], r["t"]) for r in every.collect())  # one row for each bucket
    corpus_all, target_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
    listed = np.array([r[1:] for r in rows])
    ratio = (listed[:, 1] + 1) * (corpus_all + buckets) / ((listed[:, 0] + 1) * (target_all + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


# ---- weights and draw ----------------------------------------------------------------------


def _weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    kind = _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_features").to_numpy()
            sums = np.array([gain[np.frombuffer(raw, kind)].sum() for raw in batch.column("buckets").to_pylist()], np.int64)
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            kept = ["id", "uid", "n_words", "n_features"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(weight, pa.int64())], names=[*kept, "weight"])
        give_back()

    return found.mapInArrow(run, "id bigint, uid bigint, n_words bigint, n_features bigint, weight bigint")


def _noise(seed: int):
    """Gumbel noise in thousandths, by the id."""
    word = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(word, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def _threshold(scores: DataFrame, drawn: int) -> int:
    """The score of the last drawn row: first its step of ``COARSE`` scores, then the score itself. The driver sees
    counts of steps; scores span some hundred of them, as gains and noise are logarithms."""
    step = F.floor(F.col("score") / COARSE).cast("bigint")
    left, low = drawn, None
    for rows in (scores.groupBy(step.alias("at")), None):
        if rows is None:
            rows = scores.filter(step == low).groupBy(F.col("score").alias("at"))
        for at, n in sorted(((r["at"], r["count"]) for r in rows.count().collect()), reverse=True):
            if n >= left:
                low = at
                break
            left -= n
    return low


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS,
          share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row (id, uid, n_words, n_features, weight, score, rank) for each document of ``docs``; ``rank`` is null for those
    not among the ``share`` percent drawn from the documents of at least ``least_words`` words."""
    found = save(features(docs, id_col, text_col, buckets), "resample-features")
    wanted = features(target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text")), "id", "text", buckets)
    scored = _weighted(found, gains(found, wanted, buckets)).withColumn("score", F.col("weight") + _noise(seed))
    scored = save(scored.withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    long_enough = scored.filter(F.col("n_words") >= least_words)
    drawn = long_enough.count() * share // 100
    plain = ["id", "uid", "n_words", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("bigint").alias("rank")
    if not drawn:
        return scored.select(*plain, no_rank)
    near = (F.col("n_words") >= least_words) & (F.col("score") >= _threshold(long_enough, drawn))
    order = scored.filter(near).withColumn("_down", -F.col("score")).withColumn("_last", F.col("id").isNull()).withColumn("_id", F.coalesce("id", F.lit(0)))
    ranked = numbered(order, ["_down", "_last", "_id", "uid", "row"], out="rank")
    return scored.filter(~near).select(*plain, no_rank).unionByName(
        ranked.select(*plain, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kinds) -> DataFrame:
    """The drawn documents with all their columns and ``rank`` (in place of a column of that name). Of rows with equal id and
    text, which differ in other columns only, each drawn one shows the columns of one of them."""
    drawn = score(docs, target, id_col, text_col, **kinds).filter("rank is not null").select(F.col("id").alias("_id"), F.col("uid").alias("_uid"), F.col("rank").alias("_rank"))
    kept = [c for c in docs.columns if c != "rank"]
    keyed = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_uid"))
    return (keyed.dropDuplicates(["_id", "_uid"]).alias("d").join(drawn.alias("r"), F.expr("d._id <=> r._id and d._uid = r._uid"))
            .select(*[F.col(f"d.`{c}`") for c in kept], F.col("_rank").alias("rank")))


def op11(spark, sf_dir: str) -> DataFrame:
    found = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: Registers of the 256 byte values, and the CRC-32 of a hex string ``h``, for SQL without such a function.
SQL_TABLE = """select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) as t
from range(256) r(i)"""
SQL_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: cast('0x' || substr(h, i, 2) as bigint))),
lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""

OP11_SQL = rf"""
with crc as ({SQL_TABLE}),
d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (select coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark),
df as (select doc_id, len(w) as n_words, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from d),
bf as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from b),
names as (select f, hex(encode(f)) as h from (select f from df union select f from bf)),
bucket as (select f, {SQL_CRC} % 10000 as k from names, crc),
s as (select k, count(*) as n from df join bucket using (f) group by 1),
t as (select k, count(*) as n from bf join bucket using (f) group by 1),
totals as (select (select coalesce(sum(n), 0) from s) as s_all, (select coalesce(sum(n), 0) from t) as t_all),
gain as (select k, cast(floor(1000 * ln(cast((coalesce(t.n, 0) + 1) * (s_all + 10000) as double) / cast((s.n + 1) * (t_all + 10000) as double))) as bigint) as g
         from s left join t using (k), totals),
weights as (select doc_id, n_words, count(*) as n_features, cast(floor(cast(sum(g) as double) / count(*)) as bigint) as weight from df join bucket using (f) join gain using (k) group by 1, 2),
every as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
          cast('0x' || substr(sha256('7:' || doc_id), 1, 8) as bigint) as h from d left join weights using (doc_id)),
scored as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double))) as bigint) as score from every),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when r <= 25 * n // 100 then r end as rank from scored left join placed using (doc_id)
"""

"""Benchmark decontamination by winnowing.

The fingerprints of a text are the smallest hashes of its k-grams of words in every sliding window of w k-grams.
Two texts that share a run of w + k - 1 words share the window and so its fingerprint. With k = 5 and w = 9 that
is every run of 13 words; items of fewer words get a smaller w, or k, so that their whole length is guaranteed.
Documents and items are joined on fingerprints. Each fingerprint carries the words around it, so a hit is
extended to both sides word by word; a run that fills an item window is a hit, and hash collisions end there.

The documents' texts are read once and never shuffled. A bitmap of fixed size over the items' fingerprints keeps
those of other text inside the reading task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.llm.common import ROW_KEY, gram_hashes, pieces, read, save, span_hashes, text_bytes, with_row_key, word_spans

WINDOW = 13
GRAM = 5
BITMAP_BITS = 22  # 512 KB whatever the benchmark's size
BROADCAST_CONTEXTS = 100_000  # item contexts (about 300 bytes each) that are broadcast; more are joined by a shuffle

NONE = np.uint64((1 << 64) - 1)


def winnow(words: np.ndarray, before: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints of texts in a row; ``before`` counts the words before each text."""
    grams = gram_hashes(words, k)
    n = len(grams)
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    stop = np.repeat(before[1:], np.diff(before))[:n]
    whole = np.arange(n) + k <= stop
    grams[~whole] = NONE
    least = grams[: n - w + 1].copy()
    for j in range(1, w):
        np.minimum(least, grams[j: n - w + 1 + j], out=least)
    reach = np.zeros(n, np.uint64)  # largest of the window minima over the windows that hold the place
    for j in range(w):
        np.maximum(reach[j: n - w + 1 + j], least, out=reach[j: n - w + 1 + j])
    at = np.flatnonzero((reach == grams) & whole)
    return at, grams[at]


def plan_of(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(k, w) pairs that guarantee a window of each item length."""
    sizes = {min(n, window) for n in lengths if n > 0}
    plan = [(n, 1) for n in sorted(sizes) if n < GRAM]
    long = [n for n in sizes if n >= GRAM]
    return plan + ([(GRAM, min(long) - GRAM + 1)] if long else [])


def _contexts(raw: bytes, starts, ends, at: np.ndarray, low: np.ndarray, high: np.ndarray, window: int):
    """Words before each place, nearest first, and words from it on; at most a window on either side."""
    left, right = [], []
    for p, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
        left.append([raw[starts[i]: ends[i]].decode() for i in range(p - 1, max(a, p - window + 1) - 1, -1)])
        right.append([raw[starts[i]: ends[i]].decode() for i in range(p, min(b, p + window))])
    return left, right


PRINT = "struct<hash:bigint,pos:int,lead:array<string>,tail:array<string>>"
PRINT_TYPE = pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("lead", pa.list_(pa.string())), ("tail", pa.list_(pa.string()))])


def fingerprints(texts: DataFrame, text_col: str, plan: list[tuple[int, int]], bitmap: np.ndarray | None = None,
                 window: int = WINDOW) -> DataFrame:
    """Replaces ``text_col`` by n_words and prints, the fingerprints with their contexts; with ``bitmap`` only
    those whose lowest bits are marked in it."""
    kept = [c for c in texts.columns if c != text_col]
    kinds = dict(texts.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + ["n_words bigint", f"prints array<{PRINT}>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(bitmap, bitorder="little").astype(bool) if bitmap is not None else None
        for batch in pieces(batches, text_col):
            data, off = text_bytes(batch.column(text_col))
            low, starts, ends, before = word_spans(data, off)
            words = span_hashes(low, starts, ends)
            found = [winnow(words, before, k, w) for k, w in plan] or [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            at, hashes = (np.concatenate(x) for x in zip(*found))
            if marks is not None:
                hit = marks[(hashes & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)]
                at, hashes = at[hit], hashes[hit]
            order = np.argsort(at, kind="stable")
            at, hashes = at[order], hashes[order]
            row = np.searchsorted(before, at, "right") - 1
            left, right = _contexts(low.tobytes(), starts, ends, at, before[row], before[row + 1], window)
            values = pa.StructArray.from_arrays([
                pa.array(hashes.view(np.int64)), pa.array((at - before[row]).astype(np.int32)),
                pa.array(left, pa.list_(pa.string())), pa.array(right, pa.list_(pa.string()))], fields=list(PRINT_TYPE))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(np.diff(before)), lists], names=[*kept, "n_words", "prints"])

    return texts.mapInArrow(run, schema)


def _run(a: Column, b: Column) -> Column:
    """Number of equal words from the start of two word lists."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(equal, F.lit(False))
    return F.when(stop == 0, F.size(equal).cast("bigint")).otherwise(stop - 1)


def _covered(spans: Column) -> Column:
    """Number of places inside sorted [start, stop) spans."""
    zero = F.struct(F.lit(0).cast("bigint").alias("stop"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct(
        F.greatest(acc["stop"], s["stop"]).alias("stop"),
        (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["stop"], s["start"]))).alias("n")), lambda acc: acc["n"])


def item_contexts(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """One row for each distinct (fingerprint, context, window size) of the items, with the items that have it."""
    named = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    lengths = fingerprints(named, "text", [], window=window).select(F.least("n_words", F.lit(window)).alias("n")).distinct()
    plan = plan_of([r["n"] for r in lengths.collect()], window)  # at most window + 1 rows
    prints = fingerprints(named, "text", plan, window=window).select(
        "item", F.least("n_words", F.lit(window)).alias("need"), F.explode("prints").alias("p"))
    folded = prints.groupBy(F.col("p.hash").alias("hash"), F.col("p.lead").alias("item_lead"), F.col("p.tail").alias("item_tail"), "need")
    return save(folded.agg(F.collect_set("item").alias("items")), "item-prints"), plan


def _bitmap(contexts: DataFrame) -> np.ndarray:
    marks = np.zeros(1 << BITMAP_BITS, np.uint8)
    low = contexts.select(F.col("hash").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)).cast("int").alias("b")).distinct()
    marks[[r["b"] for r in low.toLocalIterator()]] = 1  # at most 2 ** BITMAP_BITS rows
    return np.packbits(marks, bitorder="little")


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text_col`` replaced by n_words, n_hit (words inside an occurrence of an item window), spans
    ([start, stop) word runs of the hits) and items (ids as strings, sorted).

    One row for each row: repeated rows and null ids are kept apart. A null text or one without words has n_words
    0 and no hits; items without words match nothing; an empty benchmark hits nothing. Extra columns are kept, but
    for those that have the name of a result, which takes their place."""
    contexts, plan = item_contexts(benchmark, item_col, item_text_col, window)
    kept = [c for c in docs.columns if c not in (text_col, "n_words", "n_hit", "spans", "items")]
    inner = {c: f"kept_{i}" for i, c in enumerate(kept)}
    rows = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in kept], F.monotonically_increasing_id().alias("uid"), F.col(f"`{text_col}`").alias("text"))
    prints = fingerprints(rows, "text", plan, _bitmap(contexts), window)
    one = prints.select("*", F.explode_outer("prints").alias("p")).drop("prints")
    # documents without a fingerprint need a key of their own, else all of them would meet in one task
    keyed = one.withColumn("hash", F.coalesce("p.hash", F.xxhash64("uid")))
    if contexts.count() <= BROADCAST_CONTEXTS:
        contexts = F.broadcast(contexts)
    back, on = _run(F.col("p.lead"), F.col("item_lead")), _run(F.col("p.tail"), F.col("item_tail"))
    met = keyed.join(contexts, "hash", "left").withColumn("back", back).withColumn("on", on)
    good = F.col("p").isNotNull() & (F.col("back") + F.col("on") >= F.col("need"))
    span = F.struct((F.col("p.pos") - F.col("back")).cast("bigint").alias("start"), (F.col("p.pos") + F.col("on")).cast("bigint").alias("stop"))
    out = met.groupBy("uid").agg(
        *[F.first(inner[c]).alias(inner[c]) for c in kept], F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(good, span))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(good, F.col("items")))))).alias("items"))
    return out.select(*[F.col(inner[c]).alias(c) for c in kept], "n_words", _covered(F.col("spans")).alias("n_hit"), "spans", "items")


def contaminated() -> Column:
    """At least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows; all columns kept."""
    keyed = with_row_key(docs, id_col, text_col)
    bad = hits(keyed.select(ROW_KEY, text_col), benchmark, text_col).filter(contaminated()).select(ROW_KEY)
    return keyed.join(bad, ROW_KEY, "left_anti").select(*docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


OP2_SQL = r"""
with dw as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
bw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
items as (select item_id, w, least(13, len(w)) as k from bw where len(w) > 0),
iwin as (select distinct item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as g from items, unnest(range(1, len(w) - k + 2)) t(i)),
dwin as (select doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as g
         from dw, (select distinct k from items) s, unnest(range(1, len(w) - k + 2)) t(i)),
hit as (select doc_id, i, k, item_id from dwin join iwin using (k, g)),
n as (select doc_id, count(distinct p) as n_hit from hit, unnest(range(i, i + k)) u(p) group by 1),
m as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids
      from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join n using (doc_id) left join m using (doc_id)
"""

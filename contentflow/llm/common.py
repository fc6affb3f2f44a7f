"""Helpers shared by the operators: shared-folder tables, hot-key joins, byte-level word arrays.

Text is cut and hashed on whole Arrow batches with numpy. A word is a run of the bytes
0-9, a-z (A-Z lowered) and everything from 0x80, which is the class
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on UTF-8.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentflow.session import give_back, shared_folder

PIECE_BYTES = 1 << 20  # text handled by numpy at a time; bounds a task's memory


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; nothing is ever written over."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there,
    later readers prune columns, and a lost executor loses nothing."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_by_count(rows: DataFrame, groups: DataFrame, key: str, count: str, rows_total: int, share: int = 2000) -> DataFrame:
    """Inner join of ``rows`` with one ``groups`` row per key, where ``count`` says how many rows a key has.

    Keys with over 1 / ``share`` of all rows are fewer than ``share``, so they are broadcast and their rows
    stay where they are; only the rest is shuffled, and no key of the rest is large."""
    hot = F.broadcast(groups.filter(F.col(count) > rows_total / share))
    cold = groups.filter(F.col(count) <= rows_total / share)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


# ---- numpy on UTF-8 bytes ------------------------------------------------------------------

LOWER = np.zeros(256, np.uint8)  # 0: not part of a word
LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
LOWER[0x80:] = np.arange(0x80, 0x100)

BASE = 0x9E3779B97F4A7C15  # odd
_BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE_BYTES), base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets of each (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    give_back()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``data`` (ascending, non-overlapping), by prefix sums of a polynomial."""
    out = np.empty(len(starts), np.uint64)
    g = 0
    while g < len(starts):
        h = max(g + 1, int(np.searchsorted(ends, starts[g] + PIECE_BYTES, "right")))
        lo, hi = int(starts[g]), int(ends[h - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _power_table(BASE, hi - lo)[: hi - lo], out=sums[1:])
        out[g:h] = (sums[ends[g:h] - lo] - sums[starts[g:h] - lo]) * _power_table(_BASE_INVERSE, hi - lo)[starts[g:h] - lo]
        g = h
    return mix(out)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, word starts, word ends, number of words before each text) of texts in a row."""
    low = LOWER[data]
    n = len(low)
    inside = low != 0
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if n:
        edges = off[(off > 0) & (off < n)]
        before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, off)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` words in a row (over text ends too; the caller knows which are whole)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + words[j: j + n]
    return mix(out)


def ids_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """An id column as 64-bit integers, nulls kept."""
    return batch.column(name).cast(pa.int64())


ROW_KEY = "_row_key"


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds one never-null string that is equal for two rows only if id and text are equal."""
    return docs.withColumn(ROW_KEY, F.concat(
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), F.when(F.col(text_col).isNull(), "-").otherwise("+"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose row key is in ``keys`` (distinct keys); with ``once``, one row for each key.

    One shuffle of the documents by a key that no two documents share."""
    found = with_row_key(docs, id_col, text_col).join(keys.select(ROW_KEY), ROW_KEY, "inner" if once else "left_semi")
    if once:
        found = found.dropDuplicates([ROW_KEY])
    return found.select(*docs.columns)

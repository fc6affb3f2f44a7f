"""Near duplicates by BagMinHash signatures over bags of word shingles.

A text is a bag of shingles of five words; two texts are linked if their weighted Jaccard similarity, the sum of
the smaller counts over the sum of the larger, is 0.8 or more.

BagMinHash: each shingle owns Poisson processes over (time, weight), one for each dyadic interval of the weight axis
(0, 1], (1, 2], (2, 4], ..., with the interval's width as rate. A point falls on one of the signature's components
and on one discrete weight; it counts for a text if the weight is at most the shingle's count there. A component
is the time of its first point, so two texts agree on it with exactly their weighted similarity. Points are made in
order of time only up to the time at which a text's components are all taken, which is about (ln m + 2) m points
a text whatever its length.

Texts with the same words are one class from the start. Classes are banded, and each class is first compared with
its closest bucket leader. Buckets that then still hold members of several groups are compared within tasks: all
pairs that are not yet in one group and whose signatures allow the similarity, each in the first bucket it has,
exactly on the bags; only links that join groups come out. So no pair is skipped but those whose link would change
nothing, and no list of pairs of a large group is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.llm.common import (ROW_KEY, gram_hashes, join_by_count, keep_rows, mix, pieces, read, save, span_hashes, text_bytes,
                                    with_row_key, word_spans)
from contentflow.llm.components import components

SHINGLE = 5
BANDS, ROWS = 64, 8  # a pair at 0.8 shares no band with a chance of 8e-6
COMPONENTS = BANDS * ROWS
SKETCH_FLOOR = 0.70  # 5.5 standard deviations below 0.8; a sketch keeps one byte of each component
TILE = 512  # members of a bucket in one task; larger buckets are compared tile by tile
SIMILARITY = (4, 5)


# ---- bags ----------------------------------------------------------------------------------


def bags(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash) of every shingle of texts in a row, sorted by text, and two 64-bit hashes of each text's
    word sequence. A text of one to four words is one shingle; a text without words has none."""
    low, starts, ends, before = word_spans(data, off)
    words = span_hashes(low, starts, ends)
    n = np.diff(before)
    row = np.repeat(np.arange(len(n)), n)
    grams = gram_hashes(words, SHINGLE)
    whole = np.arange(len(grams)) + SHINGLE <= before[1:][row[: len(grams)]]
    of, hashes = [row[: len(grams)][whole]], [grams[whole]]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n == k)
        if len(short):
            of.append(short)
            hashes.append(gram_hashes(words, k)[before[short]])
    of, hashes = np.concatenate(of), np.concatenate(hashes)
    order = np.argsort(of, kind="stable")
    names = np.zeros((len(n), 2), np.uint64)
    place = (np.arange(len(words)) - before[row]).astype(np.uint64)
    for j in range(2):
        value = mix(words ^ mix(place * np.uint64(2) + np.uint64(j + 1)))
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        names[:, j] = mix(sums[before[1:]] - sums[before[:-1]])
    return of[order], hashes[order], names


def counted(of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of the distinct shingles of each text."""
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return of[first], hashes[first], np.diff(np.append(first, len(of)))


# ---- signatures ----------------------------------------------------------------------------


def signatures(of: np.ndarray, hashes: np.ndarray, counts: np.ndarray, texts: int, m: int = COMPONENTS) -> np.ndarray:
    """First time of every component for each of ``texts`` weighted sets; infinite for empty ones."""
    out = np.full((texts, m), np.inf)
    weight = np.bincount(of, weights=counts, minlength=texts)
    todo, factor = weight > 0, 1.0
    while todo.any():
        mine = todo[of]
        limit = np.zeros(texts)
        limit[todo] = factor * m * (np.log(m) + 2) / weight[todo]
        out[todo] = np.inf
        _fill(out, of[mine], hashes[mine], counts[mine], limit, m)
        todo, factor = todo & np.isinf(out).any(axis=1), factor * 1.7
    return out


def _fill(out: np.ndarray, of: np.ndarray, hashes: np.ndarray, counts: np.ndarray, limit: np.ndarray, m: int) -> None:
    """Enters all points before each text's time limit."""
    top = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1  # dyadic intervals that reach into the weight
    at = np.repeat(np.arange(len(of)), top)
    level = np.arange(len(at)) - np.repeat(np.cumsum(top) - top, top)
    lowest = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, lowest)
    seed = mix(hashes[at] + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    row, most, stop = of[at], counts[at], limit[of[at]]
    time, done = np.zeros(len(at)), 0
    flat = out.reshape(-1)
    while len(at):
        step = int(np.clip(200_000 // len(at), 1, 4096))
        draw = (np.arange(done + 1, done + step + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        h = mix(seed[:, None] + draw)
        gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / width[:, None]
        times = time[:, None] + np.cumsum(gap, axis=1)
        h = mix(h ^ np.uint64(0xA0761D6478BD642F))
        component = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        place = lowest[:, None] + 1 + (((h & np.uint64(0xFFFFFFFF)) * width[:, None].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        good = (times < stop[:, None]) & (place <= most[:, None])
        np.minimum.at(flat, (row[:, None] * m + component.astype(np.int64))[good], times[good])
        time, done = times[:, -1], done + step
        left = time < stop
        if not left.all():
            seed, row, most, stop, time, width, lowest = (x[left] for x in (seed, row, most, stop, time, width, lowest))
            at = at[left]


def band_keys(times: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    bits = times.view(np.uint64).reshape(len(times), BANDS, -1)
    key = np.zeros(bits.shape[:2], np.uint64)
    for r in range(bits.shape[2]):
        key = mix(key ^ mix(bits[:, :, r] + np.uint64(r + 1)))
    return mix(key + np.arange(BANDS, dtype=np.uint64))


def sketch(times: np.ndarray) -> np.ndarray:
    return (mix(times.view(np.uint64)) & np.uint64(255)).astype(np.uint8)


# ---- jobs ----------------------------------------------------------------------------------

SIGNED = f"id bigint, uid bigint, {ROW_KEY} string, words binary, n bigint, bands binary, sketch binary"


def sign(rows: DataFrame) -> DataFrame:
    """Name of the word sequence, bag size, band keys and sketch of each row (id, uid, row key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            of, hashes, names = bags(*text_bytes(batch.column("text")))
            n = np.bincount(of, minlength=batch.num_rows)
            times = signatures(*counted(of, hashes), batch.num_rows)
            some = (n > 0).tolist()
            keys, brief = band_keys(times).view(np.int64), sketch(times)
            yield pa.record_batch([
                batch.column("id"), batch.column("uid"), batch.column(ROW_KEY),
                pa.array([x.tobytes() if s else None for x, s in zip(names, some)], pa.binary()), pa.array(n),
                pa.array([x.tobytes() if s else None for x, s in zip(keys, some)], pa.binary()),
                pa.array([x.tobytes() if s else None for x, s in zip(brief, some)], pa.binary())],
                names=["id", "uid", ROW_KEY, "words", "n", "bands", "sketch"])

    return save(rows.select("id", "uid", ROW_KEY, "text").mapInArrow(run, SIGNED), "near-signatures")


def band_rows(facts: DataFrame) -> DataFrame:
    """(uid, key) of every band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.record_batch({"uid": pa.array(np.repeat(batch.column("uid").to_numpy(), BANDS)), "key": pa.array(keys)})

    return facts.select("uid", "bands").mapInArrow(run, "uid bigint, key bigint")


PAIRS = "a bigint, b bigint"


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bags are similar enough; ``texts`` holds (uid, text) of all of them."""
    one = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    part, whole = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, "ta"), "tb"):
            left, right = (elements(*bags(*text_bytes(batch.column(c)))[:2], batch.num_rows) for c in ("ta", "tb"))
            good = []
            for x, y in zip(left, right):
                common = shared(x, y)
                good.append(whole * common >= part * (len(x) + len(y) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return save(both.mapInArrow(run, PAIRS), "near-links")


def elements(of: np.ndarray, hashes: np.ndarray, texts: int) -> list[np.ndarray]:
    """Each bag as a sorted set: the n-th occurrence of a shingle is an element of its own, so that two bags share as
    many elements as the sum of their smaller counts."""
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    named = mix(hashes + nth.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    edges = np.searchsorted(of, np.arange(texts + 1))
    return [np.sort(named[edges[i]: edges[i + 1]]) for i in range(texts)]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Number of elements in both of two sorted sets."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links_of_bucket(table: pa.Table) -> pa.Table:
    """Links that join groups of a bucket's members (uid, root, n, tile, bands, sketch, text).

    A pair counts if its groups differ, its bag sizes and sketches allow the similarity, and this is the first band
    that it shares. It is compared exactly, the likeliest first, unless links found before already join its groups."""
    uid, root, n, tile = (table[c].to_numpy() for c in ("uid", "root", "n", "tile"))
    apart = table["t0"][0].as_py() != table["t1"][0].as_py()
    bands = np.frombuffer(b"".join(table["bands"].to_pylist()), np.int64).reshape(len(uid), BANDS)
    marks = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(uid), COMPONENTS)
    earlier = bands[:, : int(np.flatnonzero(bands[0] == table["key"][0].as_py())[0])]
    part, whole = SIMILARITY
    sets = elements(*bags(*text_bytes(table["text"]))[:2], len(uid))
    parent = {int(r): int(r) for r in root}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for i in range(len(uid)):
        other = (uid > uid[i]) & (root != root[i]) & (whole * np.minimum(n, n[i]) >= part * np.maximum(n, n[i]))
        if apart:
            other &= tile != tile[i]
        at = np.flatnonzero(other)
        at = at[~(earlier[at] == earlier[i]).any(axis=1)]
        if not len(at):
            continue
        alike = (marks[at] == marks[i]).mean(axis=1)
        for k in np.argsort(-alike, kind="stable").tolist():
            if alike[k] < SKETCH_FLOOR:
                break
            j = int(at[k])
            x, y = find(int(root[i])), find(int(root[j]))
            if x == y:
                continue
            common = shared(sets[i], sets[j])
            if whole * common >= part * (len(sets[i]) + len(sets[j]) - common):
                parent[max(x, y)] = min(x, y)
                found.append((int(uid[i]), int(uid[j])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def bucket_links(members: DataFrame, facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Verified links (a, b) between the groups that share a bucket; members (key, uid), facts by uid.

    Buckets whose members are all in one group are left out. A bucket of t tiles is compared as t (t + 1) / 2 pairs of
    tiles, each a task's group of at most 2 TILE texts, and only links that join groups leave the task."""
    known = members.join(groups.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    mixed = known.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size"))
    mixed = save(mixed.filter("r0 != r1").select("key", "size", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")), "near-mixed")
    open_ = join_by_count(known, mixed, "key", "size", members.count()).withColumn("tile", F.pmod(F.hash("uid"), F.col("tiles")))
    met = open_.select("key", "uid", "root", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    met = met.withColumn("t0", F.least("tile", "other")).withColumn("t1", F.greatest("tile", "other")).drop("other")
    return save(met.join(facts, "uid").groupBy("key", "t0", "t1").applyInArrow(links_of_bucket, PAIRS).distinct(), "near-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, row key, class_id (smallest id of its class, nulls last), class_size, copy_id
    (smallest id among rows with the same words), n_shingles, keeps (this row is the one of its class that stays).

    A class is a connected group of linked texts. A text without words is a class of its own, as is an empty or
    null one. Rows that repeat an id and a text are in one class, one of them keeps. Other columns are not read."""
    rows = with_row_key(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text")
    signed = sign(rows.withColumn("uid", F.monotonically_increasing_id()))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    copies = signed.filter("words is not null").groupBy("words").agg(F.min(place).alias("w"), F.count(F.lit(1)).alias("copies"))
    copies = save(copies.select("words", "copies", F.col("w.uid").alias("rep"), F.col("w.id").alias("rep_id")), "near-copies")
    facts = signed.join(copies.select(F.col("rep").alias("uid")), "uid", "left_semi")

    banded = band_rows(facts)
    buckets = banded.groupBy("key").agg(F.min("uid").alias("leader"), F.count(F.lit(1)).alias("size"))
    buckets = save(buckets.filter("size > 1"), "near-buckets")
    total = copies.count() * BANDS
    members = save(join_by_count(banded, buckets, "key", "size", max(total, 1)).select("key", "uid", "leader"), "near-members")

    needed = facts.join(members.select("uid").distinct(), "uid", "left_semi").select("uid", ROW_KEY)
    texts = save(rows.select(ROW_KEY, "text").join(needed, ROW_KEY).dropDuplicates(["uid"]).select("uid", "text"), "near-texts")
    facts = facts.select("uid", "n", "bands", "sketch").join(texts, "uid")

    led = members.filter("uid != leader").groupBy("uid", "leader").agg(F.count(F.lit(1)).alias("shared"))
    closest = led.groupBy("uid").agg(F.max(F.struct("shared", F.col("leader"))).alias("best"))
    links = verified(closest.select(F.col("best.leader").alias("a"), F.col("uid").alias("b")), texts)
    links = links.unionByName(bucket_links(members.select("key", "uid"), facts, components(links)))
    groups = components(links)

    linked = copies.join(groups.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    linked = save(linked, "near-linked")
    place = F.struct(F.col("rep_id").isNull().alias("none"), F.col("rep_id"), F.col("rep"))
    classes = linked.groupBy("root").agg(F.min(place).alias("w"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    classes = save(classes.select("root", "texts", "class_size", F.col("w.rep_id").alias("class_id"), F.col("w.rep").alias("keep_uid")), "near-classes")
    named = save(join_by_count(linked, classes, "root", "texts", copies.count()).drop("root", "texts"), "near-names")

    narrow = signed.select("id", "uid", ROW_KEY, "words", "n")
    worded = join_by_count(narrow.filter("words is not null"), named, "words", "copies", signed.count())
    out = ["id", ROW_KEY, F.col("class_id"), F.col("class_size"), F.col("rep_id").alias("copy_id"), F.col("n").alias("n_shingles"), (F.col("uid") == F.col("keep_uid")).alias("keeps")]
    alone = narrow.filter("words is null").select(
        "id", ROW_KEY, F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.col("id").alias("copy_id"),
        F.col("n").alias("n_shingles"), F.lit(True).alias("keeps"))
    return worded.select(*out).unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class; all columns kept."""
    kept = near_duplicates(docs, id_col, text_col).filter("keeps").select(ROW_KEY).distinct()
    return keep_rows(docs, kept, id_col, text_col, once=True)


def op8(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "copy_id", "n_shingles")

"""Prefix trie of conversations by burst tries.

A conversation is one row: the chained 128-bit digests of its turns (the digest at depth d names the whole prefix of d turns),
the number of words of each turn and the digest of the ids that end with it. Equal conversations are folded first, so a
group of copies is one row, whatever its size; the ids of a group are digested in order from chunks of ``CHUNK_IDS`` ids.

The root is the first trie head. A container holds the suffixes below a head that begin with the same next turn; containers
of over ``CONTAINER_TURNS`` turns (a hundred-thousandth of all turns, if that is more) of at least two conversations become heads
themselves and burst by the next turn. The sizes of all prefixes of the next levels are counted at once, so the rounds follow the
logarithm of the depth of the deepest head. What remains is dealt over the tasks by container, sorted by digests, and swept:
neighbours share their prefix, every new digest is a node. Sums below a head come from its containers and heads.

Only digests and numbers are shuffled. A task holds one container; heads on one level are at most a hundred thousand, so
their digests are sent to all tasks. One conversation is one row of 20 bytes a turn (so 10 million turns take 200 MB).

Null roles and texts are empty ones. Turns are in order of their number, null first; equal numbers by the digest of role and text, and
each repeated row is a turn. Rows without a conv_id belong to no conversation and are left out. An empty table has no
nodes. Columns besides conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentflow.llm.common import join_by_count, read, save
from contentflow.llm.resample import SQL_CRC, SQL_TABLE

CONTAINER_TURNS = 2048
CONTAINERS = 100_000  # a container may hold this part of all turns
CHUNK_IDS = 4096  # ids of one chunk of a group of equal conversations
FIRST_LEVELS = 8  # levels of the first round of bursts; each later round takes twice as many
OUT_NODES = 20_000
ROOT = bytes(16)
ENDS_OF_NONE = hashlib.sha256().hexdigest()

SEQUENCES = "full binary, chunk bigint, conv_id bigint, keys binary, words binary"
FOLDED = "full binary, conv_id bigint, n_convs bigint, ends string, keys binary, words binary"
NODES = ("kind string, node_key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_tokens bigint, ends_sha256 string")


# ---- conversations -------------------------------------------------------------------------


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id, words) of every turn: ``id`` the first 16 bytes of a digest of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.substring(F.sha2(told, 256), 1, 32)).alias("id"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))


def conversations_of(turns: DataFrame, *keys: str) -> DataFrame:
    """(keys, turns): the turns of each conversation in order, as an array of (turn, id, words)."""
    return turns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce(F.col("turn"), F.lit(-(1 << 63))).alias("turn"), "id", "words"))).alias("turns"))


def grafted(turns: DataFrame, every: int, most: int) -> DataFrame:
    """Conversations rebuilt on the first of their group of ``every`` ids: crc32(id) % ``most`` of its first turns, then
    their own turns after so many."""
    rows = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).repartition("base")
    own = conversations_of(rows, "base", "conv_id")
    firsts = conversations_of(rows.filter("conv_id = base"), "base").select("base", F.slice("turns", 1, most).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    head = F.coalesce(F.slice("first", F.lit(1), h), F.expr("slice(turns, 1, 0)"))
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(firsts, "base", "left").select("conv_id", F.concat(head, tail).alias("turns"))


# ---- folding -------------------------------------------------------------------------------


def _chained(convs: DataFrame) -> DataFrame:
    """Conversations with the chained digests of their prefixes."""
    rows = convs.select("conv_id", F.transform("turns", lambda t: t["id"]).alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full, keys, words = [], [], []
            for ids, counts in zip(batch.column("ids").to_pylist(), batch.column("words").to_pylist()):
                key, chain = ROOT, []
                for i in ids:
                    key = hashlib.blake2b(key + i, digest_size=16).digest()
                    chain.append(key)
                full.append(key)
                keys.append(b"".join(chain))
                words.append(np.array(counts, np.uint32).tobytes())
            ids = batch.column("conv_id")
            chunk = pa.array(ids.to_numpy() // CHUNK_IDS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.binary()), chunk, ids, pa.array(keys, pa.binary()), pa.array(words, pa.binary())],
                                             names=["full", "chunk", "conv_id", "keys", "words"])

    return rows.mapInArrow(run, SEQUENCES)


def _folded(sequences: DataFrame) -> DataFrame:
    """One row for each different conversation, with the number, the smallest and the digest of its ids.

    A group's ids come as chunks in order; a task reads them as a stream and never holds a group."""
    ids = F.array_sort(F.collect_list("conv_id"))
    chunks = (sequences.groupBy("full", "chunk").agg(ids.alias("ids"), F.first("keys").alias("keys"), F.first("words").alias("words"))
              .select("full", "chunk", F.element_at("ids", 1).alias("conv_id"), F.size("ids").cast("bigint").alias("n"),
                      F.array_join(F.col("ids").cast("array<string>"), ",").alias("told"), "keys", "words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, digest = None, 0, None

        def closed() -> pa.RecordBatch:
            row = {"full": group["full"], "conv_id": group["conv_id"], "n_convs": total, "ends": digest.hexdigest(), "keys": group["keys"], "words": group["words"]}
            return row

        kind = pa.schema([("full", pa.binary()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends", pa.string()), ("keys", pa.binary()), ("words", pa.binary())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if group is None or row["full"] != group["full"]:
                    if group is not None:
                        out.append(closed())
                    group, total, digest = row, 0, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(row["told"].encode())
                total += row["n"]
            yield pa.RecordBatch.from_pylist(out, schema=kind)
        if group is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema=kind)

    return chunks.repartition("full").sortWithinPartitions("full", "chunk").mapInArrow(run, FOLDED)


# ---- bursts --------------------------------------------------------------------------------


def _halves(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True)


def _prefix_rows(folded: DataFrame, low: int, high: int, heads) -> DataFrame:
    """A row for each prefix of ``low`` < depth <= ``high`` turns of the conversations whose prefix of ``low`` turns is a head."""
    kind = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, turns bigint, n_convs bigint, conv_id bigint, words bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        oversized = heads.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for keys, words, n, conv in zip(*[batch.column(c).to_pylist() for c in ("keys", "words", "n_convs", "conv_id")]):
                size = len(keys) // 16
                if size <= low or low and keys[16 * low - 16: 16 * low] not in oversized:
                    continue
                counts = np.frombuffer(words, np.uint32)
                parent = _halves(keys[16 * low - 16: 16 * low]) if low else (0, 0)
                for d in range(low + 1, min(size, high) + 1):
                    own = _halves(keys[16 * d - 16: 16 * d])
                    for col, value in zip(cols, (*own, *parent, d, size - d + 1, n, conv, int(counts[d - 1]))):
                        col.append(value)
                    parent = own
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k1", "k2", "p1", "p2", "depth", "turns", "n_convs", "conv_id", "words"])

    return folded.select("keys", "words", "n_convs", "conv_id").mapInArrow(run, kind)


def _key(high: str, low: str) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def _heads(spark: SparkSession, folded: DataFrame, turns: int, limit: int) -> tuple[DataFrame | None, frozenset[bytes]]:
    """The prefixes that are heads besides the root: a table, and their digests."""
    size = max(limit, turns // CONTAINERS)
    tables, keys, low, step = [], frozenset(), 0, FIRST_LEVELS
    while True:
        shared = spark.sparkContext.broadcast(keys)
        found = save(
            _prefix_rows(folded, low, low + step, shared).groupBy("k1", "k2").agg(
                F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.sum("turns").alias("turns"), F.count(F.lit(1)).alias("n"),
                F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"))
            .filter((F.col("turns") > size) & (F.col("n") > 1))
            .select(_key("k1", "k2").alias("node_key"), _key("p1", "p2").alias("parent_key"), "depth", "n_convs", "conv_id",
                    ((F.col("n_convs") - 1) * F.col("words")).alias("own")), "trie-heads")
        listed = found.select("node_key", "depth").collect()  # at most turns / size on each level
        if listed:
            tables.append(found)
            keys |= frozenset(bytes(r["node_key"]) for r in listed)
        low, step = low + step, 2 * step
        if not any(r["depth"] == low for r in listed):
            break
    table = None
    for t in tables:
        table = t if table is None else table.unionByName(t)
    return table, keys


def _head_depth(keys: bytes, heads: frozenset[bytes]) -> int:
    """Turns of the longest prefix that is a head, the root at least."""
    d = 0
    while 16 * d < len(keys) and keys[16 * d: 16 * d + 16] in heads:
        d += 1
    return d


# ---- sweep ---------------------------------------------------------------------------------


class _Container:
    """Nodes below one head that begin with the same turn, in order of their first conversation; the first is the top."""

    def __init__(self, key: bytes, top: int):
        self.key, self.top, self.path, self.parent_key = key, top, [], ROOT
        self.keys, self.depth, self.parent, self.words = [], [], [], []
        self.n, self.conv, self.ends = [], [], []
        self.last, self.above = b"", b""

    def add(self, keys: bytes, words: np.ndarray, n: int, conv: int, ends: str) -> None:
        size, d = len(keys) // 16, self.top - 1
        if self.path:
            while d < size and d < len(self.last) // 16 and keys[16 * d: 16 * d + 16] == self.last[16 * d: 16 * d + 16]:
                d += 1
        else:
            self.above = keys[: 16 * d]
            self.parent_key = keys[16 * d - 16: 16 * d] if d else ROOT
        del self.path[d - self.top + 1:]
        for depth in range(d + 1, size + 1):
            self.parent.append(self.path[-1] if self.path else -1)
            self.path.append(len(self.keys))
            self.keys.append(keys[16 * depth - 16: 16 * depth])
            self.depth.append(depth)
            self.words.append(int(words[depth - 1]))
            self.n.append(0)
            self.conv.append(conv)
            self.ends.append(ENDS_OF_NONE)
        at = self.path[-1]
        self.n[at], self.conv[at], self.ends[at], self.last = n, min(conv, self.conv[at]), ends, keys

    def close(self) -> tuple[list[list], int, int]:
        """Columns of the nodes, and leaves and saved words of the whole container."""
        size = len(self.keys)
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for i in range(size - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            saved[i] += (self.n[i] - 1) * self.words[i]
            p = self.parent[i]
            if p >= 0:
                children[p] += 1
                leaves[p] += leaves[i]
                saved[p] += saved[i]
                self.n[p] += self.n[i]
                self.conv[p] = min(self.conv[p], self.conv[i])
        parents = [self.keys[p] if p >= 0 else self.parent_key for p in self.parent]
        parent_conv = [self.conv[p] if p >= 0 else None for p in self.parent]
        return [["top" if p < 0 else "node" for p in self.parent], self.keys, parents, self.conv, self.depth, parent_conv, self.n, children, leaves, saved, self.ends], leaves[0], saved[0]


NODE_SCHEMA = pa.schema([
    ("kind", pa.string()), ("node_key", pa.binary()), ("parent_key", pa.binary()), *[(c, pa.int64()) for c in (
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string())])


class _Sweep:
    """Collects nodes, and for each head above a container its leaves, saved words and (for the head next to it) child."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in NODE_SCHEMA]
        self.below: dict[bytes, list[int]] = {}

    def take(self, container: _Container) -> None:
        columns, leaves, saved = container.close()
        for column, values in zip(self.columns, columns):
            column.extend(values)
        above = container.above
        for d in range(len(above) // 16 + 1):
            sums = self.below.setdefault(above[16 * d - 16: 16 * d] if d else ROOT, [0, 0, 0])
            sums[0] += leaves
            sums[1] += saved
            sums[2] += 16 * d == len(above)

    def full(self) -> bool:
        return len(self.columns[0]) + len(self.below) >= OUT_NODES

    def batch(self) -> pa.RecordBatch:
        sums, none = list(self.below.items()), [None] * len(self.below)
        extra = [["sum"] * len(sums), [k for k, _ in sums], none, none, none, none, none, [s[2] for _, s in sums], [s[0] for _, s in sums], [s[1] for _, s in sums], none]
        arrays = [pa.array(a + b, f.type) for a, b, f in zip(self.columns, extra, NODE_SCHEMA)]
        self.__init__()
        return pa.RecordBatch.from_arrays(arrays, schema=NODE_SCHEMA)


def _swept(folded: DataFrame, heads) -> DataFrame:
    """Nodes of all containers (kind top or node) and sums for the heads above them (kind sum)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = [_head_depth(k, heads.value) for k in batch.column("keys").to_pylist()]
            first = [k[16 * d: 16 * d + 16] for k, d in zip(batch.column("keys").to_pylist(), depth)]
            out = pa.Table.from_batches([batch]).append_column("container", pa.array(first, pa.binary())).append_column("top", pa.array([d + 1 for d in depth], pa.int64()))
            yield from out.filter(pa.array([bool(f) for f in first], pa.bool_())).to_batches()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, _Sweep()
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["container"] != now.key:
                    if now is not None:
                        out.take(now)
                        if out.full():
                            yield out.batch()
                    now = _Container(row["container"], row["top"])
                now.add(row["keys"], np.frombuffer(row["words"], np.uint32), row["n_convs"], row["conv_id"], row["ends"])
        if now is not None:
            out.take(now)
        yield out.batch()

    placed = folded.mapInArrow(place, FOLDED + ", container binary, top bigint")
    return placed.repartition("container").sortWithinPartitions("container", "keys").mapInArrow(sweep, NODES)


# ---- heads ---------------------------------------------------------------------------------


def _head_nodes(heads: DataFrame, folded: DataFrame, sums: DataFrame) -> DataFrame:
    """Nodes of the heads. Heads add their own saved words to all heads above; those are read off the conversation with
    the head's smallest id."""
    paths = F.expr("transform(sequence(0, depth - 1), d -> if(d = 0, unhex(repeat('00', 16)), substring(keys, 16 * d - 15, 16)))")
    above = (heads.filter("depth > 0").select("node_key", "parent_key", "depth", "own", "conv_id").join(folded.select("conv_id", "keys"), "conv_id")
             .select("parent_key", "own", F.explode(paths).alias("node_key"))
             .select("node_key", F.lit(0).cast("bigint").alias("n_leaves"), F.col("own").alias("saved_tokens"), (F.col("node_key") == F.col("parent_key")).cast("bigint").alias("n_children")))
    below = sums.unionByName(above).groupBy("node_key").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "n_children")])
    ends = folded.select(F.col("full").alias("node_key"), "ends")
    parents = heads.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return (heads.join(below, "node_key", "left").join(ends, "node_key", "left").join(parents, "parent_key", "left").select(
        "node_key", "parent_key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), (F.col("own") + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends", F.lit(ENDS_OF_NONE)).alias("ends_sha256")))


def trie(convs: DataFrame, limit: int = CONTAINER_TURNS) -> DataFrame:
    """One row for each node of the prefix trie of ``convs`` (conv_id, turns as array of (id, words); ids unique): node_key and
    parent_key (null for the root), and the columns of the contract."""
    spark = convs.sparkSession
    folded = save(_folded(_chained(convs)), "trie-sequences")
    root = folded.agg(F.sum(F.octet_length("keys")).alias("bytes"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    turns = (root.first()["bytes"] or 0) // 16
    table, keys = _heads(spark, folded, turns, limit)
    root = root.filter("n_convs > 0").select(
        F.lit(ROOT).alias("node_key"), F.lit(None).cast("binary").alias("parent_key"), F.lit(0).cast("bigint").alias("depth"), "n_convs", "conv_id", F.lit(0).cast("bigint").alias("own"))
    heads = save(root if table is None else root.unionByName(table), "trie-all-heads")
    swept = save(_swept(folded, spark.sparkContext.broadcast(keys)), "trie-nodes")
    sums = swept.filter("kind = 'sum'").select("node_key", "n_leaves", "saved_tokens", "n_children")
    nodes = save(_head_nodes(heads, folded, sums), "trie-head-nodes")
    plain = nodes.columns
    tops = swept.filter("kind = 'top'").drop("parent_conv_id", "kind")
    size = nodes.agg(F.coalesce(F.sum("n_children"), F.lit(0)).alias("n")).first()["n"]
    above = nodes.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_children"))
    tops = join_by_count(tops, above, "parent_key", "_children", size).select(*plain)
    return swept.filter("kind = 'node'").select(*plain).unionByName(tops).unionByName(nodes)


def op13(spark, sf_dir: str) -> DataFrame:
    rebuilt = grafted(turn_rows(read(spark, sf_dir, "conversations")), 20, 4)
    return trie(rebuilt).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP13_SQL = rf"""
with crc as ({SQL_TABLE}),
t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
      sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) as id, row_number() over (partition by conv_id
      order by turn nulls first, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos from conversations where conv_id is not null),
c as (select conv_id, {SQL_CRC} % 4 as h from (select distinct conv_id, hex(encode(cast(conv_id as varchar))) as h from t), crc),
r as (select c.conv_id, 0 as own, pos, id, text from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and pos <= h
      union all select c.conv_id, 1, pos, id, text from c join t on t.conv_id = c.conv_id and pos > h),
p as (select conv_id, row_number() over w as depth, sha256(string_agg(id, '/') over w) as key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
      from r window w as (partition by conv_id order by own, pos)),
m as (select conv_id, depth, key, words from p union all select conv_id, 0, '', 0 from c),
up as (select m.key, m.depth, coalesce(a.key, '') as parent from m left join m a on a.conv_id = m.conv_id and a.depth = m.depth - 1 where m.depth > 0 group by all),
n as (select key, depth, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words from m group by 1, 2),
k as (select parent as key, count(*) as n_children from up group by 1),
e as (select key, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from (select conv_id, arg_max(key, depth) as key from m group by 1) group by 1),
full_node as (select n.*, coalesce(n_children, 0) as n_children, coalesce(ids, '') as ids from n left join k using (key) left join e using (key)),
below as (select a.key, count(*) filter (x.n_children = 0) as n_leaves, sum((x.n_convs - 1) * x.words) as saved
          from full_node x join m on m.conv_id = x.conv_id and m.depth <= x.depth join n a on a.key = m.key group by 1)
select f.conv_id, f.depth, q.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, cast(saved as bigint) as saved_tokens, sha256(f.ids) as ends_sha256
from full_node f join below using (key) left join up on up.key = f.key left join n q on q.key = up.parent
"""

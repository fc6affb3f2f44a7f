"""Byte-level BPE by a global shuffle of distinct words.

Reading tasks cut texts into pre-tokens and number the distinct ones of a block of documents; the documents
become lists of these numbers, one for each position, in a file of the block. Only the blocks' distinct words are
shuffled, by word, so that equal words of all blocks meet; each is encoded once and its ids go back to the blocks
that asked. A block then puts the ids in the places of the words. Decoding joins ids with the table of token
bytes, which is as large as the vocabulary and so is sent to every task.

A frequent word travels once for each block, whatever its number of occurrences. A task holds one block, or the
words of one bucket up to a bound.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentflow.llm.common import give_back, pieces, read, run_folder, save, text_bytes
from contentflow.llm.files import new_name, open_folder
from contentflow.llm.pretokens import distinct, pretokens, spread

BLOCK_BYTES = 16 << 20  # text of a block; a longer text is a block of its own
WORDS_KEPT = 200_000  # words whose ids a task remembers while it encodes a bucket

WORDS = "block string, bucket int, words binary"
IDS = "id bigint, ids array<int>"


# ---- vocabulary ----------------------------------------------------------------------------


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _share_ranks(spark: SparkSession, path: str):
    """The rank file's table for all tasks; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast(load_ranks(path))


def _encoder(shared, pattern: str):
    import tiktoken

    return tiktoken.Encoding("shared ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})


# ---- packed lists --------------------------------------------------------------------------


def _pack(lists: bytes, sizes: np.ndarray) -> bytes:
    raw = len(sizes).to_bytes(8, "little") + np.asarray(sizes, np.uint32).tobytes() + lists
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[bytes, np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    return raw[8 + 4 * n:], np.frombuffer(raw[8: 8 + 4 * n], np.uint32).astype(np.int64)


# ---- blocks --------------------------------------------------------------------------------


class _Block:
    """Documents as word numbers, and the distinct words in order of their first place."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, batch: pa.RecordBatch) -> None:
        data, off = text_bytes(batch.column("text"))
        cuts, before = pretokens(data, off)
        words, index = distinct(data, cuts)
        number = np.array([self.words.setdefault(w, len(self.words)) for w in words], np.int64)
        self.parts.append((batch.column("id"), before, number[index] if len(words) else index))
        self.bytes += len(data)

    def close(self, system, folder: str, buckets: int) -> pa.RecordBatch:
        """Writes the positions and returns the words by bucket. Word o of bucket b has the number
        o * buckets + b; the most frequent words of a bucket come first, so most numbers are small."""
        words = list(self.words)
        bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
        often = np.zeros(len(words), np.int64)
        for _, _, index in self.parts:
            often += np.bincount(index, minlength=len(words))
        order = np.lexsort((-often, bucket))
        counts = np.bincount(bucket, minlength=buckets)
        first = np.cumsum(counts) - counts
        number = np.empty(len(words), np.int64)
        number[order] = (np.arange(len(words)) - first[bucket[order]]) * buckets + bucket[order]
        name = f"{folder}/{new_name('block', '.arrow')}"
        kind = pa.schema([("id", pa.int64()), ("positions", pa.binary())])
        with system.open_output_stream(name) as out, pa.ipc.new_stream(out, kind, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            for ids, before, index in self.parts:
                raw = number[index].astype(np.uint32) if len(words) else index.astype(np.uint32)
                lists = [raw[a:b].tobytes() for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
                to.write_batch(pa.record_batch([ids, pa.array(lists, pa.binary())], schema=kind))
        packed = []
        used = np.flatnonzero(counts).tolist() or [0]  # a block without words is still named once
        for b in used:
            mine = [words[i] for i in order[first[b]: first[b] + counts[b]].tolist()]
            packed.append(_pack(b"".join(mine), np.array([len(w) for w in mine], np.uint32)))
        return pa.record_batch({"block": [name] * len(used), "bucket": pa.array(used, pa.int32()), "words": pa.array(packed, pa.binary())})


def cut_blocks(rows: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Writes a file of positions for each block of rows (id, text); returns the blocks' words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        block = None
        for batch in pieces(batches, "text"):
            block = block or _Block()
            block.add(batch)
            if block.bytes >= BLOCK_BYTES:
                yield block.close(system, path, buckets)
                block = None
        if block:
            yield block.close(system, path, buckets)

    return save(rows.mapInArrow(run, WORDS), "bpe-words")


def encode_buckets(words: DataFrame, shared, pattern: str, buckets: int) -> DataFrame:
    """Ids of the words of each (block, bucket), in their order; a distinct word of a bucket is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = _encoder(shared, pattern), {}
        for batch in batches:
            out = []
            for blob in batch.column("words").to_pylist():
                raw, sizes = _unpack(blob)
                stops = np.cumsum(sizes)
                found = []
                for a, b in zip((stops - sizes).tolist(), stops.tolist()):
                    word = raw[a:b]
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= WORDS_KEPT:
                            known.clear()
                        ids = known[word] = array("I", encoder.encode_ordinary(word.decode())).tobytes()
                    found.append(ids)
                out.append(_pack(b"".join(found), np.array([len(f) // 4 for f in found], np.uint32)))
            yield pa.record_batch([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "words"])
        del encoder, known
        give_back()

    return words.repartition(buckets, "bucket").mapInArrow(run, WORDS)


def fill_blocks(ids: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Puts the ids of the words in the places that the block's file has for them."""

    def run(table: pa.Table) -> pa.Table:
        lists, sizes, first = [], [], np.zeros(buckets, np.int64)
        total = 0
        for b, blob in sorted(zip(table["bucket"].to_pylist(), table["words"].to_pylist())):
            raw, n = _unpack(blob)
            first[b] = total
            total += len(n)
            lists.append(np.frombuffer(raw, np.uint32))
            sizes.append(n)
        flat, sizes = np.concatenate(lists).astype(np.int32), np.concatenate(sizes)
        system, _ = open_folder(folder)
        out = []
        with system.open_input_stream(table["block"][0].as_py()) as file:
            for batch in pa.ipc.open_stream(file):
                raw = [np.frombuffer(x, np.uint32).astype(np.int64) for x in batch.column("positions").to_pylist()]
                number = np.concatenate(raw)
                index = first[number % buckets] + number // buckets
                tokens = spread(flat, sizes, index)
                reached = np.append(0, np.cumsum(sizes[index]))[np.append(0, np.cumsum([len(x) for x in raw]))]
                out.append(pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(pa.array(reached.astype(np.int32)), pa.array(tokens))], names=["id", "ids"]))
        del lists, flat, sizes
        give_back()
        return pa.Table.from_batches(out)

    return ids.groupBy("block").applyInArrow(run, IDS)


# ---- operator ------------------------------------------------------------------------------


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, ids) for each document. Null and empty texts have no ids; null and repeated ids are kept as
    they are, row by row; strings of special tokens are ordinary text. Other columns are not read."""
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    folder = run_folder(spark, "bpe-blocks")
    words = cut_blocks(rows, folder, buckets)
    return fill_blocks(encode_buckets(words, _share_ranks(spark, ranks_path), pattern, buckets), folder, buckets)


OUT_ROWS = 256  # rows of a decoded batch


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Replaces ``ids`` by ``decoded``, the bytes of the ids: every id is looked up in the token-byte table. All other
    columns are kept."""
    shared = _share_ranks(encoded.sparkSession, ranks_path)
    kept = [c for c in encoded.columns if c != "ids"]
    kinds = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = sorted((rank, token) for token, rank in shared.value.items())
        sizes = np.zeros(by_rank[-1][0] + 1, np.int64)
        sizes[[r for r, _ in by_rank]] = [len(t) for _, t in by_rank]
        flat = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                lists = part.column("ids")
                stops, values = np.asarray(lists.offsets), np.asarray(lists.values)
                texts = [spread(flat, sizes, values[a:b]).tobytes() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(texts, pa.binary())], names=[*kept, "decoded"])
        give_back()

    return encoded.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in kept] + ["decoded binary"]))


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Number and digest of the ids, and digest of what they decode to."""
    numbers = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    told = encoded.select("id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"))
    return decode(told, ranks_path).select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    return digests(encode(read(spark, sf_dir, "documents"), path, P.PATTERN), path)

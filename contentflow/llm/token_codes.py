"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id, and a continuation bit that
says whether the id goes on; level 1 holds the next chunk of those that do, and so on. The place of an id on the
next level is the number of continuation bits before it, which a directory with one count for each 512 bits
and the bits of one block give. So any token is read with one chunk and one bitmap block a level, and no other
token is decoded.

Layout of a file, little endian: ``DAC1``, header length (4 bytes), JSON header with the length of every
section, then the sections: document ids (8 bytes), null marks of the ids (1), document lengths (8), and for each
level chunks (1), bitmap (bits from the lowest) and directory (8). Files hold whole documents in ascending id order.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentflow.llm.common import pieces, read, run_folder, save, text_bytes
from contentflow.llm.files import new_name, open_folder
from contentflow.llm.pretokens import distinct, pretokens, spread
from contentflow.llm.sharding import splitters
from contentflow.session import shared_folder

BLOCK_BITS = 512
END_ID = 2
FILE_TOKENS = 8 << 20  # a file is closed after so many tokens
RANGE_BYTES = 512 << 20  # text of one writing task, about
LAST = (1 << 63) - 1  # place of null ids: after all others


# ---- format --------------------------------------------------------------------------------


def encode_levels(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(chunks, bitmap, directory) of each level of unsigned 32-bit ids."""
    levels, left = [], np.asarray(ids, np.uint32)
    while len(left):
        more = left >> np.uint32(8)
        goes_on = more > 0
        counts = np.add.reduceat(goes_on.astype(np.int64), np.arange(0, len(left), BLOCK_BITS))
        levels.append(((left & np.uint32(255)).astype(np.uint8).tobytes(), np.packbits(goes_on, bitorder="little").tobytes(),
                       (np.cumsum(counts) - counts).tobytes()))
        left = more[goes_on]
    return levels


def file_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    null = np.array([d is None for d in doc_ids], np.uint8)
    sections = [np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes(), null.tobytes(),
                np.asarray(lengths, np.int64).tobytes(), *[part for level in encode_levels(ids) for part in level]]
    header = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "sections": [len(s) for s in sections]}).encode()
    return b"".join([b"DAC1", len(header).to_bytes(4, "little"), header, *sections])


class CodeFile:
    """Reads one file through an open random-access file."""

    def __init__(self, file):
        self.file = file
        if file.read_at(4, 0) != b"DAC1":
            raise ValueError("not a file of directly addressable codes")
        size = int.from_bytes(file.read_at(4, 4), "little")
        self.header = json.loads(file.read_at(size, 8))
        sizes = self.header["sections"]
        at = np.cumsum([8 + size, *sizes])
        self.sections = list(zip(at.tolist(), sizes))

    def _section(self, k: int) -> bytes:
        at, size = self.sections[k]
        return self.file.read_at(size, at)

    def documents(self) -> tuple[list, np.ndarray]:
        """Ids and lengths of the documents."""
        ids, null = np.frombuffer(self._section(0), np.int64).tolist(), self._section(1)
        return [None if z else d for d, z in zip(ids, null)], np.frombuffer(self._section(2), np.int64)

    def token(self, place: int) -> int:
        """The token at ``place`` in the file; reads one chunk and one bitmap block of each of its levels."""
        if not 0 <= place < self.header["tokens"]:
            raise IndexError(place)
        value, shift = 0, 0
        for k in range(3, len(self.sections), 3):
            (chunks, _), (bits, bits_size), (ranks, _) = self.sections[k: k + 3]
            value |= self.file.read_at(1, chunks + place)[0] << shift
            block = place // BLOCK_BITS
            here = self.file.read_at(min(BLOCK_BITS // 8, bits_size - block * BLOCK_BITS // 8), bits + block * BLOCK_BITS // 8)
            word, inside = int.from_bytes(here, "little"), place % BLOCK_BITS
            if not word >> inside & 1:
                return value
            before = int.from_bytes(self.file.read_at(8, ranks + 8 * block), "little")
            place, shift = before + (word & ((1 << inside) - 1)).bit_count(), shift + 8
        raise ValueError("continuation bit on the last level")

    def tokens(self) -> np.ndarray:
        """All tokens of the file in order."""
        levels = [(np.frombuffer(self._section(k), np.uint8), self._section(k + 1)) for k in range(3, len(self.sections), 3)]
        if not levels:
            return np.zeros(0, np.uint32)
        out = None
        for chunks, bits in reversed(levels):
            value = chunks.astype(np.uint32)
            if out is not None:
                goes_on = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(chunks), bitorder="little").astype(bool)
                value[goes_on] |= out << np.uint32(8)
            out = value
        return out


# ---- tokens --------------------------------------------------------------------------------

WORDS_KEPT = 400_000  # distinct pre-tokens whose ids a worker remembers; those of one piece of text may come on top
TEXT_BYTES = 4 << 20  # text whose pre-tokens are made distinct at a time
_tokenizers: dict = {}


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write the 256 bytes with. Printable bytes stand for themselves,
    all others for the letters from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


LETTERS = _byte_letters()


def _tokenizer(definition: str):
    key = zlib.crc32(definition.encode())
    if key not in _tokenizers:
        from tokenizers import Tokenizer, models, pre_tokenizers

        model = Tokenizer.from_str(definition)
        if model.normalizer is not None or not isinstance(model.pre_tokenizer, pre_tokenizers.ByteLevel) or not isinstance(model.model, models.BPE):
            raise ValueError("not a byte-level BPE tokenizer")
        _tokenizers[key] = (model.model, {})
    return _tokenizers[key]


def encode_words(words: list[bytes], definition: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pre-tokens end to end, and how many each has. A pre-token is merged by the tokenizer's model once while
    remembered; strings of special tokens never reach it whole, so they are ordinary text."""
    model, known = _tokenizer(definition)
    if len(known) >= WORDS_KEPT:
        known.clear()
    found = []
    for w in words:
        ids = known.get(w)
        if ids is None:
            ids = known[w] = array("I", [t.id for t in model.tokenize(w.decode("latin-1").translate(LETTERS))]).tobytes()
        found.append(ids)
    return np.frombuffer(b"".join(found), np.uint32), np.array([len(f) >> 2 for f in found], np.int64)


def encode_texts(texts: pa.Array, definition: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and how many each has."""
    data, off = text_bytes(texts)
    cuts, before = pretokens(data, off)
    words, index = distinct(data, cuts)
    lists, sizes = encode_words(words, definition)
    reached = np.append(0, np.cumsum(sizes[index]))
    return spread(lists, sizes, index), np.diff(reached[before])


# ---- operator ------------------------------------------------------------------------------

MANIFEST = "range int, part int, file string, docs bigint, tokens bigint"


def write_codes(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encodes the documents, writes the files and returns their manifest (range, part, file, docs, tokens) in
    file order. Documents are cut into ranges of the id by sampled splitters and sorted inside a range; each
    gets ``end_id`` appended. Null text is empty; null ids come last; rows that repeat an id stay neighbours."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("key"),
                       F.monotonically_increasing_id().alias("uid"), F.col(text_col).cast("string").alias("text"))
    sizes = save(rows.select("key", "uid", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("bigint").alias("size")), "code-sizes")
    total = sizes.agg(F.sum("size").alias("b")).first()["b"] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    bounds, _ = splitters(sizes, ranges)
    folder = run_folder(spark, "token-codes")
    with open(tokenizer, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())  # a few MB, whatever the documents

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        now, part, doc_ids, lengths, ids, held = None, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            tokens = np.concatenate(ids)
            name = f"{path}/{new_name(f'range-{now:08d}-{part:06d}', '.dac')}"
            with system.open_output_stream(name) as out:
                out.write(file_bytes(doc_ids, np.concatenate(lengths), tokens))
            return pa.record_batch({"range": pa.array([now], pa.int32()), "part": pa.array([part], pa.int32()), "file": [name],
                                    "docs": [len(doc_ids)], "tokens": [len(tokens)]})

        for batch in pieces(batches, "text", TEXT_BYTES):
            numbers = batch.column("range").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges[:-1], edges[1:]):
                if doc_ids and (numbers[a] != now or held >= FILE_TOKENS):
                    yield close()
                    part, doc_ids, lengths, ids, held = part + 1, [], [], [], 0
                if numbers[a] != now:
                    now, part = int(numbers[a]), 0
                run = batch.slice(a, b - a)
                tokens, sizes_ = encode_texts(run.column("text"), shared.value)
                stops = np.cumsum(sizes_)
                ids.append(np.insert(tokens, stops, end_id).astype(np.uint32))
                lengths.append(sizes_ + 1)
                doc_ids += run.column("id").to_pylist()
                held += len(ids[-1])
        if doc_ids:
            yield close()

    placed = rows.withColumn("range", bounds.column("key", "uid")).repartitionById(len(bounds) + 1, F.col("range"))
    written = placed.sortWithinPartitions("range", "key", "uid").select("range", "id", "text").mapInArrow(write, MANIFEST)
    return save(written, "code-manifest")


TOKENS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_codes(manifest: DataFrame, folder: str | None = None) -> DataFrame:
    """One row for each document from the files: doc_id, start (tokens of all documents before it), n_tokens,
    ids_crc32 of the ids as little-endian unsigned 32-bit integers."""
    spark = manifest.sparkSession
    root = folder or shared_folder(spark)
    earlier = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # one small row a file
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(root)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with system.open_input_file(name) as file:
                    code = CodeFile(file)
                    doc_ids, lengths = code.documents()
                    ids = code.tokens().astype("<u4")
                stops = np.cumsum(lengths)
                starts = stops - lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]
                yield pa.record_batch({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts + base),
                                       "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())})

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(tasks, "file").mapInArrow(load, TOKENS)


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_codes(write_codes(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))

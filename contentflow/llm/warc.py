"""WARC archives: writing, normalising monolithic gzip, reading by offset.

A whole-file gzip stream can only be read from its start. The normaliser inflates such a stream once, finds the
records by their headers and Content-Length, writes each as a gzip member of its own and notes offset and
length in a sidecar index, so that any record can then be read alone. All of it streams: a task holds one
chunk, never a record.

Files are named anew by each attempt and reported in manifests; only reported files are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.llm.common import join_by_count, pieces, read, run_folder, save
from contentflow.llm.files import new_name, open_folder
from contentflow.session import shared_folder

CHUNK = 1 << 20
ARCHIVE_BYTES = 256 << 20  # payload after which a writing task opens the next archive
GZIP = 31  # zlib window bits for gzip framing
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- records -------------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    """Page id in a record id; None if there is none."""
    digits = (value or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def _safe(url: str) -> str:
    """A header value: white space and control characters are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; the block of a revisit is the HTTP header alone, with the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"WARC-Target-URI: {_safe(url)}"] if url else []
    lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Fields of a header block, names in lower case; the first line is under the empty name."""
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    return {"": first} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest if x)}


# ---- gzip streams --------------------------------------------------------------------------


def inflate(source) -> Iterator[bytes]:
    """Inflated chunks of a gzip stream of one or many members; a stream that breaks off raises."""
    engine, raw = zlib.decompressobj(GZIP), b""
    started = False
    while True:
        raw = raw or source.read(CHUNK)
        if not raw:
            break
        if engine.eof:
            engine = zlib.decompressobj(GZIP)
        started = True
        out = engine.decompress(raw, CHUNK)
        raw = engine.unused_data if engine.eof else engine.unconsumed_tail
        if out:
            yield out
    if started and not engine.eof:
        raise EOFError("gzip stream ends inside a member")


class _Stream:
    """Reads an inflated stream by lines and by lengths, with one chunk of look-ahead."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.held += chunk
        return True

    def head(self) -> bytes | None:
        """Bytes up to the empty line that ends a header block; None at the end of the stream."""
        while True:
            self.held = self.held.lstrip(b"\r\n")  # the empty lines after the last record
            stop = self.held.find(b"\r\n\r\n")
            if stop >= 0:
                head, self.held = self.held[:stop], self.held[stop + 4:]
                return head
            if not self._more():
                if self.held:
                    raise EOFError("archive ends inside a header")
                return None

    def body(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self._more():
                raise EOFError("archive ends inside a record")
            part, self.held = self.held[:size], self.held[size:]
            size -= len(part)
            yield part


def normalise(source, target) -> Iterator[dict]:
    """Copies a monolithic archive record by record into gzip members; yields one index entry for each."""
    stream, offset = _Stream(inflate(source)), 0
    while (head := stream.head()) is not None:
        fields = headers(head)
        size = int(fields["content-length"])
        engine, length = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0
        for part in chain([head + b"\r\n\r\n"], stream.body(size), [b"\r\n\r\n", None]):
            packed = engine.flush() if part is None else engine.compress(part)
            target.write(packed)
            length += len(packed)
        yield {"offset": offset, "length": length, "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri")}
        offset += length


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of the record in one member."""
    raw = zlib.decompress(file.read_at(length, offset), GZIP)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = headers(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, headers(http), payload


# ---- jobs ----------------------------------------------------------------------------------

ARCHIVES = "archive string, records bigint"
NORMALISED = "archive string, index string, records bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, revisit_from: int) -> DataFrame:
    """Pages as (page_id, url, html, target, revisit): target is the page whose response the row revisits.

    Of rows with the same payload of at least ``revisit_from`` bytes those with the largest id (nulls first) are
    the response. Only ids and digests are grouped; the htmls are joined with the revisits by (id, digest), a key
    that different pages never share."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    names = save(rows.select("page_id", "sha", F.octet_length("html").alias("size")).filter(F.col("size") >= revisit_from), "page-digests")
    groups = names.groupBy("sha").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n"))
    groups = save(groups.filter("n > 1"), "page-groups")
    key = F.concat("sha", F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("key")
    repeats = join_by_count(names, groups, "sha", "n", names.count()).filter(~F.col("page_id").eqNullSafe(F.col("target")))
    repeats = save(repeats.select(key, "target", F.lit(True).alias("revisit")).distinct(), "page-revisits")
    return rows.withColumn("key", key).join(repeats, "key", "left")


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html, target, revisit) as archives that are one gzip stream each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        out = engine = name = None
        held = count = 0

        def close() -> pa.RecordBatch:
            out.write(engine.flush())
            out.close()
            return pa.record_batch({"archive": [name], "records": [count]})

        for batch in pieces(batches, "html"):
            for row in batch.to_pylist():
                if out is None:
                    name, engine, held, count = f"{path}/{new_name('whole', '.warc.gz')}", zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0, 0
                    out = system.open_output_stream(name, compression=None)
                payload = row["html"].encode()
                out.write(engine.compress(record(row["page_id"], row["url"], payload, payload_digest(payload), row["target"], bool(row["revisit"]))))
                held, count = held + len(payload), count + 1
                if held >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return save(pages.select("page_id", "url", "html", "target", "revisit").mapInArrow(run, ARCHIVES), "warc-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    """One archive a task where there are enough tasks; the manifest itself is one small row for each."""
    spark = manifest.sparkSession
    return manifest.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive")


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites every archive of the manifest with a member for each record, and writes its index beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                name, count = f"{path}/{new_name('records', '.warc.gz')}", 0
                with (system.open_input_stream(source, compression=None) as whole, system.open_output_stream(name, compression=None) as members,
                      system.open_output_stream(f"{name}.index", compression=None) as index):
                    for entry in normalise(whole, members):
                        index.write(json.dumps(entry).encode() + b"\n")
                        count += 1
                yield pa.record_batch({"archive": [name], "index": [f"{name}.index"], "records": [count]})

    return save(_spread(manifest).mapInArrow(run, NORMALISED), "warc-normalised")


def read_records(manifest: DataFrame) -> DataFrame:
    """One row for each record, read member by member through the sidecar indexes."""
    root = shared_folder(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(root)
        for batch in batches:
            for name, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist()):
                rows: list[dict] = []
                with system.open_input_file(name) as file, system.open_input_stream(index, compression=None) as lines:
                    for line in _lines(lines):
                        entry = json.loads(line)
                        fields, http, payload = read_member(file, entry["offset"], entry["length"])
                        revisit = fields["warc-type"] == "revisit"
                        digest = fields["warc-payload-digest"].removeprefix("sha1:") if revisit else payload_digest(payload)
                        rows.append({"page_id": page_of(fields["warc-record-id"]), "payload_bytes": int(http["content-length"]) if revisit else len(payload),
                                     "payload_digest": digest, "record_type": fields["warc-type"],
                                     "refers_to": page_of(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri")})
                        if len(rows) == 5000:
                            yield _records(rows)
                            rows = []
                if rows:
                    yield _records(rows)

    return _spread(manifest).mapInArrow(run, RECORDS)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(CHUNK):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole


def _records(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 0) -> DataFrame:
    """Writes the pages as monolithic archives, normalises these and returns the manifest of the normalised ones.

    A null html is an empty payload; a null url leaves the target out; a null id gives a record id without digits.
    Rows that repeat both an id and its payload are of one type. An empty table gives no archives."""
    folder = run_folder(pages.sparkSession, "warc")
    placed = with_revisits(pages, id_col, url_col, html_col, revisit_from)
    return normalise_archives(write_monolithic(placed, folder), folder)


def op6(spark, sf_dir: str) -> DataFrame:
    return read_records(archive(read(spark, sf_dir, "pages"))).drop("url")


OP6_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha1(b) as sha from p),
bits as (select *, max(page_id) over (partition by sha) as target from d),
x as (select *, list_reduce(list_transform(range(0, 4), lambda k: list_reduce(list_transform(range(0, 8), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(sha, 1 + 10 * k, 10) as bigint) >> (35 - 5 * j)) & 31 as integer), 1)),
        lambda a, b: a || b)), lambda a, b: a || b) as payload_digest from bits)
select page_id, payload_bytes, payload_digest, case when page_id = target then 'response' else 'revisit' end as record_type,
       case when page_id = target then null else target end as refers_to from x
"""

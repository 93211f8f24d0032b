"""WARC archives as a Spark data source: written record by record, read back in splits (operator 11).

``write_archives`` writes one record per row: a response with the payload, or, where an equal payload has a smaller id, a
revisit that refers to that record and keeps only the HTTP headers. Every record is a gzip member of its own; each task
writes its own files, and a manifest names the files of tasks that were committed, so a lost or repeated task leaves no record twice.

``read_archives`` splits files of any size into byte ranges, one task each. A task scans its range for the gzip magic,
validates each candidate by decoding it (it must be a whole gzip member with a right checksum, start as a WARC record and
be as long as its headers say), and owns the records that start inside its range, reading past its end for the last one.
Bytes inside a member that look like magic are never tried, as a task goes on behind each member; only at the front of a range
can a candidate lie inside a record (an archive stored in an archive). So the members of each file must fill it without gap
or overlap. That is counted for all files, and files for which it fails are read again in one range, from their first byte;
what still doesn't fit is an error that names the file.

Null payloads are empty; payloads of any length are held one at a time. Of equal payloads of ``min_bytes`` bytes or more the
smallest id is the response; rows that repeat the smallest id are responses each. Null ids revisit another record but are
never referred to; a group of null ids only are responses. Line breaks in a URL are percent-encoded; a null URL stays null.
An empty table gives an archive of no records. Columns other than the three named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tabwright.llm.common import bounded_batches, shared_folder, shared_table

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, of a file before the task starts the next one, of a read, of a batch of records.
RANGE, FILE, READ, BATCH = 64 << 20, 1 << 30, 1 << 16, 8 << 20
#: A range that holds any file whole.
WHOLE = 1 << 62
#: Payloads with copies whose digests may be broadcast: about 60 bytes each.
FEW = 200_000
MANIFEST = "_files"
DATE = "1970-01-01T00:00:00Z"
FIELDS = "file string, file_bytes long, offset long, stored_bytes long, record_type string, id string, url string, payload_digest string, payload_bytes long, refers_to string"


# ---------------------------------------------------------------- records

def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(key: str | None, digest: str) -> str:
    return f"<urn:record::{digest}>" if key is None else f"<urn:record:{quote(key, safe='')}.:{digest}>"


def key_of(record: str | None) -> str | None:
    """The id inside a record id of ours."""
    found = re.fullmatch(r"<urn:record:(.*)\.:[A-Z2-7]+>", record or "")
    return unquote(found[1]) if found else None


def encode_record(kind: str, block: bytes, headers: list[tuple[str, str]], level: int = 6) -> bytes:
    """One record as a gzip member."""
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in lines) + "\r\n"
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(key: str | None, url: str | None, payload: bytes, digest: str, low: str | None, date: str = DATE) -> bytes:
    """A response, or with ``low`` a revisit of that id's record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if low is None:
        return encode_record("response", http + payload, headers)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return encode_record("revisit", http, [*headers, ("WARC-Profile", profile), ("WARC-Refers-To", record_id(low, digest))])


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (lower-case names) and block of one record, or None if the bytes are no whole record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        return None
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    return headers, rest[:-4]


def described(headers: dict[str, str], block: bytes, check: bool = True) -> tuple[dict, bytes]:
    """Columns and payload of a record; a response must carry the digest of its payload (``check``: which is computed)."""
    kind = headers.get("warc-type")
    row = {"record_type": kind, "id": key_of(headers.get("warc-record-id")), "url": headers.get("warc-target-uri"), "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": None, "refers_to": key_of(headers.get("warc-refers-to"))}
    if not check or not headers.get("content-type", "").startswith("application/http"):
        return row, block
    http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        said = re.search(rb"(?mi)^content-length:\s*(\d+)", http)
        row["payload_bytes"] = int(said[1]) if said else None
        return row, b""
    digest = base32(hashlib.sha1(payload).digest())
    if row["payload_digest"] not in (None, digest):
        raise ValueError(f"payload of {headers.get('warc-record-id')} has another digest than its header says")
    return row | {"payload_digest": digest, "payload_bytes": len(payload)}, payload


# ---------------------------------------------------------------- byte ranges

class Window:
    """Bytes of a file around a moving place."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.base, self.data = handle, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if at < self.base or at + n > self.base + len(self.data):
            self.handle.seek(at)
            self.base, self.data = at, self.handle.read(max(n, 16 * READ))
        return self.data[at - self.base : at - self.base + n]


def next_magic(window: Window, at: int, end: int) -> int | None:
    """The first place from ``at`` and before ``end`` where a gzip member may start."""
    while at < end:
        piece = window.get(at, min(READ, end - at) + len(MAGIC) - 1)
        found = piece.find(MAGIC)
        if found >= 0:
            return at + found
        at += READ
    return None


def decode_member(window: Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record in the member that starts here and the place behind it; None if none does."""
    unpack, out, place, checked = zlib.decompressobj(31), [], at, False
    try:
        while not unpack.eof:
            piece = window.get(place, READ // 4 if place == at else READ)
            if not piece:
                return None
            out.append(unpack.decompress(piece))
            place += len(piece)
            if not checked and sum(map(len, out)) >= 5:
                checked = True
                if not b"".join(out)[:5] == b"WARC/":
                    return None
    except zlib.error:
        return None
    record = parse_record(b"".join(out))
    return None if record is None else (*record, place - len(unpack.unused_data))


def records_in(handle, size: int, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, stored bytes, headers, block) of the records that start in [start, end)."""
    window, at = Window(handle, size), start
    while (at := next_magic(window, at, end)) is not None:
        record = decode_member(window, at)
        if record is None:
            at += 1
            continue
        headers, block, behind = record
        yield at, behind - at, headers, block
        at = behind


# ---------------------------------------------------------------- data source

@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class ByteRange(InputPartition):
    file: str
    size: int
    start: int
    end: int


class WarcSource(DataSource):
    """``format("warc")``. Write: columns id, url, payload, digest (hex), low. Read: FIELDS, and payload if the option of that name is true.

    Options: ``range_bytes`` of a task, ``files`` (JSON list of names: only those), ``check`` (false: payloads and digests are not looked at).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return FIELDS + (", payload binary" if self.options.get("payload", "true") == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only added: write to a new folder")
        return WarcWriter(self.options)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder, self.date = options["path"], options.get("date", DATE)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = pafs.FileSystem.from_uri(self.folder)
        store.create_dir(folder, recursive=True)
        part, files, out = TaskContext.get().partitionId(), [], None
        try:
            for batch in iterator:
                columns = [batch.column(k) for k in range(5)]
                for k in range(batch.num_rows):
                    key, url, payload, digest, low = (c[k].as_py() for c in columns)
                    if out is None or out.tell() >= FILE:
                        if out is not None:
                            out.close()
                        files.append(f"part-{part:05d}-{len(files):03d}-{uuid.uuid4().hex}.warc.gz")
                        out = store.open_output_stream(f"{folder}/{files[-1]}", compression=None)
                        out.write(encode_record("warcinfo", b"software: tabwright\r\nformat: WARC File Format 1.1\r\n", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", files[-1]), ("Content-Type", "application/warc-fields")]))
                    out.write(page_record(key, url, payload or b"", base32(bytes.fromhex(digest)), low, self.date))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = pafs.FileSystem.from_uri(self.folder)
        store.create_dir(folder, recursive=True)
        names = [name for message in messages if message is not None for name in message.files]
        with store.open_output_stream(f"{folder}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = pafs.FileSystem.from_uri(self.folder)
        for name in (name for message in messages if message is not None for name in message.files):
            store.delete_file(f"{folder}/{name}")


def archive_files(path: str) -> list[tuple[str, int]]:
    """Files of a folder with their sizes: those of its manifests, or without any, all whose name ends in .warc.gz."""
    store, folder = pafs.FileSystem.from_uri(path)
    found = {f.base_name: f for f in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.type == pafs.FileType.File}
    manifests = [f for name, f in found.items() if name.startswith(MANIFEST)]
    names = [n for n in found if n.endswith(".warc.gz")]
    if manifests:
        names = []
        for f in manifests:
            with store.open_input_stream(f.path, compression=None) as text:
                names += json.loads(text.read())
    return [(name, found[name].size) for name in sorted(names)]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.payload, self.check = options["path"], options.get("payload", "true") == "true", options.get("check", "true") == "true"
        self.step = int(options.get("range_bytes", RANGE))
        self.only = set(json.loads(options["files"])) if "files" in options else None

    def partitions(self) -> list[ByteRange]:
        files = [(name, size) for name, size in archive_files(self.folder) if self.only is None or name in self.only]
        return [ByteRange(name, size, at, min(at + self.step, size)) for name, size in files for at in range(0, size, self.step)] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        store, folder = pafs.FileSystem.from_uri(self.folder)
        rows, held = [], 0
        with store.open_input_file(f"{folder}/{partition.file}") as handle:
            for offset, stored, headers, block in records_in(handle, partition.size, partition.start, partition.end):
                row, payload = described(headers, block, self.check)
                row |= {"file": partition.file, "file_bytes": partition.size, "offset": offset, "stored_bytes": stored} | ({"payload": payload} if self.payload else {})
                rows.append(row)
                held += 300 + (len(payload) if self.payload else 0)
                if held >= BATCH:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = [(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (f.split() for f in FIELDS.split(", "))]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([*kinds, *([("payload", pa.binary())] if self.payload else [])]))


# ---------------------------------------------------------------- whole tables

def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", min_bytes: int = 0, date: str = DATE) -> None:
    """A record per row of ``pages`` in new files of ``folder``.

    Only ids and digests are shuffled: the most repeated payloads' digests are broadcast, others, if there are more than ``FEW``, joined.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    spark.dataSource.register(WarcSource)
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    again = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and low is not null")
    again = shared_table(again)
    if again.count() <= FEW:
        rows = rows.join(F.broadcast(again.select("digest", "low")), "digest", "left")
    else:
        least = again.orderBy(F.desc("copies"), "digest").limit(FEW).agg(F.min("copies")).first()[0]
        hot = again.where(F.col("copies") > least).select("digest", F.col("low").alias("hot_low"))  # fewer than FEW
        cold = again.where(F.col("copies") <= least).select("digest", F.col("low").alias("cold_low"))
        rows = rows.join(F.broadcast(hot), "digest", "left").join(cold, "digest", "left").withColumn("low", F.coalesce("hot_low", "cold_low"))
    revisit = F.when(~F.col("id").eqNullSafe(F.col("low")), F.col("low").cast("string"))
    rows.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", revisit.alias("low")).write.format("warc").mode("append").option("date", date).save(folder)


def read_archives(spark: SparkSession, folder: str, payload: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """(FIELDS, payload): every record of the archives in ``folder``, in tasks of ``range_bytes`` bytes each."""
    spark.dataSource.register(WarcSource)
    sizes = dict(archive_files(folder))

    def read(files: set[str] | None, step: int, check: bool = True) -> DataFrame:
        options = {"payload": str(payload and check).lower(), "range_bytes": step, "check": str(check).lower()}
        return spark.read.format("warc").options(**options, **({} if files is None else {"files": json.dumps(sorted(files))})).load(folder)

    def odd(records: DataFrame, files: set[str]) -> set[str]:
        covered = {r["file"]: r["bytes"] for r in records.groupBy("file").agg(F.sum("stored_bytes").alias("bytes")).collect()}  # a row per file
        return {name for name in files if covered.get(name, 0) != sizes[name]}

    again = odd(read(None, range_bytes, check=False), set(sizes))
    if not again:
        return read(None, range_bytes)
    if wrong := odd(read(again, WHOLE, check=False), again):
        raise ValueError(f"damaged archives: {', '.join(sorted(wrong)[:10])}")
    return read(set(sizes) - again, range_bytes).unionByName(read(again, WHOLE))


def round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", min_bytes: int = 0) -> DataFrame:
    """The page records of ``pages`` after writing them to new archives in the shared folder and reading those; without payloads."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    write_archives(pages, folder, id_column, url_column, payload_column, min_bytes)
    return read_archives(spark, folder, payload=False).where("record_type in ('response', 'revisit')")

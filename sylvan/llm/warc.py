"""WARC archives as a Spark data source, written and read in parallel.

Writing: each task writes archives of its own under temporary names, a gzip member for each record; the commit on the
driver renames those of the attempts that count, so lost or repeated tasks leave nothing that a reader sees.
Each member's gzip header names its lengths in an extra field. Reading plans one partition per archive. For each
record it inflates only the header block first, tests the pushed record-type and header predicates, and seeks past
the payload of a record that is not wanted, or of every record if the option payload is false. Members without the
extra field are inflated in pieces to find their end, so other writers' archives can be read as well.

Files are opened through pyarrow.fs by URI, so archives can lie in any store that it knows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import Scratch, sliced

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: Header names of the columns: fixed values. X-Payload-Length is our own: a revisit keeps the length of the full payload.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "refers_to": "WARC-Refers-To"}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
HEAD_BYTES = 4096


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if ":/" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri("file://" + uri[5:] if re.match("file:/[^/]", uri) else uri)


def member(head: bytes, body: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field `sl` names its compressed and its full length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    full = head + body + b"\r\n\r\n"
    deflated = packer.compress(full) + packer.flush()
    size = 24 + len(deflated) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(full) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + deflated + struct.pack("<II", zlib.crc32(full), len(full) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """One record; a response carries the payload, a revisit none."""
    payload = row["payload"] or b""
    block = HTTP + payload if row["record_type"] == "response" else HTTP
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        if row[column] is not None:
            lines.append(f"{name}: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(row[column])))
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return member("\r\n".join(lines).encode(), block)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.limit, self.overwrite, self.job = options["path"].rstrip("/"), int(options.get("maxbytes", 256 << 20)), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root)
        files, out, size = [], None, 0
        for row in (r for part in sliced(iterator) for r in part.to_pylist()):  # few payloads as objects at a time
            if out is None:
                name, size = f"{self.job}-{uuid.uuid4().hex}", 0
                out = fs.open_output_stream(f"{root}/_{name}.tmp", compression=None)
                files.append(name)
            size += out.write(data := record(row)) or len(data)
            if size >= self.limit:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        """New archives get their names first; then the old ones go where they are overwritten, and what lost attempts left."""
        fs, root = opened(self.path)
        fs.create_dir(root)
        old = archives(fs, root) if self.overwrite else []
        for name in (f for m in messages if m for f in m.files):
            fs.move(f"{root}/_{name}.tmp", f"{root}/{name}.warc.gz")
        for path in old:
            fs.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, root = opened(self.path)
        for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                fs.delete_file(f.path)


def archives(fs, root: str) -> list[str]:
    """The archives of a folder. Names that begin with _ or . are no data; any other file is an error, not passed over."""
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.type == pafs.FileType.File and f.base_name[0] not in "_.")
    if other := [f for f in found if not f.endswith((".warc.gz", ".warc"))]:
        raise ValueError(f"neither .warc nor .warc.gz: {', '.join(other[:5])}")
    return found


@dataclass
class Archive(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.tests = options["path"].rstrip("/"), options.get("payload", "true").lower() != "false", []

    def pushFilters(self, filters: list) -> Iterator:
        """Predicates on header columns are kept here; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.attribute[0] != "payload_bytes" else None
            if column and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif column and isinstance(f, IsNotNull):
                self.tests.append((column, "there", None))
            else:
                yield f

    def wanted(self, head: dict) -> bool:
        for column, how, value in self.tests:
            found = head.get(HEADERS[column].lower())
            if found is None or how == "in" and found not in value or how == "starts" and not found.startswith(value):
                return False
        return True

    def partitions(self) -> list[Archive]:
        fs, root = opened(self.path)
        return [Archive(f) for f in archives(fs, root)] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = opened(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as source:
            for head, body in (records if partition.path.endswith(".gz") else plain_records)(source, self.wanted, self.payload):
                rows.append((*[head.get(HEADERS[c].lower()) for c in HEADERS], body))
                held += len(body or b"")
                if held > 8 << 20 or len(rows) >= 5000:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = dict(zip([*HEADERS, "payload"], map(list, zip(*rows, strict=True)), strict=True))
    cols["payload_bytes"] = [int(x) if x is not None else None for x in cols["payload_bytes"]]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in cols.items()], list(cols))


def records(source, wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, payload or None) of the wanted records of an archive of gzip members."""
    size, at = source.size(), 0
    while at < size:
        source.seek(at)
        start = source.read(HEAD_BYTES)
        length, skip = _member_length(start)
        inflate = zlib.decompressobj(-15)
        block, used = bytearray(inflate.decompress(start[skip : length or None], HEAD_BYTES)), len(start)
        while b"\r\n\r\n" not in block and not inflate.eof:
            more = inflate.unconsumed_tail or source.read(HEAD_BYTES)
            used += 0 if inflate.unconsumed_tail else len(more)
            if not more:
                break
            block += inflate.decompress(more, HEAD_BYTES)
        text, _, rest = bytes(block).partition(b"\r\n\r\n")
        head = _headers(text)
        take = wanted(head)
        body = None
        if length is None or take and payload:
            parts = [rest]
            while not inflate.eof:
                more = inflate.unconsumed_tail or source.read(1 << 16)
                if not more:
                    break
                parts.append(inflate.decompress(more, 1 << 20))
            if length is None:
                length = source.tell() - len(inflate.unused_data) + 8 - at
            if take and payload:
                body = _payload(b"".join(parts)[: int(head.get("content-length", 0))])
        at += length
        if take:
            yield head, body


def _headers(text: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in text.decode("utf-8", "replace").split("\r\n")[1:])}


def _payload(content: bytes) -> bytes:
    return content.partition(b"\r\n\r\n")[2] if content.startswith(b"HTTP/") else content


def plain_records(source, wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """The same of an archive that is not compressed; unwanted payloads are not read."""
    size, at = source.size(), 0
    while at < size:
        source.seek(at)
        block = source.read(HEAD_BYTES)
        while b"\r\n\r\n" not in block and (more := source.read(HEAD_BYTES)):
            block += more
        text = block.partition(b"\r\n\r\n")[0]
        if not text.strip():
            return
        head, begin = _headers(text), at + len(text) + 4
        length = int(head.get("content-length", 0))
        if wanted(head):
            source.seek(begin)
            yield head, _payload(source.read(length)) if payload else None
        at = begin + length + 4


def _member_length(start: bytes) -> tuple[int | None, int]:
    """The member's length if its extra field names it, and where its deflated data begin."""
    flags, skip, length = start[3], 10, None
    if flags & 4:
        extra = start[12 : 12 + struct.unpack_from("<H", start, 10)[0]]
        skip = 12 + len(extra)
        while len(extra) >= 4:
            n = struct.unpack_from("<H", extra, 2)[0]
            if extra[:2] == b"sl" and n == 8:
                length = struct.unpack_from("<I", extra, 4)[0]
            extra = extra[4 + n :]
    for flag in (8, 16):
        if flags & flag:
            skip = start.index(b"\0", skip) + 1
    return length, skip + (2 if flags & 2 else 0)


class WarcDataSource(DataSource):
    """format("warc"): option path; payload=false leaves payloads undecoded; maxbytes: size at which an archive ends."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


#: Revisits up to this number are broadcast: a page_id, a digest and a page_id each.
BROADCAST_ROWS = 500_000


def page_records(pages: DataFrame, scratch: Scratch, least_bytes: int = 100) -> DataFrame:
    """The record of each page. Of equal payloads of at least least_bytes the smallest page_id is the response; the
    others revisit it. Payloads meet by digest in an aggregate with map-side combine. The revisits are written once
    and joined to the pages by broadcast while they are few, so that payloads are not moved."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    seen = p.select("page_id", "digest", F.length("payload").alias("n")).where(F.col("n") >= least_bytes)
    first = seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select(F.col("digest").alias("of"), "first")
    again = seen.join(first, (F.col("digest") == F.col("of")) & (F.col("page_id") != F.col("first"))).select(F.col("page_id").alias("again"), "of", "first").distinct()
    again = scratch.table(again, "revisits")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    p = p.join(again, (F.col("page_id") == F.col("again")) & (F.col("digest") == F.col("of")), "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return p.select(
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:none>")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"), F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"),
        urn(F.col("first")).alias("refers_to"), F.when(F.col("first").isNull(), F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back and describe each record.

    Null html is an empty payload; a null url has no target header; very long payloads are written and read whole.
    page_id is an integer. A null page_id gives a null page_id and never serves as a response that others refer to.
    A repeated page_id repeats its record, and each payload under it is judged by itself. An empty table gives no rows.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc")
    register(spark)
    path = scratch.path("archives")
    page_records(pages, scratch).write.format("warc").mode("append").save(path)
    page = lambda c: F.regexp_extract(c, r"([0-9-]+)>$", 1).try_cast("long")
    full = spark.read.format("warc").load(path).where("record_type = 'response'")
    full = full.select("record_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to"))
    rest = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'revisit'")
    rest = rest.select("record_id", "payload_bytes", F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", "refers_to")
    both = full.unionByName(rest)
    return both.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))

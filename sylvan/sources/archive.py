"""CSV members of ZIP archives as a data source of records.

A scan is planned from the archives' directories, one partition for each member, as a deflated member can only be read from
its start. A member is streamed: memory holds a block and a record. Line ends inside quotes do not end a record, and
bytes that are no UTF-8 are replaced. Parsing records into columns is left to Spark (payloads.bulk_lines).
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BLOCK = 4 << 20
#: A record beyond this many characters ends at its next line end, quotes or not; its width will be wrong.
LONGEST = 16 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def members(fs: pafs.FileSystem, root: str, ending: str) -> list[tuple[str, str]]:
    """(archive, member) of all archives of a folder, or of one."""
    info = fs.get_file_info(root)
    files = [root] if info.type == pafs.FileType.File else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".zip") and f.base_name[0] not in "_.")
    out = []
    for f in files:
        with fs.open_input_file(f) as raw, zipfile.ZipFile(raw) as z:
            out += [(f, i.filename) for i in z.infolist() if not i.is_dir() and i.filename.endswith(ending)]
    return out


def records(text: io.TextIOBase, longest: int = LONGEST) -> Iterator[str]:
    """Lines, joined while a quote is open; empty ones are none."""
    held, size, open_quote = [], 0, False
    for line in text:
        held.append(line)
        size += len(line)
        open_quote ^= line.count('"') % 2 == 1
        if not open_quote or size > longest:
            if record := "".join(held).rstrip("\r\n"):
                yield record
            held, size, open_quote = [], 0, False
    if record := "".join(held).rstrip("\r\n"):
        yield record


@dataclass
class Member(InputPartition):
    archive: str
    name: str

    def __init__(self, archive: str, name: str):
        self.archive, self.name = archive, name


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.ending = options["path"].rstrip("/"), options.get("ending", ".csv")
        self.header = options.get("header", "true").lower() != "false"

    def partitions(self) -> list[Member]:
        fs, root = opened(self.path)
        return [Member(*m) for m in members(fs, root, self.ending)] or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.archive) as raw, zipfile.ZipFile(raw) as z, z.open(partition.name) as data:
            lines, held, size = records(io.TextIOWrapper(data, encoding="utf-8", errors="replace", newline="")), [], 0
            if self.header:
                next(lines, None)
            for line in lines:
                held.append(line)
                size += len(line)
                if size >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["line"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["line"])


@dataclass
class Written(WriterCommitMessage):
    name: str


class ZipWriter(DataSourceArrowWriter):
    """One archive for each task, with one member of the lines it got below the header."""

    def __init__(self, options: dict):
        self.path, self.header, self.job = options["path"].rstrip("/"), options.get("headerline", ""), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root)
        name = f"{self.job}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{root}/_{name}.tmp", compression=None) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z, z.open("observations.csv", "w", force_zip64=True) as member:
            member.write(f"{self.header}\n".encode())
            for batch in iterator:
                for line in batch.column(0).to_pylist():
                    member.write(f"{line or ''}\n".encode())
        return Written(name)

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        for m in filter(None, messages):
            fs.move(f"{root}/_{m.name}.tmp", f"{root}/{m.name}.zip")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, root = opened(self.path)
        for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                fs.delete_file(f.path)


class ZippedCsv(DataSource):
    """format("zippedcsv"): path of an archive or of a folder of them; ending of the members; header=false keeps first lines."""

    @classmethod
    def name(cls) -> str:
        return "zippedcsv"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        if overwrite:
            raise ValueError("zippedcsv appends; overwriting is not supported")
        return ZipWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZippedCsv)

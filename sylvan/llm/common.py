"""Shared helpers: tables in the cluster's shared folder, and vectorised hashing of words inside Arrow tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or a folder of our own where that is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-sylvan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one operator run, each written once as Parquet in the shared folder and read back.

    A written table cuts lineage, survives lost executors and gives the optimiser true sizes.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/sylvan/{name}-{uuid.uuid4().hex}"
        self.made = 0
        if _temporary:
            _temporary[-1].append(self)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.sylvan_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            self._delete(t.sylvan_path)

    def drop_all(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


_temporary: list[list[Scratch]] = []


@contextmanager
def temporary():
    """Delete the tables that operators write inside, once the block has ended. Lazy frames that read them must be
    written before."""
    _temporary.append(own := [])
    try:
        yield
    finally:
        _temporary.remove(own)
        for s in own:
            s.drop_all()


def without_rows(docs: DataFrame, scratch: Scratch, gone: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows whose ids are in gone(docs with doc_id), a frame whose first column holds them.

    In a table with null or repeated ids the rows are numbered (and written, so that their numbers stay) and judged
    by number, so that no row goes or stays for another's sake.
    """
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        out = scratch.table(gone(docs).toDF("gone_id"), "gone")
        return docs.join(out, docs["doc_id"] == out["gone_id"], "left_anti")
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = scratch.table(docs.toDF(*names).withColumn("row_number", F.monotonically_increasing_id()), "rows")
    as_docs = rows.select(*[F.col("row_number" if c == "doc_id" else k).alias(c) for k, c in zip(names, docs.columns, strict=True)])
    out = scratch.table(gone(as_docs).toDF("gone_id"), "gone")
    return rows.join(out, rows["row_number"] == out["gone_id"], "left_anti").select(*names).toDF(*docs.columns)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII texts take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


# ---------------------------------------------------------------- word hashing
_BLOCK = 1 << 19
_LONG = 1 << 12
_RNG = np.random.Generator(np.random.PCG64(20240229))
_POSITION = _RNG.integers(0, 2**64, _LONG, dtype=np.uint64) | np.uint64(1)
SHINGLE_WORDS = 5
_SHINGLE = _RNG.integers(0, 2**64, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_table(separators: bytes) -> np.ndarray:
    """byte -> 0 for a separator, else the byte with A-Z lower-cased, plus 1."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[0x41:0x5B] += 32
    table[list(separators)] = 0
    return table


def _block_hashes(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = table[data]
    inside = b != 0
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    begin = np.flatnonzero(first)
    length = np.diff(begin, append=len(at))
    offset = np.arange(len(at)) - np.repeat(begin, length)
    wide = int(length.max()) > _LONG
    if wide:
        # words beyond the table's length: later stretches get multipliers of their own (the first adds mix(0) = 0)
        value = b[at].astype(np.uint64) * (_POSITION[offset % _LONG] + mix((offset // _LONG).astype(np.uint64)))
    else:
        value = b[at].astype(np.uint64) * _POSITION[offset]
    return mix(np.add.reduceat(value, begin) + length.astype(np.uint64)), at[begin]


def word_hashes(text: bytes, table: np.ndarray) -> np.ndarray:
    """64-bit hashes of a text's words, by blocks cut between words so that memory stays bounded for any length."""
    if len(text) <= _BLOCK:
        return _block_hashes(np.frombuffer(text, np.uint8), table)[0]
    data, parts, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        while end < len(data) and table[data[end - 1]] and table[data[end]]:
            gap = np.flatnonzero(table[data[end : end + _BLOCK]] == 0)
            end = end + int(gap[0]) if len(gap) else min(len(data), end + _BLOCK)
        parts.append(_block_hashes(data[at:end], table)[0])
        at = end
    return np.concatenate(parts)


def hash_texts(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many short texts at once, and each text's number of words."""
    joined = b"\x20".join(texts)
    hashes, begin = _block_hashes(np.frombuffer(joined, np.uint8), table)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(begin, ends), prepend=0)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word shingles of one text's word hashes; a shorter text is one shingle, no words are none."""
    n = len(words)
    if n == 0:
        return words
    if n < SHINGLE_WORDS:
        return mix(np.array([(words * _SHINGLE[:n]).sum() + np.uint64(n)], np.uint64))
    total = np.full(n - SHINGLE_WORDS + 1, SHINGLE_WORDS, np.uint64)
    for k in range(SHINGLE_WORDS):
        total += words[k : n - SHINGLE_WORDS + 1 + k] * _SHINGLE[k]
    return mix(total)


def batches_of_words(ids: list, texts: list, table: np.ndarray) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, word hashes of each) by groups of about one block of text. Null texts have no words."""
    group, keys, held = [], [], 0
    for key, text in zip(ids, texts, strict=True):
        text = text or b""
        if len(text) > _BLOCK:
            yield [key], [word_hashes(text, table)]
            continue
        group.append(text)
        keys.append(key)
        held += len(text)
        if held >= _BLOCK:
            yield keys, _split(group, table)
            group, keys, held = [], [], 0
    if group:
        yield keys, _split(group, table)


def _split(group: list[bytes], table: np.ndarray) -> list[np.ndarray]:
    hashes, counts = hash_texts(group, table)
    return np.split(hashes, np.cumsum(counts)[:-1])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, of few rows and few bytes of text: a task holds Python copies of little at a time."""
    for batch in batches:
        held = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
                held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(held), 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            end = min(batch.num_rows, at + rows, max(fit, at + 1))
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> list:
    """The column's strings as UTF-8 bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()

"""Compression of vectors by product codebooks, trained by Lloyd rounds that look at moved entries only.

Components are whole numbers, so every distance and mean is exact. Vectors are written once as numbers of the width they
need, cut into parts, and each round rewrites them with the entry and the exact distance of every part. In the next
round a part whose entry stayed where it was compares the entries that moved with that distance: all others were
farther, or equally far with a higher index, and still are. A part whose entry moved looks at all entries.
Each task leaves the sums of its parts by entry in one row more, and Spark adds these up for the next codebooks: what
comes to the driver is the size of the codebooks.

Rows are dropped whose vector is null, holds null or non-finite components, or has not the length of the vector
with the least vec_id of a length that is a positive multiple of the number of parts. A number beyond +-2^62 counts as
that bound; errors beyond a long count as the largest long. Repeated rows count as often as they occur; rows with equal
vec_id start codebooks in the order of their packed numbers, null ids come last. With fewer rows than entries, codebooks have
as many entries as there are rows. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
FAR, LONGEST = 1 << 62, (1 << 63) - 1
WHOLE = "vec_id {id}, label {label}, numbers binary"
STATE = WHOLE + ", entries binary, distances binary, sums array<decimal(38,0)>"
CODED = "vec_id {id}, label {label}, code string, error long"
ROWS = 4096
NAMES = ["vec_id", "label", "numbers", "entries", "distances", "sums"]


def whole_numbers(vector: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as signed integers of the narrowest width."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vector.astype(np.float64) * SCALE)
    out = np.clip(scaled, -FAR, FAR).astype(np.int64)  # both bounds are floats
    return out.astype(np.min_scalar_type(-1 - int(np.abs(out).max()))) if len(out) else out


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, numbers = [], []
        for k, v in enumerate(batch.column(2)):
            if v.is_valid and len(v) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all():
                    keep.append(k)
                    numbers.append(whole_numbers(x).tobytes())
        at = pa.array(keep, pa.int32())
        dims = pc.list_value_length(batch.column(2)).take(at).cast(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.binary()), dims], ["vec_id", "label", "numbers", "dims"])


def unpack(blobs: list[bytes], dims: int) -> np.ndarray:
    """vectors x dims, of the widest width among them."""
    widths = {len(b) // dims for b in blobs}
    if len(widths) == 1:
        return np.frombuffer(b"".join(blobs), f"<i{widths.pop()}").reshape(-1, dims)
    return np.stack([np.frombuffer(b, f"<i{len(b) // dims}").astype(np.int64) for b in blobs])


@dataclass
class Codebooks:
    """entries: parts x entries x width, as Python integers in an object array; moved: parts x entries."""

    entries: np.ndarray
    moved: np.ndarray

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors from entries, in the fastest arithmetic that holds them."""
    reach = max(int(np.abs(x.astype(object)).max(initial=0)) if x.dtype == np.int64 else 1 << (8 * x.itemsize), max(map(abs, entries.ravel().tolist()), default=0))
    if 4 * reach * reach * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    kind = np.int64 if 4 * reach * reach * x.shape[1] < LONGEST else object
    a, b = x.astype(kind), entries.astype(kind)
    return np.stack([((a - e) ** 2).sum(axis=1) for e in b], axis=1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance); ties to the lower index."""
    d = distances(x, entries)
    best = d.argmin(axis=1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64)
    return best, d[np.arange(len(d)), best]


def assign(x: np.ndarray, books: Codebooks, p: int, entry: np.ndarray | None = None, distance: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances of the vectors' part p, from those of the round before where they are given."""
    entries, moved = books.entries[p], np.flatnonzero(books.moved[p])
    if entry is None:
        return nearest(x, entries)
    entry, distance = entry.astype(np.int64), distance.copy()
    stay = ~books.moved[p][entry]
    if len(moved) and stay.any():
        best, d = nearest(x[stay], entries[moved])
        best, old, was = moved[best], distance[stay], entry[stay]
        wins = (d < old) | (d == old) & (best < was)
        entry[stay], distance[stay] = np.where(wins, best, was), np.where(wins, d, old)
    if not stay.all():
        best, d = nearest(x[~stay], entries)
        if d.dtype == object and distance.dtype != object:
            distance = distance.astype(object)
        entry[~stay], distance[~stay] = best, d
    return entry, distance


def _pack(distance: np.ndarray) -> list[bytes]:
    """Rows of parts distances: longs, or decimal text where one is longer."""
    if distance.dtype != object:
        data = distance.astype("<i8").tobytes()
        return [data[k : k + 8 * PARTS] for k in range(0, len(data), 8 * PARTS)]
    return [np.array(r, "<i8").tobytes() if max(r) <= LONGEST else ",".join(map(str, r)).encode() + b"," * (8 * PARTS) for r in distance.tolist()]


def _unpack(blobs: list[bytes]) -> np.ndarray:
    if all(len(b) == 8 * PARTS for b in blobs):
        return np.frombuffer(b"".join(blobs), "<i8").reshape(-1, PARTS)
    read = lambda b: np.frombuffer(b, "<i8").tolist() if len(b) == 8 * PARTS else list(map(int, b.rstrip(b",").split(b",")))
    return np.array([read(b) for b in blobs], object)


def _lloyd(batch: pa.RecordBatch, books: Codebooks, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts x vectors x width numbers, vectors x parts entries, vectors x parts distances)"""
    x = unpack(batch.column("numbers").to_pylist(), dims).reshape(batch.num_rows, PARTS, -1).transpose(1, 0, 2)
    known = "entries" in batch.schema.names
    if known:
        entry = np.frombuffer(b"".join(batch.column("entries").to_pylist()), np.uint8).reshape(-1, PARTS)
        distance = _unpack(batch.column("distances").to_pylist())
    found = [assign(x[p], books, p, *((entry[:, p], distance[:, p]) if known else ())) for p in range(PARTS)]
    return x, np.stack([e for e, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _round(books: Codebooks, dims: int):
    """Vectors with or without a state -> vectors with their new state, and one row of sums for each task."""
    k, width = books.entries.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, some = [[[0] * (width + 1) for _ in range(k)] for _ in range(PARTS)], None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x, entry, distance = _lloyd(batch, books, dims)
                for p in range(PARTS):
                    # a batch's sums fit a long unless its numbers are very large
                    wide = x.dtype == np.int64 and int(np.abs(x[p].astype(object)).max(initial=0)) >= 1 << 50
                    for e in range(k):
                        own = x[p][entry[:, p] == e]
                        if len(own):
                            add = own.astype(object if wide else np.int64).sum(axis=0).tolist()
                            sums[p][e] = [a + b for a, b in zip(sums[p][e], [*add, len(own)], strict=True)]
                some = batch.slice(0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("numbers"), pa.array([r.tobytes() for r in entry.astype(np.uint8)], pa.binary()), pa.array(_pack(distance), pa.binary()), pa.nulls(batch.num_rows, pa.list_(pa.decimal128(38)))], NAMES)
        if some is not None:
            flat = pa.array([[n for part in sums for e in part for n in e]], pa.list_(pa.decimal128(38)))
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, some.column(c).type) for c in ("vec_id", "label")], *[pa.nulls(1, pa.binary())] * 3, flat], NAMES)

    return run


def _code(books: Codebooks, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                _, entry, distance = _lloyd(batch, books, dims)
                errors = distance.sum(axis=1) if distance.dtype != object and int(distance.max(initial=0)) < LONGEST // PARTS else [min(LONGEST, sum(map(int, r))) for r in distance.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in entry.astype(np.uint8)]), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def moved_on(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Each used entry becomes the floor of its parts' mean. sums: a column of that name, a row for each task."""
    k, width = books.entries.shape[1:]
    totals = dict(sums.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect())
    flat = np.array([int(totals.get(i, 0)) for i in range(PARTS * k * (width + 1))], object).reshape(PARTS, k, width + 1)
    entries = books.entries.copy()
    for p in range(PARTS):
        for e in range(k):
            if flat[p, e, width]:
                entries[p, e] = flat[p, e, :width] // flat[p, e, width]
    return Codebooks(entries, (entries != books.entries).any(axis=2))


def compress(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the kept vectors."""
    scratch = Scratch(embeddings.sparkSession, "vectors")
    types = {"id": embeddings.schema["vec_id"].dataType.simpleString(), "label": embeddings.schema["label"].dataType.simpleString()}
    order = F.asc_nulls_last("vec_id")
    whole = scratch.table(embeddings.select("vec_id", "label", "embedding").mapInArrow(_quantise, WHOLE.format(**types) + ", dims int"), "whole")
    first = whole.where(f"dims % {PARTS} = 0").orderBy(order, "dims").limit(1).collect()
    dims = first[0]["dims"] if first else PARTS
    vectors = whole.where(F.col("dims") == dims).drop("dims")
    start = [unpack([r["numbers"]], dims)[0].tolist() for r in vectors.orderBy(order, "numbers").limit(entries).collect()]
    books = Codebooks(np.array(start, object).reshape(-1, PARTS, dims // PARTS).transpose(1, 0, 2), np.ones((PARTS, len(start)), bool))
    kept = whole
    for k in range(rounds if start else 0):
        state = scratch.table(vectors.mapInArrow(_round(books, dims), STATE.format(**types)), f"round{k}")
        scratch.drop(kept)
        kept, vectors = state, state.where("sums IS NULL").drop("sums")
        books = moved_on(books, state.where("sums IS NOT NULL"))
        if not books.moved.any():
            break
    coded = scratch.table(vectors.mapInArrow(_code(books, dims), CODED.format(**types)), "coded")
    scratch.drop(kept)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(books.text().encode()).hexdigest()).alias("codebooks_sha256"))

"""Packing tokenised documents into sequences by best-fit decreasing.

Tokenising is a scan: each task turns whole texts into ids, cuts overlong documents into full windows and emits
only (doc_id, start, length, checksum) for each piece. Pieces are few bytes, so packing them costs one
small shuffle. They are dealt by hash into shards of about shard_pieces, which fixes memory per task and makes a
repeated run of a lost task give the same sequences. In a shard, a segment tree indexed by remaining capacity finds
the tightest open window for the next longest piece. Each shard leaves about one window unfilled.

Null or empty text is the end id alone. A mark such as <|endoftext|> in a text is the tokenizer's id for it. Each input row is packed; repeated rows are packed as often as they occur.
An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sliced

WINDOW = 4096
END = (2).to_bytes(4, "little")
VOCABULARY = "word_bpe_49k.json"
#: Bytes that a task keeps of chunks and words, by rough count of their objects, before it starts anew.
CACHE = 128 << 20
#: Chunks of one text that are looked up, and encoded where new, at a time.
LOT = 5_000
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit integers, equal to the tokenizer's own.

    Marks such as <|endoftext|> are ids of their own wherever they occur in a text, as the tokenizer reads them. What
    lies between is never joined across ASCII white space, so each chunk between white space has ids of its own,
    which are kept. A chunk whose characters need no normalisation but lower case is put together from its words;
    any other goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.base = Tokenizer.from_file(path)
        marks = {t.content: i for i, t in self.base.get_added_tokens_decoder().items()}
        self.marks = {m: i.to_bytes(4, "little") for m, i in marks.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        plain = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA1, 0x180), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026] if c not in (0xAD, 0x130)]
        of = lambda k: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == k)
        self.plain = re.compile(f"[{''.join(map(re.escape, plain))}\\t\\n\\x0b\\x0c\\r]*")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of('L')}]+|[{of('N')}]|[^{of('L')}{of('N')}]+")
        vocabulary = self.base.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.base.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if self.plain.fullmatch(c)]
        other = list(set(chunks).difference(plain))
        parts = [self.words.findall(c) for c in plain]
        new = list({w for p in parts for w in p if w not in self.known})
        if new:
            # one call for all: each word's last id is one that closes a word
            ids = np.frombuffer(self._ids([" ".join(new)])[0], "<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) == len(new):
                data, at = ids.tobytes(), 0
                for w, end in zip(new, ends.tolist(), strict=True):
                    self.known[w] = data[at:end]
                    at = end
            else:
                self.known |= dict(zip(new, self._ids(new), strict=True))
        for c, p in zip(plain, parts, strict=True):
            self.chunks[c] = b"".join(map(self.known.__getitem__, p))
        if other:
            self.chunks |= dict(zip(other, self._ids(other), strict=True))
        self.held += sum(map(len, new)) + sum(map(len, chunks)) + sum(len(self.chunks[c]) for c in chunks) + 250 * (len(new) + len(chunks))

    def _between(self, text: str) -> Iterator[bytes]:
        """Ids of a text without marks, by lots of chunks."""
        chunks = text.lower().split() if self.plain.fullmatch(text) else [c.lower() if self.plain.fullmatch(c) else c for c in _SPACE.split(text)]
        for at in range(0, len(chunks), LOT):
            part = chunks[at : at + LOT]
            if new := set(part).difference(self.chunks):
                self._learn(list(new))
            yield b"".join(map(self.chunks.__getitem__, part))
            if self.held > CACHE:
                self.chunks.clear()
                self.known.clear()
                self.held = 0

    def encode(self, text: str) -> bytes:
        parts = self.split.split(text) if self.split else [text]
        return b"".join(self.marks[p] if p in self.marks else b"".join(self._between(p)) for p in parts)


_SPACE = re.compile(r"[\x20\x09-\x0D]+")


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(ids: bytes, window: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, checksum) of the full windows and of what is left."""
    for at in range(0, len(ids), 4 * window):
        part = ids[at : at + 4 * window]
        yield at // 4, len(part) // 4, zlib.crc32(part)


def tokenise(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary_path(vocabulary)).encode
        for batch in sliced(batches):
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + END
                for start, length, crc in cut(ids, window):
                    rows.append(k)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(crc)
                    totals.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *[pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, PIECES.format(id=kind))


class OpenWindows:
    """A segment tree over remaining capacities 0..window: each node says whether an open window lies below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, which: int) -> None:
        if capacity:
            self.open[capacity].append(which)
            self._add(capacity, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the open window with least capacity of at least length, taken out."""
        node, count = length + self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window, offset) of each piece; lengths come in descending order and are at most window."""
    tree, out, made = OpenWindows(window), [], 0
    for n in lengths:
        if found := tree.tightest(n):
            capacity, which = found
        else:
            capacity, which, made = window, made, made + 1
        out.append((which, window - capacity))
        tree.put(capacity - n, which)
    return out


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, shard_pieces: int = 20_000) -> DataFrame:
    """All pieces with sequence_id (long: shard and window) and offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table(tokenise(docs, window, vocabulary).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    shard = F.pmod(F.xxhash64("piece"), F.lit(shards)).cast("long")  # by piece, so that repeated rows spread as well

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        placed = np.array(best_fit_decreasing(rows["length"].to_pylist(), window), np.int64).reshape(-1, 2)
        ids = (rows["shard"].to_numpy() << 32) + placed[:, 0]
        return rows.drop_columns("shard").append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(placed[:, 1].copy()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pieces.withColumn("shard", shard).drop("piece").groupBy("shard").applyInArrow(fill, PIECES.format(id=kind) + ", sequence_id long, offset long")

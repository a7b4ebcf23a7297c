"""Encoding and decoding by byte pairs: speculate and verify.

A word's longest tokens, taken from left to right, are a guess. It equals the result of merging wherever each pair of
neighbours in it is one that merging would leave apart, so all pairs of all new words are tested at once by undoing the
merges beside their seam, latest first. Only words with a failing pair are merged exactly. Words and chunks between white space
keep their results within a task's bounded memory, as the decimal text of their ids and as decoded text, so that a text
is joined from them.

Null is the empty text. Marks such as <|endoftext|> are the tokenizer's ids wherever they stand. Each row has its
result, also with null or repeated ids; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced
from .packing import _SPACE, LOT, VOCABULARY, WordTokenizer, vocabulary_path

END = "</w>"
#: A byte, or 256 + a byte at a word's end.
UNITS = 512
NEVER = np.iinfo(np.int64).max
SCHEMA = "doc_id {id}, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Guessed bytes of words at a time.
BATCH = 1 << 20
#: Chunks of text whose new words are guessed together.
GROUP = 100_000
#: Units of a word up to which a list of ranks is faster than a heap.
SHORT = 100
#: Bytes of words and chunks that a task keeps, by rough count of their objects, before it starts anew.
KEPT = 192 << 20


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable Latin letters stand for themselves, the rest follow."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Merges:
    """A vocabulary and its ranked merges, as arrays by token id."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]]):
        of = {c: b for b, c in enumerate(byte_letters())}
        self.size = max(vocabulary.values()) + 1
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.of_pair: dict[int, int] = {}
        self.made: list[int] = []
        for k, (a, b) in enumerate(merges):
            x, y, z = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.of_pair[x * self.size + y] = k
            self.made.append(z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = k, x, y
        self.pair_keys = np.array(sorted(self.of_pair), np.int64)
        self.pair_ranks = np.array([self.of_pair[k] for k in self.pair_keys.tolist()], np.int64)
        self.base = np.full(UNITS, -1, np.int64)
        units = {}
        for token, i in vocabulary.items():
            body, end = (token[: -len(END)], True) if token.endswith(END) and token != END else (token, False)
            if all(c in of for c in body):
                units[i] = [of[c] for c in body]
                units[i][-1] += 256 * end
                if len(units[i]) == 1:
                    self.base[units[i][0]] = i
        fixed = self._fixed_points()
        self._trie({i: u for i, u in units.items() if fixed[i]})

    def _fixed_points(self) -> np.ndarray:
        """Tokens that merging their own bytes gives back; only these may be guessed."""
        made = np.array(self.made, np.int64)
        alone = np.ones(self.size, bool)
        alone[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for z in self.made:
            alone[z] &= alone[self.left[z]] and alone[self.right[z]] and self.rank[self.left[z]] < self.rank[z] and self.rank[self.right[z]] < self.rank[z]
        return alone

    def _trie(self, units: dict[int, list[int]]) -> None:
        edges, token = {}, [-1]
        for i, path in units.items():
            node = 0
            for u in path:
                key = node * UNITS + u
                if key not in edges:
                    edges[key] = len(token)
                    token.append(-1)
                node = edges[key]
            token[node] = i
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int64)
        self.token_at = np.array(token, np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves the tokens of each pair apart (with limit: up to that merge, which may be their own).

        The merges that made both tokens are undone in reverse order. Whatever lies beside the seam while it is
        undone existed until then, so a merge across the seam of lower rank would have come before. Of two equal merges
        the left one comes first.
        """
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), NEVER) if limit is None else limit
        while len(live):
            across = self._ranks(a, b)
            bad = across < limit
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            later = rb >= ra
            limit = np.where(later, rb + 1, ra)
            a, b = np.where(later, a, self.right[a]), np.where(later, self.left[b], b)
        return ok

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.pair_keys):
            return np.full(len(a), NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def longest(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, length) of the longest token at each place."""
        token, length = self.base[units], np.ones(len(units), np.int64)
        at, node, depth = np.arange(len(units)), np.zeros(len(units), np.int64), 0
        while len(at):
            key = node * UNITS + units[at + depth]
            k = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            on = self.edge_keys[k] == key
            at, node, depth = at[on], self.edge_to[k[on]], depth + 1
            found = self.token_at[node]
            token[at[found >= 0]], length[at[found >= 0]] = found[found >= 0], depth
            inside = at + depth < len(units)
            at, node = at[inside], node[inside]
        return token, length

    def exact(self, tokens: list[int]) -> list[int]:
        """The pair of lowest rank, leftmost first, is merged until none is left; tokens are single units."""
        size, of, made = self.size, self.of_pair.get, self.made
        if len(tokens) > SHORT:
            return self._exact_long(tokens)
        ranks = [of(a * size + b, NEVER) for a, b in zip(tokens, tokens[1:], strict=False)]
        while ranks and (r := min(ranks)) < NEVER:
            i = ranks.index(r)
            tokens[i : i + 2] = [made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = of(tokens[i - 1] * size + made[r], NEVER)
            if i < len(ranks):
                ranks[i] = of(made[r] * size + tokens[i + 1], NEVER)
        return tokens

    def _exact_long(self, tokens: list[int]) -> list[int]:
        """The same with a heap of pairs and linked neighbours."""
        size, of = self.size, self.of_pair
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        rank = lambda i: of.get(tokens[i] * size + tokens[after[i]]) if after[i] < len(tokens) else None
        heap = [(r, i) for i in range(len(tokens)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if tokens[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            tokens[i], tokens[j], after[i] = self.made[r], -1, after[j]
            if after[i] < len(tokens):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (new := rank(k)) is not None:
                    heapq.heappush(heap, (new, k))
        return [t for t in tokens if t >= 0]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; words are not empty."""
        units = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        units[ends - 1] += 256
        token, length = (x.tolist() for x in self.longest(units))
        guesses, at = [], 0
        for end in ends.tolist():
            guess = []
            while at < end:
                guess.append(token[at])
                at += length[at]
            guesses.append(guess)
        counts = np.array([len(g) for g in guesses])
        flat = np.array([t for g in guesses for t in g], np.int64)
        seams = np.ones(len(flat), bool)
        seams[np.cumsum(counts) - 1] = False
        place = np.flatnonzero(seams)
        pairs, back = np.unique(flat[place] * self.size + flat[place + 1], return_inverse=True)
        bad = ~self.compatible(pairs // self.size, pairs % self.size)[back]
        single, ends = self.base[units].tolist(), ends.tolist()
        for w in np.unique(np.searchsorted(np.cumsum(counts), place[bad], "right")).tolist():
            guesses[w] = self.exact(single[ends[w] - len(words[w]) : ends[w]])
        return guesses


class SpeculativeTokenizer(WordTokenizer):
    """Whole texts to the decimal text of their ids and to their decoded text."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        names = self.base.get_vocab(with_added_tokens=True)
        self.name: list[bytes] = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.name[i] = token.encode()
        self.number = [str(i).encode() for i in range(len(self.name))]
        self.byte_of = {ord(c): b for b, c in enumerate(byte_letters())}
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}

    def _words(self, chunk: str) -> list[bytes]:
        if self.plain.fullmatch(chunk):
            return [w.encode() for w in self.words.findall(chunk)]
        text = self.base.normalizer.normalize_str(chunk)
        return [w.translate(self.byte_of).encode("latin-1") for w, _ in self.base.pre_tokenizer.pre_tokenize_str(text)]

    def _learn(self, chunks: list[str]) -> None:
        parts, known = list(map(self._words, chunks)), self.known
        batch, size = [], 0
        for w in set().union(*parts).difference(known):
            batch.append(w)
            size += len(w)
            if size >= BATCH:
                self._guess(batch)
                batch, size = [], 0
        self._guess(batch)
        for c, p in zip(chunks, parts, strict=True):
            if len(p) == 1:
                self.ids[c], self.decoded[c] = known[p[0]]
            else:
                found = [known[w] for w in p]
                self.ids[c], self.decoded[c] = b" ".join([f[0] for f in found]), b" ".join([f[1] for f in found])
                self.held += 2 * len(c) + 100
        self.held += 250 * len(chunks)

    def _guess(self, words: list[bytes]) -> None:
        for w, ids in zip(words, self.merges.encode(words) if words else [], strict=True):
            self.known[w] = (b" ".join(map(self.number.__getitem__, ids)), b" ".join(map(self.name.__getitem__, ids)))
            self.held += len(w) + 10 * len(ids) + 400

    def _lots(self, texts: Iterable[str]) -> Iterator[tuple[int, list[str], int]]:
        """(row, chunks, mark): a stretch of a text by at most LOT chunks, or a mark's id."""
        for row, text in enumerate(texts):
            for part in self.split.split(text) if self.split else [text]:
                if part in self.marks:
                    yield row, [], int.from_bytes(self.marks[part], "little")
                    continue
                chunks = part.lower().split() if self.plain.fullmatch(part) else [c.lower() if self.plain.fullmatch(c) else c for c in _SPACE.split(part) if c]
                for at in range(0, len(chunks), LOT):
                    yield row, chunks[at : at + LOT], -1

    def rendered(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(row, ids, decoded text) of successive stretches with at least one token; new words of many rows are guessed at once."""
        lots, held = [], 0
        for lot in self._lots(texts):
            lots.append(lot)
            held += len(lot[1])
            if held >= GROUP:
                yield from self._group(lots)
                lots, held = [], 0
        yield from self._group(lots)

    def _group(self, lots: list[tuple[int, list[str], int]]) -> Iterator[tuple[int, bytes, bytes]]:
        new = set().union(*(chunks for _, chunks, _ in lots)).difference(self.ids)
        if self.held > KEPT and new:
            self.known.clear()
            self.ids.clear()
            self.decoded.clear()
            self.held, new = 0, set().union(*(chunks for _, chunks, _ in lots))
        if new:
            self._learn(list(new))
        for row, chunks, mark in lots:
            if mark >= 0:
                yield row, self.number[mark], self.name[mark]
            elif ids := b" ".join(filter(None, map(self.ids.__getitem__, chunks))):
                yield row, ids, b" ".join(filter(None, map(self.decoded.__getitem__, chunks)))


@lru_cache(2)
def speculative_tokenizer(path: str) -> SpeculativeTokenizer:
    return SpeculativeTokenizer(path)


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of docs: the number of tokens, and digests of its ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rendered = speculative_tokenizer(vocabulary_path(vocabulary)).rendered
        for batch in sliced(batches):
            counts, digests = [0] * batch.num_rows, [(hashlib.sha256(), hashlib.sha256()) for _ in range(batch.num_rows)]
            for row, *both in rendered(text or "" for text in batch.column(1).to_pylist()):
                for digest, piece in zip(digests[row], both, strict=True):
                    digest.update(b" " + piece if counts[row] else piece)
                counts[row] += both[0].count(b" ") + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *[pa.array([d[k].hexdigest() for d in digests], pa.string()) for k in (0, 1)]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(id=kind))

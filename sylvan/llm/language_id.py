"""Language identification of whole, possibly mixed texts.

The model holds log probabilities of byte trigrams inside words, of words, and the scripts that each language uses.
It is fitted by a distributed count over about `sample` labelled documents of each language. Every language is
learned; the tables of all together take at most model_bytes, with fewer buckets each where languages are many, and
are broadcast. A word's script range first narrows its candidate languages; its score for each is the sum of its
features. Viterbi decoding over the words with a penalty for each switch labels the spans. A text in which no other
language can gain half the penalty over any stretch is constant by proof, and is not decoded.

`lang_pred` is the language with most words (of equal ones the first by name) and `score` its share of the words: 1
for a text in one language throughout. Scoring is a scan without shuffle. A null text or one without letters is `und`
with score 0; very long texts are read whole, by blocks. Each input row gives one output row, repeated rows the
same one. An empty table gives no rows. Without any labelled document every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _block_hashes, byte_table, mix, sliced, utf8

BUCKETS, FEWEST = 1 << 16, 1 << 8
_TABLE = byte_table(bytes(c for c in range(128) if not chr(c).isalpha()))
_BLOCK = 1 << 19
TRIGRAM, WORD, SCRIPT = 0, 1, 2

#: Script of a character by its first UTF-8 byte: 0 Latin, 1 Greek, 2 Cyrillic, 3 Hebrew, 4 Arabic, 5 Indic,
#: 6 South-East Asian, 7 kana and Han, 8 Hangul, 9 other.
_LEADS = ((0x00, 0xCD, 0), (0xCE, 0xCF, 1), (0xD0, 0xD4, 2), (0xD6, 0xD7, 3), (0xD8, 0xDF, 4), (0xE0, 0xE0, 5), (0xE1, 0xE1, 6), (0xE2, 0xE2, 0), (0xE3, 0xE9, 7), (0xEA, 0xED, 8), (0xEE, 0xFF, 9))
_SCRIPT = np.zeros(256, np.uint8)
for _first, _last, _code in _LEADS:
    _SCRIPT[_first : _last + 1] = _code
_SCRIPT[0x80:0xC0] = 0  # later bytes of a character
SCRIPTS = 10


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets, each word's first trigram, word buckets, word scripts, and each text's number of words."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    b = _TABLE[data].astype(np.uint32)
    at = np.flatnonzero(b)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not len(at):
        return at, at, at, at, np.zeros(len(texts), np.int64)
    tri = b[at - 1] * np.uint32(0x9E3779B1) ^ b[at] * np.uint32(0x85EBCA77) ^ b[at + 1] * np.uint32(0xC2B2AE3D)
    tri = (tri ^ tri >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    hashes, begin = _block_hashes(data, _TABLE)
    first = np.searchsorted(at, begin)
    script = np.maximum.reduceat(_SCRIPT[data[at]], first)
    return tri, first, (mix(hashes) & np.uint64(BUCKETS - 1)).astype(np.int64), script, np.diff(np.searchsorted(begin, ends), prepend=0)


def _counted(buckets: int):
    """Counts of features for each language of a slice of rows, so that a task holds few languages' at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found: dict[str, list[list[np.ndarray]]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                own = found.setdefault(lang, [[], [], []])
                for at in range(0, len(text), _BLOCK):
                    tri, _, words, scripts, _ = _features([text[at : at + _BLOCK]])
                    for into, what in zip(own, (tri & (buckets - 1), words & (buckets - 1), scripts), strict=True):
                        into.append(what.astype(np.int64))
            for lang, own in found.items():
                for kind, parts in enumerate(own):
                    some, n = np.unique(np.concatenate([*parts, np.empty(0, np.int64)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(np.full(len(some), kind, np.int32)), pa.array(some.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "kind", "bucket", "n"])

    return run


@dataclass
class LanguageModel:
    """languages; logs: languages x 2 x buckets; uses: languages x SCRIPTS; penalty of a switch."""

    languages: list[str]
    logs: np.ndarray
    uses: np.ndarray
    penalty: float = 12.0
    most: float = field(default=8.0)  # a word's score cannot fall further below its best

    def word_scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tri, first, words, script, counts = _features(texts)
        out = np.full((len(self.languages), len(words)), -1e3, np.float32)
        if len(words) and self.languages:
            buckets = self.logs.shape[2]
            tri, words, known = tri & (buckets - 1), words & (buckets - 1), self.uses[:, script]
            lengths = np.diff(first, append=len(tri))
            for k in range(len(self.languages)):
                own = known[k]
                if own.all():
                    out[k] = np.add.reduceat(self.logs[k, TRIGRAM][tri], first) + self.logs[k, WORD][words]
                elif own.any():  # only the words in a script that the language uses
                    begin = np.cumsum(lengths[own]) - lengths[own]
                    out[k, own] = np.add.reduceat(self.logs[k, TRIGRAM][tri[np.repeat(own, lengths)]], begin) + self.logs[k, WORD][words[own]]
            out -= out.max(axis=0)
            np.maximum(out, -self.most, out=out)
        return out, counts

    def label(self, scores: np.ndarray) -> tuple[np.ndarray | int, int]:
        """Each word's language (or the one of all) and the best language as a whole."""
        total = scores.sum(axis=1, dtype=np.float64)
        best = int(total.argmax())
        ahead = np.zeros((scores.shape[0], scores.shape[1] + 1))
        np.cumsum(scores - scores[best], axis=1, out=ahead[:, 1:])
        gain = (ahead - np.minimum.accumulate(ahead, axis=1)).max(axis=1)
        others = np.flatnonzero(gain > self.penalty / 2)
        if not len(others[others != best]):
            return best, best
        candidates = np.array(sorted({best, *others.tolist()}))
        return candidates[self._viterbi(scores[candidates])], best

    def _viterbi(self, scores: np.ndarray) -> np.ndarray:
        value, back, states = [0.0] * len(scores), [], range(len(scores))
        for column in scores.T.tolist():
            top = max(value)
            best, switched, step = value.index(top), top - self.penalty, []
            for k in states:
                if value[k] >= switched:
                    step.append(k)
                    value[k] += column[k]
                else:
                    step.append(best)
                    value[k] = switched + column[k]
            back.append(step)
        path = np.empty(len(back), np.int64)
        state = value.index(max(value))
        for t in range(len(back) - 1, -1, -1):
            path[t] = state
            state = back[t][state]
        return path


def fit(docs: DataFrame, sample: int = 2000, model_bytes: int = 64 << 20) -> LanguageModel:
    """Learn from the rows with a language that are not held out: about `sample` of each, chosen by a hash.

    More languages than model_bytes holds with FEWEST buckets each (32,768 by default) are an error.
    """
    train = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    most = model_bytes // (8 * FEWEST)
    sizes = train.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).toArrow()
    if sizes.num_rows > most:
        raise ValueError(f"more than {most} languages: give a larger model_bytes")
    if not sizes.num_rows:
        return LanguageModel([], np.zeros((0, 2, FEWEST), np.float32), np.zeros((0, SCRIPTS), bool))
    buckets = BUCKETS
    while 8 * buckets * sizes.num_rows > model_bytes:
        buckets //= 2
    share = F.broadcast(docs.sparkSession.createDataFrame(sizes).select(F.col("lang").alias("of"), F.least(F.lit(1.0), sample / F.col("n")).alias("share")))
    train = train.join(share, F.col("lang") == F.col("of")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    rows = train.select("lang", "text").mapInArrow(_counted(buckets), "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    at = {k: i for i, k in enumerate(names)}
    lang = np.array([at[k] for k in rows["lang"].to_pylist()], np.int64)
    kind, bucket, n = (rows[c].to_numpy() for c in ("kind", "bucket", "n"))
    logs, uses = np.zeros((len(names), 2, buckets), np.float32), np.zeros((len(names), SCRIPTS), bool)
    order = np.lexsort((kind, lang))
    lang, kind, bucket, n = lang[order], kind[order], bucket[order], n[order]
    for k in range(len(names)):
        lo, hi = np.searchsorted(lang, (k, k + 1))
        for what in (TRIGRAM, WORD, SCRIPT):
            a, b = np.searchsorted(kind[lo:hi], (what, what + 1)) + lo
            if what == SCRIPT:
                c = np.zeros(SCRIPTS)
                c[bucket[a:b]] = n[a:b]
                uses[k] = c > 0.001 * c.sum()
            else:
                c = np.full(buckets, 0.5)
                c[bucket[a:b]] += n[a:b]
                logs[k, what] = np.log(c / c.sum())
    return LanguageModel(names, logs, uses)


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and spans (language:first word:end) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def describe(model: LanguageModel, text: bytes | None, scores: np.ndarray) -> tuple[str, float, str]:
        n = scores.shape[1]
        if not text or not n or not model.languages or not _any_ascii_letter(text) and not _has_letter(text):
            return "und", 0.0, ""
        labels, best = model.label(scores)
        if isinstance(labels, int):
            return model.languages[best], 1.0, f"{model.languages[best]}:0:{n}"
        share = np.bincount(labels, minlength=len(model.languages))
        top = int(share.argmax())
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), n]
        return model.languages[top], float(share[top] / n), ",".join(f"{model.languages[labels[a]]}:{a}:{b}" for a, b in zip(cuts, cuts[1:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            out = [describe(model, text, scores) for text, scores in _scored(model, utf8(batch.column(1)))]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.string())], ["doc_id", "lang_pred", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans string")


_ASCII_LETTERS = bytes(c for c in range(128) if chr(c).isalpha())


def _any_ascii_letter(text: bytes) -> bool:
    return len(text.translate(None, _ASCII_LETTERS)) < len(text)


def identify(docs: DataFrame, sample: int = 2000) -> DataFrame:
    """Fit on docs and predict all of them: doc_id, held_out, lang_pred, score, spans."""
    out = predict(docs, fit(docs, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def keep_identified(docs: DataFrame, least: float = 0.5, sample: int = 2000) -> DataFrame:
    """docs without those whose language cannot be told: no letters, or no language with `least` of the words.

    Each row is judged by itself: null texts go, repeated rows stay or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            table = pa.Table.from_batches([batch])
            verdict = [_told(model, text, scores, least) for text, scores in _scored(model, utf8(batch.column(names.index("text"))))]
            yield from table.filter(pa.array(verdict, pa.bool_())).to_batches()

    return docs.mapInArrow(keep, docs.schema)


def _told(model: LanguageModel, text: bytes, scores: np.ndarray, least: float) -> bool:
    if not scores.shape[1] or not model.languages or not _any_ascii_letter(text) and not _has_letter(text):
        return False
    labels, _ = model.label(scores)
    return isinstance(labels, int) or float(np.bincount(labels).max() / len(labels)) >= least


def _scored(model: LanguageModel, texts: list) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each text, empty for null, and its words' scores; short texts together, long ones by blocks."""
    group, held = [], 0

    def flush() -> Iterator[tuple[bytes, np.ndarray]]:
        scores, counts = model.word_scores(group)
        for text, end, n in zip(group, np.cumsum(counts).tolist(), counts.tolist(), strict=True):
            yield text, scores[:, end - n : end]

    for text in texts:
        if text and len(text) > _BLOCK:
            if group:
                yield from flush()
            yield text, _long_scores(model, text)
            group, held = [], 0
            continue
        group.append(text or b"")
        held += len(group[-1])
        if held >= _BLOCK:
            yield from flush()
            group, held = [], 0
    if group:
        yield from flush()


def _long_scores(model: LanguageModel, text: bytes) -> np.ndarray:
    """By blocks that end between words where there is a gap near."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + _BLOCK)
        gap = text.rfind(b" ", at + _BLOCK // 2, end) if end < len(text) else -1
        end = gap if gap > 0 else end
        parts.append(model.word_scores([text[at:end]])[0])
        at = end
    return np.concatenate(parts, axis=1)

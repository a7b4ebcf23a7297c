"""License statements found by MinHash bands over overlapping text windows.

Windows of 8 words, 4 words apart, hold every 5-word shingle of a text whole. A window has at most 4 shingles, so
with 32 bands of one MinHash value each, a window that holds a single shingle of a template meets the template
with a chance of 1 - (3/4)^32 > 0.9999. Templates are cut into windows at every word. Retrieved templates are then
verified: the share of the template's distinct shingles found near the window, exactly counted, must reach 0.75.
A template is a section of a licence or one of its usual notices (license_texts), so that a text that holds only
the warranty, say, is found as well; the parameter `templates` takes others.

The bands of the templates are a few thousand numbers; the corpus is only scanned. Words are compared without
regard to case and punctuation. Null or empty text holds no licence; very long texts are read whole. Each input row
gives one output row, repeated rows the same one. An empty table gives no rows. Spans with equal starts are ordered
by their end and then by the licence's name; names are listed once, sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SHINGLE_WORDS, batches_of_words, byte_table, shingle_hashes, sliced, utf8, word_hashes
from .license_texts import TEMPLATES

WINDOW, STEP, BANDS, SHARE = 8, 4, 32, 0.75
_TABLE = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()))
_rng = np.random.Generator(np.random.PCG64(11))
_A = _rng.integers(0, 2**64, BANDS, dtype=np.uint64) | np.uint64(1)
_FILTER_BITS = 20


@lru_cache(2)
def retrieval(templates: tuple = tuple(TEMPLATES.items())) -> tuple[list, list[np.ndarray], list[dict[int, list[int]]], np.ndarray]:
    """Templates' (licence, words), their shingles, each band's value -> templates, and a bit filter over all bands."""
    names, sets, bands = [], [], [{} for _ in range(BANDS)]
    for name, texts in templates:
        for text in texts:
            words = word_hashes(text.encode(), _TABLE)
            names.append((name, len(words)))
            sets.append(np.unique(shingle_hashes(words)))
            for at in range(max(1, len(words) - WINDOW + 1)):
                own = shingle_hashes(words[at : at + WINDOW])
                for k in range(BANDS):
                    bands[k].setdefault(int((own * _A[k]).min()), []).append(len(names) - 1)
    bits = np.zeros((BANDS, 1 << _FILTER_BITS), bool)
    for k, band in enumerate(bands):
        bits[k, np.array(list(band), np.uint64) >> np.uint64(64 - _FILTER_BITS)] = True
    return names, sets, bands, bits


def window_minima(shingles: np.ndarray, k: int) -> np.ndarray:
    """The k-th MinHash value of each window: of 4 shingles, 4 apart."""
    return np.minimum.reduceat(shingles * _A[k], np.arange(0, len(shingles), STEP))


def scan_words(words: np.ndarray, templates: tuple = tuple(TEMPLATES.items())) -> list[tuple[str, float, int, int]]:
    """(licence, containment, first word, end word) of verified matches, by place."""
    names, sets, bands, bits = retrieval(templates)
    if len(words) < SHINGLE_WORDS:
        return []
    shingles = shingle_hashes(words)
    candidates: dict[int, set[int]] = {}
    for k in range(BANDS):
        low = window_minima(shingles, k)
        for w in np.flatnonzero(bits[k, low >> np.uint64(64 - _FILTER_BITS)]).tolist():
            for t in bands[k].get(int(low[w]), ()):
                candidates.setdefault(t, set()).add(w * STEP)
    found = []
    for t, places in candidates.items():
        name, length = names[t]
        end = -1
        for at in sorted(places):
            if at < end:
                continue
            lo, hi = max(0, at - length - STEP), min(len(shingles), at + length + STEP)
            hit = np.flatnonzero(np.isin(shingles[lo:hi], sets[t]))
            if not len(hit):
                continue
            share = len(np.unique(shingles[lo:hi][hit])) / len(sets[t])
            if share >= SHARE:
                end = lo + int(hit[-1]) + SHINGLE_WORDS
                found.append((name, share, lo + int(hit[0]), end))
    return sorted(set(found), key=lambda f: (f[2], f[3], f[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, licenses (comma-joined, sorted), the largest containment and spans in words. templates: texts by licence,
    each of at least five words."""
    chosen = tuple((templates or TEMPLATES).items())
    if short := [n for n, texts in chosen for t in texts if len(word_hashes(t.encode(), _TABLE)) < SHINGLE_WORDS]:
        raise ValueError(f"templates of under {SHINGLE_WORDS} words match nothing: {', '.join(short)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for keys, texts in batches_of_words(batch.column(0).to_pylist(), utf8(batch.column(1)), _TABLE):
                names, shares, spans = [], [], []
                for words in texts:
                    found = scan_words(words, chosen)
                    names.append(",".join(sorted({f[0] for f in found})))
                    shares.append(max((f[1] for f in found), default=0.0))
                    spans.append(",".join(f"{n}:{a}:{b}" for n, _, a, b in found))
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, pa.string())], ["doc_id", "licenses", "containment", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, licenses string, containment double, spans string")

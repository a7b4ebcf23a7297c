"""Secrets tagged by a linear-chain conditional random field, beside exact patterns.

Tokens are runs of characters between white space, quotes and assignment signs. The field decodes, exactly and by
Viterbi, every token of the stretches around a run of at least 12 characters of a key's alphabet that is no
word in usual case, and around a cue word (password, key, bearer, ...). Text outside those stretches has neither a
key-like run nor a cue and is not decoded. Features are a token's shape as a whole, its neighbours' words, the signs
between them and what the file around it looks like.

The chain is trained here by gradient ascent on at most most_stretches stretches of about `documents` documents
(both are parameters). Their tags come from the patterns. To learn more than the patterns, stretches are also used in
changed form: the match is replaced by drawn secrets under other names, signs and shapes, or by look-alikes
that are no secrets (addresses, versions, dates, paths, identifiers). Matches of the patterns always stay; the field
adds spans.

Scanning is one pass without shuffle. Null or empty text has no spans; very long texts are read whole. Each input
row gives one output row, repeated rows the same one. An empty table gives no rows. Without any stretch to train
on, only the patterns count. Spans with equal starts are ordered by kind, as listed, and then by end.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that occur in every match of `assign`, without regard to case: fixed values.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words near secrets, for features: fixed values.
CUES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "key", "apikey", "auth", "bearer", "credential", "credentials", "private", "signature")

B, I, O = 0, 1, 2  # noqa: E741
_BETWEEN = r"\s\"'`:=,;(){}\[\]<>#$%&*|!?"
_TOKEN, _GAP = re.compile(f"[^{_BETWEEN}]+"), re.compile(f"[{_BETWEEN}]")
#: Runs that may be keys; _may_be_key then looks at all of a run.
_RUN = re.compile(r"[A-Za-z0-9+/_.-]{12,}=*")
_CUE = re.compile(r"(?ai:(?<![a-z])(?:" + "|".join(CUES) + ")(?![a-z]))")
BUCKETS = 1 << 13
AROUND = 48  # characters on either side of a run or cue that its stretch takes in
PARTS = 17  # features of a token


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the exact patterns."""
    spans = []
    low = text.lower()
    if any(n in low for n in NAMES):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


@lru_cache(1 << 15)
def _bucket(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=4).digest(), "little") % BUCKETS


def _may_be_key(run: str) -> bool:
    """Not a word of letters in one case, or with a capital."""
    core = run.strip("._-/+=")
    return not core.isalpha() or not (core.islower() or core.isupper() or core[1:].islower())


_CLASS = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})
_REPEATED = re.compile(r"(.)\1+")


def _shape(token: str) -> str:
    """Classes of the token's characters, each run of one class as one."""
    return _REPEATED.sub(r"\1", token.translate(_CLASS))


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in (token.count(c) for c in set(token)))


@lru_cache(1 << 13)
def _own(token: str) -> tuple[str, tuple[int, ...]]:
    """A token's kind (the classes it holds) and the features of itself alone."""
    shape = _shape(token)
    kind = "".join(k for k in "aA0" if k in shape) + ("s" if set(shape) - set("aA0") else "")
    changes = min(4, 5 * (len(shape) - 1) // len(token))
    parts = ("_" in token, "." in token, "/" in token, "@" in token)
    names = [
        ("kind", kind), ("length", kind, min(8, len(token) // 4)), ("changes", kind, changes), ("long", len(token) >= 12, changes), ("head", shape[:4]), ("tail", shape[-4:]), ("signs", kind, parts), ("runs", min(9, len(shape))),
        ("entropy", kind, int(2 * _entropy(token)) if len(token) >= 8 else -1), ("hex", bool(re.fullmatch("[0-9a-f]+", token)), len(token) >= 24),
    ]
    return kind, tuple(_bucket(*n) for n in names)


@lru_cache(1 << 13)
def _role(token: str) -> str:
    low = token.lower()
    return "cue" if any(p in CUES for p in re.split(r"[_.\-/]", low)) or _CUE.search(token) else "word" if low.isalpha() else "odd"


def _sign(gap: str) -> str:
    return "assign" if "=" in gap or ":" in gap else "quote" if any(c in gap for c in "\"'`") else "line" if "\n" in gap else "space" if gap.isspace() else "other"


def file_features(text: str) -> tuple[str, ...]:
    lines = text.count("\n") + 1
    signs = sum(text.count(c) for c in "={};")
    return (f"signs{min(3, 10 * signs // lines)}", f"line{min(5, int(math.log10(1 + len(text) / lines)))}")


def features(text: str, places: list[tuple[int, int]], of_file: tuple[str, ...]) -> list[list[int]]:
    """PARTS features for each token of a stretch."""
    tokens = [text[a:b] for a, b in places]
    own, roles = [_own(t) for t in tokens], [_role(t) for t in tokens]
    signs = ["edge", *[_sign(text[x[1] : y[0]]) for x, y in zip(places, places[1:], strict=False)], "edge"]
    at = lambda k: roles[k] if 0 <= k < len(roles) else "edge"
    out = []
    for k, (kind, alone) in enumerate(own):
        near = (("before", at(k - 1), signs[k]), ("before", kind, at(k - 1), signs[k]), ("before2", kind, at(k - 2), at(k - 1)), ("after", at(k + 1), signs[k + 1]), ("role", roles[k], signs[k + 1]))
        out.append([*alone, *[_bucket(*n) for n in near], *[_bucket(f, kind) for f in of_file]])
    return out


def _token_end(text: str, at: int) -> int:
    """The end of the token that holds the character before `at`, or `at` itself."""
    if at >= len(text) or _GAP.match(text, at - 1):
        return at
    return m.start() if (m := _GAP.search(text, at)) else len(text)


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token places of the stretches around runs that may be keys and around cues.

    A stretch begins and ends with whole tokens, and stretches that touch are one, so that no token is in two.
    """
    seen = sorted([m.span() for m in _RUN.finditer(text) if _may_be_key(m[0])] + [m.span() for m in _CUE.finditer(text)])
    lo = hi = -1
    for start, end in seen:
        a, b = max(0, start - AROUND), min(len(text), end + AROUND)
        if hi >= a:
            hi = _token_end(text, b) if b > hi else hi
            continue
        if hi >= 0:
            yield [t.span() for t in _TOKEN.finditer(text, lo, hi)]
        while a > 0 and not _GAP.match(text, a - 1) and not _GAP.match(text, a):
            a -= 1
        lo, hi = a, _token_end(text, b)
    if hi >= 0:
        yield [t.span() for t in _TOKEN.finditer(text, lo, hi)]


@dataclass
class SecretField:
    """emit: BUCKETS x 3 weights; move: 3 x 3 transition weights."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, of: list[list[int]]) -> np.ndarray:
        return self.emit[np.asarray(of)].sum(axis=1)

    def decode(self, e: np.ndarray) -> list[int]:
        """The best tag sequence; `inside` must follow `begin` or `inside`."""
        rows, move = e.tolist(), self.move.tolist()
        value, back = [rows[0][B], -1e9, rows[0][O]], []
        for row in rows[1:]:
            step, now = [], []
            for to in (B, I, O):
                ways = [value[k] + move[k][to] for k in (B, I, O)]
                best = max(ways)
                step.append(ways.index(best))
                now.append(best + row[to])
            back.append(step)
            value = now
        tags = [value.index(max(value))]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]


def _start() -> SecretField:
    field = SecretField(np.zeros((BUCKETS, 3)), np.zeros((3, 3)))
    field.move[O, I] = -1e9
    return field


def train(examples: list[tuple[list[list[int]], list[int]]], rounds: int = 50, rate: float = 0.5, ridge: float = 1e-3) -> SecretField:
    """Maximise the conditional likelihood of the tags by gradient ascent (forward-backward over all examples at once)."""
    field = _start()
    if not examples:
        return field
    longest = max(len(t) for _, t in examples)
    count = np.array([len(t) for _, t in examples])
    of = np.array([x for f, _ in examples for x in f], np.int64)
    want = np.full((len(examples), longest), O)
    for k, (_, tags) in enumerate(examples):
        want[k, : len(tags)] = tags
    there = np.arange(longest) < count[:, None]
    gold = np.eye(3)[want] * there[:, :, None]
    pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    squares, move_squares = np.full((BUCKETS, 3), 1e-6), np.full((3, 3), 1e-6)
    add = lambda x: np.logaddexp.reduce(x, axis=1)
    for _ in range(rounds):
        e = np.zeros((len(examples), longest, 3))
        e[there] = field.scores(of)
        e[:, 0, I] = -1e9
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, longest):
            step = add(fwd[:, t - 1, :, None] + field.move) + e[:, t]
            fwd[:, t] = np.where(there[:, t, None], step, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(field.move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where(there[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(fwd[:, -1], axis=1)
        at = np.exp(np.clip(fwd + bwd - total[:, None, None], -700, 0)) * there[:, :, None]
        miss = np.repeat((gold - at)[there], PARTS, axis=0)
        change = np.stack([np.bincount(of.ravel(), miss[:, k], BUCKETS) for k in (B, I, O)], axis=1) / len(examples) - ridge * field.emit
        expected = np.zeros((3, 3))
        for t in range(1, longest):
            both = np.exp(np.clip(fwd[:, t - 1, :, None] + field.move + (e[:, t] + bwd[:, t])[:, None, :] - total[:, None, None], -700, 0))
            expected += (both * there[:, t, None, None]).sum(axis=0)
        shift = (pairs - expected) / len(examples)
        squares += change**2
        move_squares += shift**2
        field.emit += rate * change / np.sqrt(squares)
        field.move += rate * shift / np.sqrt(move_squares)
        field.move[O, I] = -1e9
    return field


# ---------------------------------------------------------------- training material
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_NAMES = (*CUES, "api_key", "client_secret", "DB_PASSWORD", "access_token", "private_key", "auth_token")
_SIGNS = ("=", " = ", ": ", ":", " := ", " => ", " is ", " ", "=\"", ": '", " = \"", '":"')


def _drawn(rng: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))


def _secret(rng: random.Random) -> tuple[str, bool]:
    """A drawn secret, and whether it shows as one without a name."""
    mixed = _LOWER + _UPPER + _DIGIT
    kind = rng.randrange(7)
    if kind == 0:
        return _drawn(rng, "0123456789abcdef", 24, 64), True
    if kind == 1:
        return _drawn(rng, mixed, 20, 48), True
    if kind == 2:
        return _drawn(rng, mixed + "+/", 24, 60), True
    if kind == 3:
        return _drawn(rng, _LOWER, 2, 4) + rng.choice("_-") + rng.choice(("", _drawn(rng, _LOWER, 3, 5) + "_")) + _drawn(rng, rng.choice((mixed, _LOWER + _DIGIT, _LOWER)), 16, 36), True
    if kind == 4:
        return _drawn(rng, _LOWER + _UPPER, 12, 28), False
    if kind == 5:
        return _drawn(rng, _LOWER, 4, 8) + _drawn(rng, _DIGIT, 1, 4), False
    return _drawn(rng, mixed, 3, 6) + rng.choice(("", "", "_", "-", ".")) + _drawn(rng, mixed, 3, 6) + _drawn(rng, _DIGIT, 1, 2), False


def _lookalike(rng: random.Random, words: list[str]) -> str:
    """Something odd that is no secret."""
    n, w = (lambda low, high: str(rng.randint(low, high))), (lambda: rng.choice(words))
    return rng.choice((
        lambda: ".".join(n(0, 255) for _ in range(4)), lambda: f"{n(1990, 2030)}-{n(10, 12)}-{n(10, 28)}T{n(10, 23)}", lambda: f"v{n(0, 9)}.{n(0, 20)}.{n(0, 9)}-{w()}{n(1, 9)}", lambda: f"{w()}.{n(1, 99)}@{w()}{n(1, 9)}.example.com", lambda: _drawn(rng, _DIGIT, 12, 19),
        lambda: f"src/{w()}/{w()}_{n(1, 99)}.py", lambda: f"{w()}_{w()}_{w()}_{n(1, 999)}", lambda: w() + w().capitalize() + w().capitalize() + n(1, 9), lambda: f"www.{w()}.com/{w()}/{n(1, 9999)}", lambda: f"{w()}-{w()}-{w()}-{n(1, 99)}", lambda: f"{n(1, 999)}-{n(100, 999)}-{n(1000, 9999)}",
        lambda: w().capitalize() + w().capitalize() + w().capitalize(), lambda: w() + n(1, 99) + w().capitalize() + w().capitalize(),
    ))()


def _fields(rng: random.Random, words: list[str]) -> str:
    """An object without white space, of numbered names and short ids."""
    value = lambda: rng.choice((rng.choice(words), str(rng.randint(0, 9999)), _drawn(rng, "0123456789abcdef", 6, 10), _lookalike(rng, words)))
    return "{" + ",".join(f'"{rng.choice(words)}{rng.choice(("", rng.randint(0, 999)))}":"{value()}"' for _ in range(rng.randint(1, 4))) + "}"


def examples_of(stretch: str, secrets: list[tuple[int, int]], of_file: tuple[str, ...]) -> list[tuple[list, list]]:
    """The stretch itself and changed forms of it, each with its features and tags."""
    rng = random.Random(hashlib.sha256(stretch.encode()).digest())
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", stretch) if len(w) > 1][:40] or ["word"]
    forms = [(stretch, secrets)]
    a, b = secrets[0] if secrets else (k := stretch.rfind(" ", 0, len(stretch) // 2 + 1) + 1, k)
    # what stood there goes with the name before it
    before = re.sub(r"(?ai:[\w.-]*(?:%s)[\w.-]*)[\"']?\s*[:=]*\s*[\"']?$" % "|".join(NAMES), "", stretch[:a]) if secrets else stretch[:a]
    after = stretch[b:]
    for _ in range(4):
        value, plain = _secret(rng)
        name = rng.choice(_NAMES) if not plain or rng.random() < 0.7 else ""
        name = rng.choice((name, name.upper(), name.capitalize()))
        sign = rng.choice(_SIGNS) if name else ""
        quote = sign[-1] if sign and sign[-1] in "\"'" else ""
        head = before + name + sign
        second = rng.choice(("", "", "", "", ":" + _drawn(rng, _LOWER + _UPPER + _DIGIT, 12, 24)))
        forms.append((head + value + second + quote + " " + after, [(len(head), len(head) + len(value) + len(second))]))
    for _ in range(5):
        # names in prose, names with ordinary words, and odd tokens of other kinds
        name, word = rng.choice(_NAMES), rng.choice(words)
        odd = _lookalike(rng, words)
        text = rng.choice((f"{name} {word} {rng.choice(words)}", f"{name}: {word} {rng.choice(words)}", f"{word} {name} {word}", odd, odd, f"{word} {odd}", f"{rng.choice(words)}: {odd}", _fields(rng, words), _fields(rng, words)))
        forms.append((f"{before}{text} {after}", []))
    out = []
    for text, spans in forms:
        places = [t.span() for t in _TOKEN.finditer(text)]
        tags, last = [], None
        for x, y in places:
            own = next((s for s in spans if s[0] < y and x < s[1]), None)
            tags.append(O if own is None else I if own == last else B)
            last = own
        if places:
            out.append((features(text, places, of_file), tags))
    return out


def fit(docs: DataFrame, documents: int = 4000, most_stretches: int = 120) -> SecretField:
    """Train on at most most_stretches stretches with a match and as many without, of about `documents` documents, all
    chosen by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text in batch.column(0).to_pylist():
                spans, of_file = base_spans(text), file_features(text)
                secrets = sorted({m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6} | {s[:2] for s in spans if s[2] != "assign"})
                for places in stretches(text):
                    lo, hi = places[0][0], places[-1][1]
                    if hi - lo <= 4 * AROUND:  # longer ones say nothing that short ones do not
                        own = [(max(a, lo) - lo, min(b, hi) - lo) for a, b in secrets if a < hi and lo < b]
                        own = [x for k, x in enumerate(own) if not k or x[0] >= own[k - 1][1]]
                        out.append(json.dumps([text[lo:hi], own, of_file]))
            order = [hashlib.sha256(e.encode()).hexdigest() for e in out]
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.string()), pa.array([json.loads(e)[1] != [] for e in out], pa.bool_()), pa.array(out, pa.string())], ["o", "has", "example"])

    some = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    n = max(1, some.count())
    some = some.where(F.pmod(F.xxhash64("doc_id", F.lit("secrets")), F.lit(1_000_000)) < min(1.0, documents / n) * 1_000_000).select("text")
    found = some.mapInArrow(run, "o string, has boolean, example string").distinct()
    place = F.row_number().over(Window.partitionBy("has").orderBy("o", "example"))
    rows = sorted(found.withColumn("place", place).where(F.col("place") <= most_stretches).collect(), key=lambda r: (not r["has"], r["place"]))
    return train([e for r in rows for e in _unpacked(r["example"])])


def _unpacked(example: str) -> list[tuple[list, list]]:
    stretch, secrets, of_file = json.loads(example)
    return examples_of(stretch, [tuple(s) for s in secrets], tuple(of_file))


def find_spans(text: str, field: SecretField) -> list[tuple[int, int, str]]:
    """(start, end, kind): the patterns' matches and, as `secret`, what else the field tags; by start, then kind."""
    base = base_spans(text)
    added, of_file = [], None
    for places in stretches(text):
        of_file = of_file or file_features(text)
        begin = None
        for (a, b), tag in zip([*places, (0, 0)], [*field.decode(field.scores(features(text, places, of_file))), O], strict=True):
            if tag != I and begin is not None:
                added.append((*begin, "secret"))
                begin = None
            if tag == B:
                begin = (a, b)
            elif tag == I:
                begin = (begin[0], b)
    order = {k: i for i, k in enumerate((*KINDS, "secret"))}
    return sorted(base + _apart(added, base), key=lambda s: (s[0], order[s[2]], s[1]))


def _apart(added: list, base: list) -> list:
    """The added spans that touch no match of a pattern, by one pass over both."""
    out, ends = [], sorted(base)
    k, reach = 0, -1
    for s in sorted(added):
        while k < len(ends) and ends[k][0] < s[1]:
            reach = max(reach, ends[k][1])
            k += 1
        if reach <= s[0]:
            out.append(s)
    return out


def find_secrets(docs: DataFrame, field: SecretField | None = None) -> DataFrame:
    """Per row of docs: counts of the patterns, the digest of their spans and all spans."""
    field = field or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts, digests, texts = [[], [], []], [], []
            for text in batch.column(1).to_pylist():
                spans = find_spans(text, field) if text else []
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[2] == kind for s in spans))
                digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in KINDS).encode()).hexdigest())
                texts.append(",".join(f"{k}:{a}:{b}" for a, b, k in spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MARK = "[SECRET]"


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], MARK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, field: SecretField | None = None) -> DataFrame:
    """docs with every secret replaced by a mark, and n_chars (where there is such a column) counted anew."""
    field = field or fit(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = names.index("text")
        for batch in sliced(batches):
            texts = [redact(t, find_spans(t, field)) if t else t for t in batch.column(k).to_pylist()]
            cols = [pa.array(texts, batch.column(k).type) if i == k else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out

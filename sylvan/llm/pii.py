"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus signs, digits, schemes and identifier cues.
From each anchor a deterministic local parser reads the exact boundaries and validates what it finds. Parsers
never look back past their last match, and one that fails remembers the run of digits that it has read or reads a
bounded number of characters, so each kind's matches are leftmost and do not overlap, and the work is linear in
the text. Tasks are independent: the operator is a scan without shuffle.

Null or empty text has no spans; very long texts are read whole. Each input row gives one output row, repeated rows
the same one. An empty table gives no rows. Spans with equal starts are ordered by kind, as listed, then by end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

KINDS = ("email", "ip", "card", "phone", "address", "account")
#: Words that announce an account or identity number, and schemes that announce an address: fixed values.
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")
SCHEMES = ("://", "mailto:", "tel:", "sip:")
SCHEMA = "doc_id {id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]++")
_DOTTED = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>]*@[A-Za-z0-9.-]+(?::[0-9]+)?")
_TARGET = re.compile(r"[A-Za-z0-9._%+@-]*[A-Za-z0-9]")
_SCHEME_NAME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,15}$")
#: What may stand between a cue and its number: signs, and a word for number.
_LEAD = re.compile(r"[\s:#.=-]{0,4}(?:(?ai:no|nr|num|number)(?![A-Za-z0-9]))?[\s:#.=-]{0,4}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ -]?[0-9A-Z]){11,40}")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){5,20}(?![0-9A-Za-z])")
IBAN_READS = 64  # characters that hold any account number: at most 34 signs, with one separator after each but the last


@lru_cache(1)
def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for sign in ("@", "+", *"0123456789"):
        found.add_word(sign, ("digit" if sign.isdigit() else sign, 1))
    for word in SCHEMES:
        found.add_word(word, ("scheme", len(word)))
    for word in CUES:
        for form in (word, word.upper(), word.capitalize()):
            found.add_word(form, ("cue", len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban(code: str) -> bool:
    return 15 <= len(code) <= 34 and code[:2].isalpha() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The number after a cue: a valid IBAN, the longest of its leading groups that checks, or 6 to 17 digits."""
    at = _LEAD.match(text, at).end()
    read = text[at : at + 2 * IBAN_READS]
    if m := _IBAN.match(read):
        ends = [k.end() for k in re.finditer(r"[0-9A-Z]+", m[0])]
        return next(((at, at + e) for e in reversed(ends) if iban(re.sub("[ -]", "", m[0][:e]))), None)
    m = _NUMBER.match(read)
    return (at, at + m.end()) if m and 6 <= sum(map(str.isdigit, m[0])) <= 17 else None


def _octet(digits: str) -> bool:
    """At most 255, without leading zeros: a part of any length costs its reading once."""
    return len(digits) <= 3 and int(digits or "0") <= 255


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then in the order of KINDS; ends are exclusive code points."""
    done, spans = dict.fromkeys(KINDS, 0), []
    for end, (what, length) in anchors().iter(text):
        at = end - length + 1
        if what == "digit":
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at, m.end(), "card"))
            if at >= done["ip"]:
                m = _DOTTED.match(text, at)
                # no address begins inside a run of digits whose first digit begins none
                done["ip"] = (m or _DIGITS.match(text, at)).end()
                if m and all(_octet(p.lstrip("0")) for p in m[0].split(".")):
                    spans.append((at, m.end(), "ip"))
        elif what == "@":
            first = at
            while first > done["email"] and text[first - 1] in _LOCAL:
                first -= 1
            if first < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                spans.append((first, m.end(), "email"))
        elif what == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    spans.append((at, m.end(), "phone"))
        elif what == "scheme":
            # an address is personal where its authority names a user
            web = text.startswith("://", at)
            first = at - len(m[0]) if web and (m := _SCHEME_NAME.search(text[max(0, at - 16) : at])) else at
            m = (_AUTHORITY if web else _TARGET).match(text, end + 1)
            if first >= done["address"] and m and (web or "@" in m[0] or sum(map(str.isdigit, m[0])) >= 7):
                done["address"] = m.end()
                spans.append((first, m.end(), "address"))
        elif at >= done["account"] and not text[at - 1 : at].isalpha() and (s := _account(text, end + 1)):
            done["account"] = s[1]
            spans.append((*s, "account"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        counts, digests, texts = [[], [], [], []], [], []
        for text in batch.column(1).to_pylist():
            spans = find_spans(text) if text else []
            for k, kind in enumerate(KINDS[:4]):
                counts[k].append(sum(s[2] == kind for s in spans))
            base = ",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in KINDS[:4])
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            texts.append(",".join(f"{k}:{a}:{b}" for a, b, k in spans))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of docs: counts of the base kinds, the digest of base spans and all spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA.format(id=kind))

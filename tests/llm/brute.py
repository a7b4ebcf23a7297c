"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib
from functools import lru_cache


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set()
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(q := p.lstrip("0")) <= 3 and int("0" + q) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted(((m.start(), m.end(), k) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m)), key=lambda s: (s[0], ["email", "ip", "card", "phone"].index(s[2])))


def _iban(code):
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def account_and_address(text):
    """Each cue and scheme by itself, from left to right, with plain substring search."""
    found, done = set(), 0
    cues = sorted((m.start(), m.end()) for c in ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport") for f in (c, c.upper(), c.capitalize()) for m in re.finditer(f, text))
    for start, end in cues:
        if start < done or text[start - 1 : start].isalpha():
            continue
        at = re.match(r"[\s:#.=-]{0,4}((?ai:no|nr|num|number)(?![A-Za-z0-9]))?[\s:#.=-]{0,4}", text[end:]).end() + end
        rest, hit = text[at:], None
        if re.match(r"[A-Z]{2}[0-9]{2}([ -]?[0-9A-Z]){11}", rest):
            ends = [n for n in range(1, len(rest) + 1) if re.fullmatch(r"[A-Z]{2}[0-9]{2}([ -]?[0-9A-Z]){11,40}", rest[:n]) and not re.match("[0-9A-Z]", rest[n:])]
            hit = max((n for n in ends if _iban(re.sub("[ -]", "", rest[:n]))), default=None)
        elif m := re.match(r"[0-9]([ -]?[0-9])*(?![0-9A-Za-z])", rest):
            hit = m.end() if 6 <= len(re.sub("[^0-9]", "", m[0])) <= 17 else None
        if hit:
            found.add((at, at + hit, "account"))
            done = at + hit
    done = 0
    schemes = sorted((m.start(), m.end(), c) for c in ("://", "mailto:", "tel:", "sip:") for m in re.finditer(c, text))
    for start, end, c in sorted(schemes, key=lambda s: s[1]):
        web = c == "://"
        name = re.search(r"[A-Za-z][A-Za-z0-9+.-]{0,15}$", text[max(0, start - 16) : start]) if web else None
        first = start - len(name[0]) if name else start
        m = re.match(r"[^\s/?#\"'<>]*@[A-Za-z0-9.-]+(:[0-9]+)?" if web else r"[A-Za-z0-9._%+@-]*[A-Za-z0-9]", text[end:])
        if m and first >= done and (web or "@" in m[0] or len(re.findall("[0-9]", m[0])) >= 7):
            found.add((first, end + m.end(), "address"))
            done = end + m.end()
    return found


def secrets(text):
    text = text or ""
    kinds = [("assign", r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    return sorted(((m.start(), m.end(), k) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m)), key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def contamination(text, items):
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    words, hit, found = of(text), set(), set()
    for key, item in items:
        own = of(item)
        n = min(10, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if grams else 0):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(key))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def near(docs):
    """{doc_id: (n_shingles, component)}, all pairs compared through shared shingles."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    seen = {}
    for ids in by.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                seen[(min(a, b), max(a, b))] = seen.get((min(a, b), max(a, b)), 0) + 1
    for (a, b), n in seen.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@lru_cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def tokens(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def language_words(text):
    """Words: runs of ASCII letters and bytes beyond ASCII, lower-cased."""
    return re.findall(rb"[a-z\x80-\xff]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def language_scores(model, words):
    """word -> the score of each language, one feature at a time."""
    from sylvan.llm import language_id as L
    from sylvan.llm.common import mix, word_hashes

    mask, out, n = (1 << 32) - 1, [], model.logs.shape[2]
    for w in words:
        padded = [0, *[c + 1 for c in w], 0]
        tri = []
        for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
            x = (a * 0x9E3779B1 & mask) ^ (b * 0x85EBCA77 & mask) ^ (c * 0xC2B2AE3D & mask)
            tri.append((((x ^ x >> 15) * 0x2C1B3C6D & mask) >> 16) % n)
        own = int(mix(word_hashes(w, L._TABLE))[0]) % n
        script = max(next(s for lo, hi, s in L._LEADS if lo <= c <= hi) if not 0x80 <= c < 0xC0 else 0 for c in w)
        known = [k for k in range(len(model.languages)) if model.uses[k, script]]
        raw = [sum(float(model.logs[k, 0, t]) for t in tri) + float(model.logs[k, 1, own]) if k in known else -1e3 for k in range(len(model.languages))]
        best = max(raw)
        out.append([max(-model.most, x - best) for x in raw])
    return out


def viterbi(scores, penalty):
    """The best path's value and the path, by all pairs of states at every step."""
    value, back = list(scores[0]), []
    for row in scores[1:]:
        ways = [max((value[j] - penalty * (j != k), j == k, -j) for j in range(len(row))) for k in range(len(row))]
        back.append([-w[2] for w in ways])
        value = [w[0] + x for w, x in zip(ways, row, strict=True)]
    path = [value.index(max(value))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return max(value), path[::-1]


def quality_verdicts(rows, rules):
    """Counter of (doc_id, kept, broken rules), with each group's quantiles read off its sorted values."""
    import math
    from collections import Counter

    facts = []
    for key, text, lang, source in rows:
        n, chars, symbols, dup, repeat, failed = quality(text)
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        share = lambda a, b: max(0, a) / b if b else 0.0
        facts.append((key, lang, source, failed, {
            "mean_word": share(chars, n), "symbol_share": share(symbols, chars), "dup_line_share": share(dup - 1, lines), "repeat_share": share(repeat - 16, n),
            "bare_share": share(sum(len(w) <= 1 for w in words), n), "upper_share": share(len(re.findall("[A-Z]", text or "")), chars),
        }))
    out = Counter()
    for key, lang, source, failed, own in facts:
        group = [f for f in facts if f[1:3] == (lang, source) and not f[3]]
        if len(group) < rules.min_rows:
            group = [f for f in facts if f[1] == lang and not f[3]]
        broken = []
        for name, slack in rules.slack if group else ():
            values = sorted(f[4][name] for f in group)
            low, q1, q3, high = (values[max(0, math.ceil(q * len(values)) - 1)] for q in (rules.outer, 0.25, 0.75, 1 - rules.outer))
            reach = max(slack, rules.spread * (q3 - q1))
            if not low - reach <= own[name] <= high + reach:
                broken.append(name)
        out[(key, not failed and not broken, tuple(sorted(broken)) if not failed else ())] += 1
    return out


CRC_STATES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def damage(rows):
    """Rows (conv, turn, role, text) of one conversation after damage, in order."""
    out, sp = [], lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = "user" if d == 4 else sp(role), "" if d == 1 else re.sub("[.!?]", "", sp(text)) if d == 2 else sp(text)
        out += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        tail = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def audit_ends(kinds):
    """(cost, edits, state) of every state after the rows, by plain dynamic programming over whole strings."""
    insert = lambda best: [best.update({t: min(best.get(t, (9e9,)), (best[s][0] + 2, best[s][1] + "I"))}) for _ in range(3) for (s, r), t in CRC_STATES.items() if s in best and r != "s"]
    best = {0: (0, "")}
    for role, fault in kinds:
        insert(best)
        after = {}
        for s, (cost, audit) in best.items():
            ways = [(s, 3, "D")]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                ways += [(t, more if r == role[:1] else 2 + more, "K" if r == role[:1] else "R") for (a, r), t in CRC_STATES.items() if a == s and (r == role[:1] or r != "s")]
            for t, c, e in ways:
                after[t] = min(after.get(t, (9e9,)), (cost + c, audit + e))
        best = after
    insert(best)
    return min(best[s] for s in (0, 3) if s in best)


def mend(rows):
    """All of op11 for one conversation but its id."""
    rows = damage(rows)
    found = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] or "?" for _, r, _ in rows]
    cost, audit = audit_ends([(r, f) for (_, r, _), f in zip(rows, found, strict=True)])
    left, out = iter(rows), []
    for e in audit:
        _, role, text = next(left) if e != "I" else (None, None, "")
        if e == "K":
            out.append((role, text))
        elif e != "D":
            out.append(("assistant" if out and out[-1][0][0] == "u" else "user", text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, sha


def product_codes(rows, rounds=6, entries=16, parts=8):
    """rows (vec_id, vector, label) with kept vectors only -> {vec_id: (code, error, label_error, digest)}, by whole scans."""
    x = {i: [int(v * 4096 // 1) for v in vector] for i, vector, _ in rows}
    w = len(next(iter(x.values()))) // parts
    cut = {i: [v[p * w : p * w + w] for p in range(parts)] for i, v in x.items()}
    books = [[list(cut[i][p]) for i in sorted(cut)[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = {}
            for i in cut:
                of.setdefault(near(cut[i][p], book)[1], []).append(cut[i][p])
            for k, own in of.items():
                book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    got = {i: [near(cut[i][p], books[p]) for p in range(parts)] for i in cut}
    error = {i: sum(d for d, _ in g) for i, g in got.items()}
    by = {}
    for i, _, label in rows:
        by[label] = by.get(label, 0) + error[i]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in got[i]), error[i], by[label], sha) for i, _, label in rows}

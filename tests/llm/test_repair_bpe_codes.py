"""Operators 11 to 13 against brute force, the tokenizers library and SQL."""

import hashlib
import random
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from sylvan.llm import bpe, conversation_repair, queries, vector_codes

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, audit string, part int"
LONG = (1 << 63) - 1


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r)[:4])
    return out


def same_repairs(frame, rows, **limits):
    got, want = conversation_repair.repair_conversations(frame, **limits).collect(), by_conversation(rows)
    assert sorted(map(str, (r["conv_id"] for r in got))) == sorted(map(str, want))
    for r in got:
        assert tuple(r)[1:] == brute.mend(want[r["conv_id"]]), r["conv_id"]


ODD_TURNS = [
    (1, None, "user", "hi."), (1, None, None, "x"), (1, 3, "user", None), (1, 3, "user", "hi."), (None, 0, "assistant", "?"), (None, None, None, None), (2, 1, "", ""), (2, 1, "tool", "a b"), (2, 2, "tool", "a b"), (2, 2, "tool", "a b"), (2, 5, "system", "Be."),
    *[(7, t, ["user", "assistant"][t % 2] if t % 7 else "system", f"t{t // 3}.") for t in range(400)], *[(8, 1, "user", "same.")] * 60, *[(9, t - 5, "user", "same.") for t in range(60)],
    *[(k, 0, "user", "one row only") for k in range(100, 160)], (300, 1, "assistant", "long " * 50_000), (300, 2, "assistant", "long " * 50_000), (300, 3, "user", "　 wide spaces are no white space 　"),
]


@pytest.mark.parametrize("limits", [{}, {"long_rows": 2, "chunk_rows": 3}, {"long_rows": 0, "chunk_rows": 1, "chunk_bytes": 1}, {"long_bytes": 1000, "chunk_rows": 50}])
def test_repair_of_odd_conversations(spark, limits):
    """Null ids and turns, ties, repeated rows, conversations that vanish, and long ones cut into chunks."""
    same_repairs(spark.createDataFrame([(*r, "clash", 1) for r in ODD_TURNS], TURNS).repartition(5), ODD_TURNS, **limits)


def test_repair_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    same_repairs(table, table.collect())
    same_repairs(table, table.collect(), long_rows=4, chunk_rows=2)


def test_repair_of_nothing(spark):
    assert conversation_repair.repair_conversations(spark.createDataFrame([], TURNS)).count() == 0
    assert conversation_repair.repair_conversations(spark.createDataFrame([], TURNS), long_rows=0).count() == 0


def test_grammar_keeps_sequences():
    rnd = random.Random(5)
    plain = ["".join(rnd.choice("EIAGK") for _ in range(rnd.randrange(40))) for _ in range(200)] + ["", "E", "EEEEEEE", "EI" * 700]
    rules, short = conversation_repair.re_pair(plain)
    whole = [chr(65 + k) for k in range(16)]
    for a, b in rules:
        whole.append(whole[a] + whole[b])
    assert ["".join(whole[s] for s in x) for x in short] == plain
    assert rules and sum(map(len, short)) < sum(map(len, plain)) / 2


def test_edits_are_cheapest_and_least():
    rnd, faults = random.Random(7), ["", "blank", "duplicate", "truncated"]
    rows = [[(rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice(faults)) for _ in range(rnd.choice([0, 1, 2, 3, 9, 80]))] for _ in range(400)]
    symbols = ["".join(conversation_repair.symbol(r, faults.index(f)) for r, f in x) for x in rows]
    got = conversation_repair.cheapest(symbols)
    assert all(got[s] == brute.audit_ends(x) for s, x in zip(symbols, rows, strict=True))


def test_ropes_compare_as_their_texts():
    rnd, conv = random.Random(9), conversation_repair
    for _ in range(300):
        texts, ropes = [], []
        for _ in range(2):
            parts = [rnd.choice("KD") * rnd.choice([1, 3, 60]) for _ in range(rnd.randrange(1, 5))]
            rope = ""
            for p in parts:
                rope = conv.join(rope, p)
            texts.append("".join(parts))
            ropes.append(rope)
        assert conv.less(*ropes) == (texts[0] < texts[1])


PIECES = ["the", "ing", "aaaa", "a", "b", " ", "\n", "é", "É", "ß", "İ", "Σ", "ΑΣ", "数字", " ", "　", "'s", "'LL", "123", "<|endoftext|>", "<|startoftext|", "🙂", "é", "ﬁ", "\x1c", "\x85", "...", "!!!", "</w>", "\x00", "K", "ǅ", "-", "_", "zz" * 5]


def texts_for_bpe():
    rnd = random.Random(3)
    out = ["", None, " \n", "a" * 5001, "".join(rnd.choice("abcdeinrst") for _ in range(20_000)), "ab " * 40_000 + "x", "<|endoftext|>" * 3]
    out += ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(30))) for _ in range(600)]
    out += ["".join(chr(rnd.choice([rnd.randrange(97, 123), rnd.randrange(32, 127), rnd.randrange(0x300), rnd.randrange(0x2000, 0x3000), rnd.randrange(0x10000, 0x20000)])) for _ in range(rnd.randrange(1, 60))) for _ in range(400)]
    return out + ["".join(rnd.choice("abcdeinrst") for _ in range(rnd.randrange(1, 40))) for _ in range(1500)]


def test_bpe_equals_the_library(spark):
    tokenizer = bpe.speculative_tokenizer(bpe.vocabulary_path()).base
    texts = texts_for_bpe()
    frame = spark.createDataFrame([(None if k % 50 == 0 else k // 2, t, k, "clash") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids_sha256 string").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((None if k % 50 == 0 else k // 2, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, bpe.encode_decode(frame).collect()))) == sorted(map(str, want))
    assert bpe.encode_decode(frame.limit(0)).count() == 0


def test_compatible_pairs_are_those_that_merging_keeps():
    """Every pair of some hundred tokens, and every token alone, against exact merging."""
    own = bpe.speculative_tokenizer(bpe.vocabulary_path())
    merges, names = own.merges, [n.decode() for n in own.name]
    letters = {c: b for b, c in enumerate(bpe.byte_letters())}
    units = lambda name: [letters[c] for c in name.removesuffix("</w>")]
    rnd = random.Random(11)
    inner = [i for i in range(merges.size) if names[i] and not names[i].endswith("</w>") and not names[i].startswith("<|")]
    a = np.array(rnd.choices(inner, k=8000))
    b = np.array(rnd.choices([i for i in range(merges.size) if names[i] and not names[i].startswith("<|")], k=8000))
    found = merges.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), found.tolist(), strict=True):
        end = names[y].endswith("</w>")
        u = units(names[x]) + units(names[y])
        single = [int(merges.base[v + 256 * (end and k == len(u) - 1)]) for k, v in enumerate(u)]
        assert (merges.exact(list(single)) == [x, y]) == ok
        assert merges._exact_long(list(single)) == merges.exact(list(single))
    assert 0.2 < found.mean() < 0.999


def test_tokens_that_do_not_merge_to_themselves_are_not_guessed():
    """A vocabulary in which 'abc' can be made, but merging its bytes gives 'a', 'bc'."""
    names = [chr(97 + k) for k in range(4)] + [chr(97 + k) + "</w>" for k in range(4)] + ["bc", "ab", "abc", "bc</w>", "abc</w>"]
    merges = bpe.Merges({n: i for i, n in enumerate(names)}, [("b", "c"), ("a", "b"), ("ab", "c"), ("b", "c</w>"), ("ab", "c</w>")])
    assert [[names[i] for i in ids] for ids in merges.encode([b"abcd", b"abc", b"ab", b"abab"])] == [["a", "bc", "d</w>"], ["abc</w>"], ["a", "b</w>"], ["ab", "a", "b</w>"]]


VECTORS = "vec_id long, embedding array<float>, label int, error string, code int"


def same_codes(frame, rows):
    want = brute.product_codes(rows)
    got = vector_codes.compress(frame).collect()
    assert sorted(r["vec_id"] for r in got) == sorted(want)
    for r in got:
        code, error, label_error, sha = want[r["vec_id"]]
        assert tuple(r) == (r["vec_id"], code, min(LONG, error), min(LONG, label_error), sha)


def test_codes_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    same_codes(table.repartition(5), [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()])


def test_codes_of_odd_vectors(spark):
    """Ties, null labels, equal vectors, huge numbers, and rows that are no vectors."""
    near = lambda v: [max(-(2**62) / 4096, min(2**62 / 4096, float(np.float32(c)))) for c in v]
    odd = [(k, [float((k * j * 7919) % 13) * 10.0 ** (k % 4) for j in range(16)], k % 3 or None) for k in range(30)]
    odd += [(k, [0.25, -0.25] * 8, 5) for k in range(60, 90)] + [(40, [3e30] * 16, 1), (41, [-3e30] * 8 + [1.0] * 8, 1), (42, [5e9] * 16, None), (43, [7e14] * 16, 2)]
    no = [(50, None, 1), (51, [1.0] * 15 + [None], 1), (52, [1.0] * 15 + [float("nan")], 1), (53, [float("inf")] * 16, 1), (54, [1.0] * 9, 1), (-5, [], 1), (-6, [1.0] * 7, 1)]
    same_codes(spark.createDataFrame([(*r, "clash", 1) for r in odd + no], VECTORS).repartition(4), [(i, near(v), label) for i, v, label in odd])


def test_codes_of_few_rows(spark):
    frame = lambda rows: vector_codes.compress(spark.createDataFrame([(*r, "clash", 1) for r in rows], VECTORS)).collect()
    assert frame([]) == [] and frame([(1, None, 1)]) == []
    one = (1, [0.5] * 8, 1)
    assert [tuple(r)[:4] for r in frame([one])] == [(1, "00" * 8, 0, 0)]
    assert sorted(tuple(r)[1] for r in frame([one, one, one, (None, [1.5] * 8, None), (None, [1.5] * 8, None)])) == ["00" * 8] * 3 + ["03" * 8] * 2


def test_moved_entries_alone_give_whole_scans():
    """A round from stored distances equals a round without them, ties included."""
    rnd = np.random.default_rng(2)
    x = rnd.integers(-3, 4, (500, 2)).astype(np.int8)
    old = vector_codes.Codebooks(rnd.integers(-3, 4, (1, 6, 2)).astype(object), np.ones((1, 6), bool))
    for _ in range(50):
        entry, distance = vector_codes.assign(x, old, 0)
        moved = rnd.random((1, 6)) < 0.4
        entries = np.where(moved[..., None], rnd.integers(-3, 4, (1, 6, 2)), old.entries).astype(object)
        new = vector_codes.Codebooks(entries, (entries != old.entries).any(axis=2))
        for got, want in zip(vector_codes.assign(x, new, 0, entry, distance), vector_codes.assign(x, vector_codes.Codebooks(entries, np.ones((1, 6), bool)), 0), strict=True):
            assert got.tolist() == want.tolist()
        old = new


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_vector_codes"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in got.description]
    frame = queries.queries()[name](spark, SF).select(*names)
    assert sorted(map(tuple, frame.collect())) == sorted(got.fetchall())

"""Texts of one long run, minified data, and archives that are overwritten or plain."""

import json
import random
import sys
import time
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from sylvan.llm import license_scan, pii, secret_scan, warc

SF = "/root/testdata/sf0.001"


def test_dotted_numbers_of_any_length(spark):
    texts = ["1.2.3." + "0" * 5000 + "4", "0." * 9000 + "0", "1.2.3." + "9" * 5000, "9" * 5000 + ".1.2.3", "0" * 6000 + "255.0.0.1 256.1.1.1 00.0.0.0"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in rows:
        base = brute.pii(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.digest(base) and r["n_ip"] == sum(k == "ip" for *_, k in base)


@pytest.fixture(scope="module")
def field(spark):
    return secret_scan.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def minified(n: int) -> str:
    rnd, words = random.Random(n), "alpha beta gamma user order city name value list item price status color".split()
    rows = [{f"name{k}": rnd.choice(words), f"item{k % 7}": rnd.randrange(1000), "createdAt2": f"2024-01-0{k % 9 + 1}T10:00", "camelCaseField": f"{rnd.choice(words)}_{rnd.choice(words)}", "url": f"https://a.example/{rnd.choice(words)}/{k}"} for k in range(n)]
    return json.dumps(rows, separators=(",", ":"))


def joined(text: str) -> list[list[tuple[int, int]]]:
    """Stretches by marking characters: all around runs and cues, then whole tokens, then what touches."""
    marked = bytearray(len(text))
    for m in [*secret_scan._CUE.finditer(text), *[m for m in secret_scan._RUN.finditer(text) if secret_scan._may_be_key(m[0])]]:
        for k in range(max(0, m.start() - secret_scan.AROUND), min(len(text), m.end() + secret_scan.AROUND)):
            marked[k] = 1
    for t in secret_scan._TOKEN.finditer(text):
        if any(marked[t.start() : t.end()]):
            marked[t.start() : t.end()] = b"\1" * (t.end() - t.start())
    out, at = [], 0
    while (lo := marked.find(1, at)) >= 0:
        at = marked.find(0, lo) if marked.find(0, lo) >= 0 else len(text)
        out.append([t.span() for t in secret_scan._TOKEN.finditer(text, lo, at)])
    return out


def test_stretches_share_no_token(field):
    rnd = random.Random(4)
    texts = [minified(40), ("~" * 200 + "abc123def456") * 20, "x=y1;" * 100, "key " * 50] + ["".join(rnd.choice(["key", "=", " ", "~" * 60, "word ", "Zx9" * 6, ",", "\n", "a" * 50, "{"]) for _ in range(60)) for _ in range(300)]
    for t in texts:
        places = list(secret_scan.stretches(t))
        assert [p for p in places if p] == [p for p in joined(t) if p]
        flat = [s for p in places for s in p]
        assert flat == sorted(set(flat))
        spans = secret_scan.find_spans(t, field)
        assert len(spans) == len(set(spans))


def test_text_without_white_space(field):
    for text in (minified(6000), ("~" * 200 + "abc123def456") * 5000, minified(3000).replace('"', "")):
        began = time.time()
        spans = secret_scan.find_spans(text, field)
        assert time.time() - began < 20 and len(spans) == len(set(spans))
    text = minified(500)
    assert len(secret_scan.find_spans(text, field)) < 25  # of some 5,000 names and values
    inside = text[:-1] + ',{"api_key0":"q8Zk2Lm4Xw9RtY7Pa3Bn"}]'
    assert "q8Zk2Lm4Xw9RtY7Pa3Bn" in [inside[a:b] for a, b, _ in secret_scan.find_spans(inside, field)]


def records(spark, n):
    return spark.createDataFrame([("response", f"<urn:page:{k}>", "http://a", "2024-01-01T00:00:00Z", "sha256:0", 3, None, bytearray(b"abc")) for k in range(n)], warc.SCHEMA)


def test_archives_are_overwritten(spark, tmp_path):
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    for n, mode, whole in ((3, "overwrite", 3), (5, "overwrite", 5), (2, "append", 7), (4, "overwrite", 4)):
        records(spark, n).write.format("warc").mode(mode).save(path)
        assert spark.read.format("warc").load(path).count() == whole
    assert not list((tmp_path / "w").glob("_*"))


def test_leavings_of_lost_attempts_go_with_their_job(tmp_path):
    path = f"file://{tmp_path}"
    own, other = warc.WarcWriter({"path": path}, False), warc.WarcWriter({"path": path}, False)
    for w in (own, other):
        (tmp_path / f"_{w.job}-lost.tmp").write_bytes(b"x")
    own.commit([])
    assert [p.name for p in tmp_path.iterdir()] == [f"_{other.job}-lost.tmp"]


def test_plain_archives_and_unknown_files(spark, tmp_path):
    warc.register(spark)
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    one = lambda kind, content: b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(content), content)
    (tmp_path / "a.warc").write_bytes(one(b"response", body) + one(b"resource", b"y" * 100_000) + one(b"resource", b"") + one(b"response", b"z\r\n\r\n"))
    frame = spark.read.format("warc").load(f"file://{tmp_path}")
    assert sorted((r["record_type"], bytes(r["payload"])[:5], len(r["payload"])) for r in frame.collect()) == [("resource", b"", 0), ("resource", b"yyyyy", 100_000), ("response", b"hello", 5), ("response", b"z\r\n\r\n", 5)]
    assert frame.where("record_type = 'response'").count() == 2
    (tmp_path / "notes.txt").write_text("?")
    with pytest.raises(Exception, match="neither .warc nor .warc.gz"):
        spark.read.format("warc").load(f"file://{tmp_path}").count()


def test_short_templates_are_refused(spark):
    docs = spark.createDataFrame([(1, "all rights reserved")], "doc_id int, text string")
    with pytest.raises(ValueError, match="OWN"):
        license_scan.scan_licenses(docs, {"OWN": ("all rights reserved",)})

"""ZIP archives of CSV: members, records over several lines, broken bytes, widths."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from sylvan.sources import archive, payloads


def test_records_end_outside_quotes():
    text = 'a,b\r\n1,"x\ny"\n\n2,"say ""hi"""\n3,"open\nto the end'
    assert list(archive.records(io.StringIO(text, newline=""))) == ["a,b", '1,"x\ny"', '2,"say ""hi"""', '3,"open\nto the end']
    assert list(archive.records(io.StringIO('"' + "x\n" * 50 + "y\n"), longest=20))[-1].endswith("y")


def csv_lines(n):
    values = lambda k: {0: str(k), 16: "2020-01-05", 20: "45.5", 21: "-120.25", 22: "30000", 24: "US", 29: '"quoted, with\na line"' if k % 3 == 0 else "x", 37: "Amanita" if k % 2 else "Naïve"}
    return [",".join(values(k).get(c, "") for c in range(38)) for k in range(n)]


@pytest.fixture
def folder(spark, tmp_path):
    archive.register(spark)
    lines = csv_lines(60)
    lines[10] += ",one too many"
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data/observations.csv", "header\n" + "\n".join(lines[:40]))
        z.writestr("readme.txt", "no data")
        z.writestr("data/more.csv", b"header\n" + "\r\n".join(lines[40:]).replace("Naïve", "N\udcffve").encode("utf-8", "surrogateescape"))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("empty.csv", "")
    (tmp_path / "plain.csv").write_text("header\n" + "\n".join(lines))
    return tmp_path


def test_scan_equals_the_plain_one(spark, folder):
    frame = spark.read.format("zippedcsv").load(f"file://{folder}")
    assert frame.rdd.getNumPartitions() == 3
    genera = spark.createDataFrame([(7, "Amanita"), (8, "Naïve")], "taxon_id long, name string")
    rows = payloads.bulk_rows(payloads.bulk_lines(frame, "line", 38), genera)
    names = {payloads.BULK_COLUMNS[k]: k for k in payloads.BULK_COLUMNS}
    schema = ", ".join(f"{names.get(k, f'c{k}')} string" for k in range(38))
    plain = spark.read.schema(schema).option("header", True).option("multiLine", True).option("mode", "DROPMALFORMED").option("columnPruning", False).csv(f"file://{folder}/plain.csv")
    want = {r["id"] for r in payloads.bulk_rows(plain, genera).collect()}
    got = {r["id"]: r for r in rows.collect()}
    # the later half's broken name is none of the catalogue's
    assert set(got) == {i for i in want if i < 40 or i % 2} and 10 not in got and got[3]["obscured"] is True
    broken = payloads.bulk_lines(frame, "line", 38).where("genus LIKE 'N%ve' AND genus <> 'Naïve'").select("genus").distinct().collect()
    assert [r["genus"] for r in broken] == ["N�ve"]


def test_a_single_archive_and_its_first_lines(spark, folder):
    frame = spark.read.format("zippedcsv").option("header", "false").load(f"file://{folder}/a.zip")
    assert frame.where("line = 'header'").count() == 2


def test_written_archives_are_read_back(spark, tmp_path):
    archive.register(spark)
    rows = spark.range(100).select(F.concat(F.lit('"a\n'), F.col("id").cast("string"), F.lit('"')).alias("line")).repartition(3)
    rows.write.format("zippedcsv").mode("append").option("headerLine", "h").save(f"file://{tmp_path}/z")
    assert sorted(r["line"] for r in spark.read.format("zippedcsv").load(f"file://{tmp_path}/z").collect()) == sorted(f'"a\n{k}"' for k in range(100))
    assert not list((tmp_path / "z").glob("_*"))

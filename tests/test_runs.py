"""Ingest runs and re-checks as versions: windows, guards, broken runs, purges, reassignments and laps."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from sylvan.operators import runs
from sylvan.sources import payloads, versions
from sylvan.sources.versions import current

HOME, SINCE, TODAY = runs.Area(45.0, -120.0, 150.0), dt.date(2015, 1, 1), dt.date(2024, 6, 30)


@pytest.fixture
def root(spark):
    return f"{versions.shared_dir(spark)}/test-runs-{random.random()}"


@pytest.fixture(scope="module")
def genera(spark):
    return spark.createDataFrame([(7, "Amanita"), (8, "Boletus")], "taxon_id long, name string")


def seen(spark, *rows):
    """Observations (id, genus, day, lat, more)."""
    texts = [json.dumps({"id": i, "location": f"{lat},-120", "observed_on": day, "quality_grade": "research", "taxon": {"id": genus, "rank": "species", "iconic_taxon_id": 47170, "ancestor_ids": [genus]}, **more}) for i, genus, day, lat, more in rows]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "seq long, json string")
    return frame.select("seq", F.explode(F.array(F.from_json("json", payloads.OBSERVATION))).alias("o"))


def row(i, genus=7, day="2024-06-01", lat=45.0, **more):
    return (i, genus, day, lat, more)


def run(spark, root, genera, rows, today=TODAY, area=HOME, **more):
    return runs.ingest(spark, root, seen(spark, *rows), genera, area, SINCE, today, str(today), **more)


def held(spark, root):
    return {r["id"]: r for r in runs.tables(spark, root)[0].collect()}


def logged(spark, root):
    return {r["key"]: r["row_count"] for r in runs.tables(spark, root)[1].collect()}


def test_windows_overlap_by_a_week_and_values_merge(spark, root, genera):
    first = run(spark, root, genera, [row(1), row(2, 8, "2014-12-31"), row(3, lat=60.0), row(4, 99), row(5, day="x"), row(6, uri="a")], dt.date(2024, 6, 10))
    assert first.start == SINCE and set(held(spark, root)) == {1, 6}
    assert {tuple(r) for r in first.counts.collect()} == {("stored", 7, 2), ("no genus", None, 1), ("no place or day", 7, 1)}
    second = run(spark, root, genera, [row(1, 8), row(6, 8, "2024-06-03"), row(7, day="2024-06-02"), row(8, day="2024-06-29"), row(9, day="2024-07-01")])
    assert second.start == dt.date(2024, 6, 3)
    rows = held(spark, root)
    assert {i: r["taxon_id"] for i, r in rows.items()} == {1: 7, 6: 8, 8: 7}  # 1 and 7 lie before the window
    assert rows[6]["uri"] == "a" and rows[6]["month"] == 6
    assert logged(spark, root) == {"obs:fungi:45.0:-120.0:150.0:2015-01-01:2024-06-10": 2, "obs:fungi:45.0:-120.0:150.0:2024-06-03:2024-06-30": 2}


def test_rows_of_a_batch_fold_in_order(spark, root, genera):
    run(spark, root, genera, [row(1, uri="a"), row(1, 8), row(1, place_guess="p")])
    r = held(spark, root)[1]
    assert (r["taxon_id"], r["uri"], r["place_guess"]) == (7, "a", "p")
    assert list(logged(spark, root).values()) == [3]


def test_empty_catalogue_is_an_error_and_changes_nothing(spark, root, genera):
    run(spark, root, genera, [row(1)])
    before = current(spark, root)
    with pytest.raises(ValueError, match="catalogue"):
        run(spark, root, genera.limit(0), [row(2)])
    with pytest.raises(ValueError, match="catalogue"):
        runs.resync(spark, root, seen(spark, row(1)), genera.limit(0), 5, "2024-07-01")
    assert current(spark, root) == before


def test_a_broken_run_keeps_rows_and_reads_its_window_again(spark, root, genera):
    run(spark, root, genera, [row(1)], dt.date(2024, 6, 1))
    log = logged(spark, root)
    assert run(spark, root, genera, [row(2, day="2024-06-05")], complete=False).start == dt.date(2024, 5, 25)
    assert set(held(spark, root)) == {1, 2} and logged(spark, root) == log
    assert run(spark, root, genera, [row(2, day="2024-06-05")]).start == dt.date(2024, 5, 25)


def test_a_lost_run_leaves_the_old_version(spark, root, genera):
    run(spark, root, genera, [row(1)])
    before = current(spark, root)
    bad = seen(spark, row(2)).withColumn("o", F.col("o").withField("id", F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        runs.ingest(spark, root, bad, genera, HOME, SINCE, TODAY, "2024-07-01")
    assert current(spark, root) == before and set(held(spark, root)) == {1}


def test_one_country_counts_for_home_several_do_not(spark, root, genera):
    place = runs.Area(place=1)
    assert run(spark, root, genera, [row(1, lat=60.0)], dt.date(2024, 6, 20), place).start == SINCE
    assert logged(spark, root) == {"obs:fungi:place:1:2015-01-01:2024-06-20": 1}
    log = runs.tables(spark, root)[1]
    assert runs.window_start(log, HOME, SINCE, (1,)) == dt.date(2024, 6, 13)
    assert runs.window_start(log, HOME, SINCE, (1, 2)) == SINCE == runs.window_start(log, HOME, SINCE)
    assert runs.window_start(log, place, dt.date(2024, 6, 18)) == dt.date(2024, 6, 18)
    assert runs.window_start(log, runs.Area(place=11), SINCE) == SINCE


def test_quality_is_a_filter_where_it_is_asked_for(spark, root, genera):
    run(spark, root, genera, [row(1), row(2, quality_grade="casual"), row(3, quality_grade=None)], quality="research")
    assert set(held(spark, root)) == {1}


def test_recheck_purges_reassigns_and_stamps(spark, root, genera):
    run(spark, root, genera, [row(i, uri=f"u{i}") for i in range(1, 8)])
    live = seen(spark, row(1, obscured=True), row(2, 8), row(3, 99), row(4, day="x"), row(6, 8), row(6, 7), row(77))
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 6)], "id long")
    assert runs.recheck_batch(spark, root, live, genera, ids, "2024-07-01") == runs.Checked(6, 3, 1)
    rows = held(spark, root)
    assert set(rows) == {1, 2, 6, 7}
    assert (rows[1]["obscured"], rows[1]["uri"], rows[2]["taxon_id"], rows[6]["taxon_id"]) == (True, "u1", 8, 7)
    assert [i for i, r in rows.items() if r["revalidated_at"]] == [1, 2, 6]


def test_a_broken_recheck_leaves_what_it_has_not_seen(spark, root, genera):
    run(spark, root, genera, [row(i) for i in range(1, 5)])
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3)], "id long")
    assert runs.recheck_batch(spark, root, seen(spark, row(1), row(2, 99)), genera, ids, "2024-07-01", complete=False) == runs.Checked(2, 1, 0)
    assert set(held(spark, root)) == {1, 3, 4}


def test_resync_ends_on_a_short_batch_or_after_a_lap(spark, root, genera):
    run(spark, root, genera, [row(i) for i in range(1, 8)])
    live = seen(spark, *[row(i) for i in range(1, 8)])
    assert [b.checked for b in runs.resync_until_done(spark, root, live, genera, 3, "2024-07-01")] == [3, 3, 3]
    assert [b.checked for b in runs.resync_until_done(spark, root, live, genera, 7, "2024-07-02")] == [7]
    assert [b.checked for b in runs.resync_until_done(spark, root, live, genera, 10, "2024-07-03")] == [7]
    assert [b.checked for b in runs.resync_until_done(spark, root, live, genera, 2, "2024-07-04", 2)] == [2, 2]
    gone = runs.resync_until_done(spark, root, live.where(F.col("o.id") > 6), genera, 3, "2024-07-05")
    assert sum(b.purged for b in gone) == 6 and set(held(spark, root)) == {7}
    assert logged(spark, root) != {}


def test_suspects_alone_are_revalidated(spark, root, genera):
    run(spark, root, genera, [row(1), row(2), row(3, 8)])
    suspects = spark.createDataFrame([(7,)], "taxon_id long")
    assert runs.revalidate(spark, root, seen(spark, row(2, 8), row(3, 7)), genera, suspects, "2024-07-01") == runs.Checked(2, 1, 1)
    assert {i: r["taxon_id"] for i, r in held(spark, root).items()} == {2: 8, 3: 8}

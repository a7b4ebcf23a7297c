"""Tables that follow merges: equal to a full build, exact after retractions, counted once, read from changed groups alone."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from sylvan.operators import phenology, seasons
from sylvan.sources import versions

SCHEMA = "id long, taxon_id long, lat double, lng double, observed_on date, month short, quality_grade string, obscured boolean"


@pytest.fixture
def root(spark):
    return f"{versions.shared_dir(spark)}/test-seasons-{random.random()}"


def drawn(rng, k):
    """Rows with nulls in any column and places that are no round numbers."""
    maybe = lambda v: None if rng.random() < 0.1 else v
    day = maybe(dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(90)))
    return (k, maybe(rng.randrange(3)), maybe(rng.uniform(40, 42)), maybe(rng.uniform(-122, -120)), day, maybe(rng.randrange(1, 4)), maybe(rng.choice(["research", "research", "needs_id"])), maybe(rng.random() < 0.3))


def same(got, want):
    short = lambda rows, cols: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows.select(*cols).collect()), key=lambda r: [(v is not None, str(v)) for v in r])
    assert short(got, want.columns) == short(want, want.columns)


def as_built(spark, root, rows):
    """All three tables are those of a full build over rows."""
    frame = spark.createDataFrame(rows, SCHEMA)
    same(seasons.phenology(spark, root), phenology.build_phenology(frame, 1.0))
    same(seasons.daily(spark, root), phenology.build_daily(frame, 1.0))
    # a row with one coordinate alone has a region but no mean for the other: those rows are compared by counts
    same(seasons.regions(spark, root).select("region_id", "n_obs", "n_taxa"), phenology.build_regions(frame, 1.0).select("region_id", "n_obs", "n_taxa"))
    placed = [r for r in rows if r[2] is not None and r[3] is not None]
    if placed == rows:
        same(seasons.regions(spark, root), phenology.build_regions(frame, 1.0))


def test_merges_in_a_row_equal_a_full_build(spark, root):
    rng = random.Random(3)
    now = {k: drawn(rng, k) for k in range(120)}
    seasons.start(spark.createDataFrame(list(now.values()), SCHEMA), 1.0, root)
    as_built(spark, root, list(now.values()))
    for batch in range(1, 4):
        before, ids = dict(now), [rng.randrange(160) for _ in range(60)]
        for k in ids:
            if rng.random() < 0.3:
                now.pop(k, None)
            elif rng.random() < 0.9:
                now[k] = drawn(rng, k)
        a, b = (spark.createDataFrame(list(x.values()), SCHEMA) for x in (before, now))
        seasons.follow(seasons.images(a, b, spark.createDataFrame([(k,) for k in ids], "id long")), 1.0, root, batch)
        as_built(spark, root, list(now.values()))
    last = seasons.compact(spark, root)
    assert last == 4
    as_built(spark, root, list(now.values()))


def test_nothing_is_left_of_rows_that_went(spark, root):
    rows = [(k, 1, 40.1 + k / 7, -120.3 - k / 11, dt.date(2020, 1, 1), 1, "research", k % 2 == 0) for k in range(5)]
    a, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    seasons.start(a, 10.0, root)
    seasons.follow(seasons.images(a, none, a), 10.0, root, 1)
    assert seasons.phenology(spark, root).count() == seasons.regions(spark, root).count() == seasons.daily(spark, root).count() == 0
    assert seasons.compact(spark, root) == 2
    # added up, no partial row is left, sums of inexact places included
    assert seasons.parts(spark, root, "daily").count() == seasons.parts(spark, root, "monthly").count() == 0
    seasons.follow(seasons.images(none, a, a), 10.0, root, 3)
    same(seasons.regions(spark, root), phenology.build_regions(a, 10.0))


def test_a_batch_counts_once_and_only_when_whole(spark, root):
    a = spark.createDataFrame([(1, 1, 40.5, -120.5, dt.date(2020, 1, 1), 1, "research", False)], SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    seasons.start(none, 1.0, root)
    came = seasons.images(none, a, a)
    # a run that is lost after its first table: readers do not see it, and its number is taken again
    seasons._partial(phenology.binned(came, 1.0)).write.parquet(f"{root}/daily/batch=1")
    assert seasons.daily(spark, root).count() == 0
    for _ in range(2):
        seasons.follow(came, 1.0, root, 1)
    assert [r["cnt"] for r in seasons.phenology(spark, root).collect()] == [1]
    seasons.compact(spark, root)
    seasons.follow(came, 1.0, root, 1)
    assert [r["cnt"] for r in seasons.phenology(spark, root).collect()] == [1]


def test_a_merge_reads_only_what_it_touches(spark, root):
    rows = [(k, k % 5, 40.0 + k % 9, -120.0, dt.date(2020, 1, 1 + k % 20), 1, "research", False) for k in range(200)]
    a = spark.createDataFrame(rows, SCHEMA)
    b = a.withColumn("taxon_id", F.when(F.col("id") == 7, 99).otherwise(F.col("taxon_id")))
    seasons.start(a, 1.0, root)
    seasons.follow(seasons.images(a, b, spark.createDataFrame([(7,), (8,)], "id long")), 1.0, root, 1)
    # row 8 came as it was; row 7 leaves one group and makes another
    own = spark.read.parquet(f"{root}/monthly/batch=1")
    assert sorted((r["taxon_id"], r["cnt"]) for r in own.collect()) == [(2, -1), (99, 1)]
    got = {(r["region_id"], r["taxon_id"]): r["cnt"] for r in seasons.changed_groups(spark, root, 1).collect()}
    assert got == {("47_-120", 99): 1, ("47_-120", 2): sum(k % 5 == 2 and k % 9 == 7 for k in range(200)) - 1}


def test_folders_before_the_last_whole_batches_go(spark, root):
    a = spark.createDataFrame([(1, 1, 40.5, -120.5, dt.date(2020, 1, 1), 1, "research", False)], SCHEMA)
    seasons.start(a, 1.0, root)
    for _ in range(2):
        seasons.compact(spark, root)
    assert sorted(r["batch"] for r in spark.read.parquet(f"{root}/batches").collect()) == [1, 2]
    assert [r["cnt"] for r in seasons.phenology(spark, root).collect()] == [1]

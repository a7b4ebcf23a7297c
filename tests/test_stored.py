"""Laid-out and published tables: what a search reads, when a version is built anew, pages by cursor."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F
from sylvan.operators import calendar, phenology, proximity
from sylvan.plans import catalog
from sylvan.sources import layout, stored, versions, views

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_curve_keeps_neighbours_together(spark):
    rows = spark.createDataFrame([(float(a), float(b)) for a in range(-90, 91, 15) for b in range(-180, 181, 15)] + [(None, 1.0)], "lat double, lng double").select("lat", "lng", layout.curve("lat", "lng").alias("c")).collect()
    spread = lambda x: sum((x >> k & 1) << 2 * k for k in range(16))
    step = lambda x, low, span: max(0, min(65535, int((x - low) / span * 65536)))
    for r in rows:
        assert r["c"] == (None if r["lat"] is None else spread(step(r["lat"], -90, 180)) * 2 + spread(step(r["lng"], -180, 360)))


def test_curve_works_out_a_place_once(spark):
    rows = spark.createDataFrame([(45.0, -120.0)], "lat double, lng double").select(layout.curve("lat", "lng").alias("c"))
    assert plan(rows).count("FLOOR(") == 2  # one for each axis: copies make a method that is too large to be compiled


@pytest.mark.parametrize("name,by,search", [("camps", layout.POINT, proximity.camps_near), ("trails", layout.EXTENT, proximity.trails_near), ("land", layout.EXTENT, proximity.land_near)])
def test_a_search_reads_few_files(spark, name, by, search):
    table = getattr(views, name)(spark, SF)
    path = f"{versions.shared_dir(spark)}/test-layout-{name}-{random.random()}"
    layout.write(table, path, by, rows_per_file=max(1, table.count() // 40))
    near = layout.near(spark, path, 46.0, -121.0, 25.0)
    whole = spark.read.parquet(path)
    assert 30 <= len(whole.inputFiles()) <= 50 and len(near.inputFiles()) <= len(whole.inputFiles()) / 3
    got, want = search(near, 46.0, -121.0, 25.0), search(table, 46.0, -121.0, 25.0)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 0
    pushed = plan(got).split("PushedFilters: [")[1].split("]")[0]
    for c in set(by.values()):
        assert f"({c}," in pushed.replace("ThanOrEqual", "")
    # the derived table's scan gets none of these limits
    assert "ThanOrEqual(" not in plan(want).split("PushedFilters: [")[1].split("]")[0]
    assert layout.near(spark, path, -50.0, 100.0, 10.0).count() == 0


def test_points_far_from_everything_and_without_place(spark):
    path = f"{versions.shared_dir(spark)}/test-layout-nulls-{random.random()}"
    layout.write(spark.createDataFrame([(1, 45.0, -120.0), (2, None, -120.0), (3, None, None)], "id int, lat double, lng double"), path, rows_per_file=1)
    assert [r["id"] for r in proximity.camps_near(layout.near(spark, path, 45.0, -120.0, 5.0).withColumn("free", F.lit(True)), 45.0, -120.0, 5.0).collect()] == [1]
    assert spark.read.parquet(path).count() == 3


def test_versions_are_built_once_for_each_state_of_the_sources(spark, tmp_path):
    source = tmp_path / "sf"
    source.mkdir()
    for t in ("supplier", "part", "customer", "lineitem", "orders"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", source / f"{t}.parquet")
    d = f"file://{source}"
    first, season = stored.places(spark, d), stored.seasons(spark, d, 1.0)
    assert stored.places(spark, d) == first and stored.seasons(spark, d, 1.0) == season
    assert stored.seasons(spark, d, 2.0) != season
    shutil.copy("/root/testdata/sf0.01/supplier.parquet", source / "supplier.parquet")
    second = stored.places(spark, d)
    assert second != first and stored.seasons(spark, d, 1.0) == season
    assert spark.read.parquet(f"{second}/camps").count() == views.camps(spark, d).count() > spark.read.parquet(f"{first}/camps").count()


def test_a_search_builds_its_own_table_alone(spark, tmp_path):
    for t in ("supplier", "part"):  # and no customer, of which land is made
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    d, near = f"file://{tmp_path}", catalog.queries()["trails_near_with_camp"]
    assert sorted(map(str, near(spark, d).collect())) == sorted(map(str, near(spark, "/root/testdata/sf0.001").collect()))
    assert versions.current(spark, stored._root(spark, d, "trails-1000000")) and versions.current(spark, stored._root(spark, d, "camps-1000000")) is None


def test_published_tables_equal_a_fresh_build(spark):
    rows = views.line_observations(spark, SF)
    for name, build in (("phenology", phenology.build_phenology), ("regions", phenology.build_regions), ("daily", phenology.build_daily)):
        fresh, kept = build(rows, 1.0), stored.season_table(spark, SF, name, 1.0)
        assert fresh.schema.simpleString() == kept.schema.simpleString()
        assert fresh.exceptAll(kept).isEmpty() and kept.exceptAll(fresh).isEmpty()


@pytest.mark.parametrize("name", ["rank_destinations", "destinations_in_order", "rank_destinations_species", "rank_corridor", "rank_around_a_point", "place_calendar", "calendar_heat", "calendar_top15", "plan_candidates", "plan_route", "plan_trip", "auto_destination"])
def test_rankings_read_published_tables_alone(spark, name):
    frame = catalog.queries()[name](spark, SF)
    assert not any("lineitem" in f for f in frame.inputFiles()) and any("phenology" in f for f in frame.inputFiles())


def test_a_page_by_cursor_is_the_page_by_offset(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice([None, *[dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(9)) for _ in range(6)]]), "research" if rnd.random() < 0.9 else "casual", 45.0, -120.0) for k in range(150)]
    table = spark.createDataFrame(rows, "id long, observed_on date, quality_grade string, lat double, lng double")
    days = calendar.days_of(table)
    kept = sorted([r for r in rows if r[2] == "research"], key=lambda r: (r[1] is None, r[1] or dt.date.min, r[0]), reverse=True)
    cursor, at = None, 0
    while True:
        page = calendar.page_after(table, days, 1.0, 10, cursor)
        assert "Offset" not in page._jdf.queryExecution().optimizedPlan().toString()
        got = [(r["observed_on"], r["id"]) for r in page.collect()]
        assert got == [(r[1], r[0]) for r in kept[at : at + 11]]
        if len(got) <= 10:
            break
        cursor, at = got[9], at + 10
    assert at >= 120
    assert calendar.page_after(table, days, 1.0, 10, (dt.date(2020, 1, 1), 5)).count() == 0


def test_a_deep_page_reads_its_days(spark):
    folder = stored.sightings(spark, SF, rows_per_file=1000)
    rows, days = spark.read.parquet(f"{folder}/by_day"), spark.read.parquet(f"{folder}/days")
    page = calendar.page_after(rows, days, 1.0, 12, (dt.date(1997, 3, 1), 100))
    limits = plan(page).split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(observed_on,1997-02" in limits and "LessThanOrEqual(observed_on,1997-03-01)" in limits


def test_points_and_days_are_built_apart(spark, tmp_path):
    shutil.copyfile("/root/testdata/sf0.001/orders.parquet", tmp_path / "orders.parquet")
    d = f"file://{tmp_path}"
    near = catalog.queries()["precise_observations"](spark, d)
    assert all("/points-" in f for f in near.inputFiles()) and versions.current(spark, stored._root(spark, d, "sightings-1000000")) is None
    folder = stored.sightings(spark, d)
    assert spark.read.parquet(f"{folder}/by_day").count() == spark.read.parquet(f"{stored.points(spark, d)}/points").count() == views.order_observations(spark, d).count()
    assert not versions._files(spark, f"{folder}/points")[1].exists(versions._files(spark, f"{folder}/points")[0])


def test_places_in_order(spark):
    rows = [(k, None if k % 5 == 0 else dt.date(2024, 1, 1 + k % 7)) for k in range(60)]
    got = calendar.with_places(spark.createDataFrame(rows, "id long, observed_on date")).collect()
    order = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or dt.date.max).toordinal(), r[0]))
    assert {r["id"]: r["place"] for r in got} == {k: n + 1 for n, (k, _) in enumerate(order)}

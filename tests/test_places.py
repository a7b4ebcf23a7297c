"""Names to places, places to names, devices, and lists on ranked rows."""

import random

import pytest
from pyspark.sql import functions as F
from sylvan.functions import geo
from sylvan.operators import devices, places, planner, proximity
from sylvan.plans import catalog
from sylvan.schemas import LOCATIONS, SELECTED


def test_lookup_against_all_names(spark):
    rnd, words = random.Random(2), "lake river mount north fork salmon creek great bear état".split()
    named = [(k, " ".join(rnd.choice(words).title() for _ in range(rnd.randrange(1, 5))), rnd.randrange(3)) for k in range(200)] + [(900, "--", 1), (901, None, 1)]
    asked = [(k, ", ".join(rnd.choice(words).upper() for _ in range(rnd.randrange(1, 4)))) for k in range(60)] + [(100, "nowhere lake"), (101, ""), (102, None), (103, " ?! "), (104, "lake LAKE Lake")]
    rows = spark.createDataFrame(named, "place long, name string, weight int")
    got = {r["question"]: r["place"] for r in places.lookup(spark.createDataFrame(asked, "question int, text string"), places.index(rows)).collect()}
    cut = lambda t: {w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()}
    for q, text in asked:
        fits = [(len(cut(n)), -w, p) for p, n, w in named if cut(text) and cut(text) <= cut(n)]
        assert got.get(q) == (min(fits)[2] if fits else None), text


def test_resolve_takes_coordinates_as_they_are(spark):
    named = places.index(spark.createDataFrame([(1, "Bear Lake", 5, 42.0, -111.3)], "place long, name string, weight int, lat double, lng double"))
    asked = spark.createDataFrame([(1, "45.5, -120.25"), (2, "bear lake"), (3, "95, 10"), (4, None)], "question int, text string")
    assert {r["question"]: tuple(r)[1:] for r in places.resolve(asked, named).collect()} == {1: ("45.5000, -120.2500", 45.5, -120.25), 2: ("Bear Lake", 42.0, -111.3)}


def test_nearest_site_gives_the_least_of_equals(spark):
    points = spark.createDataFrame([("p", 0.0, 0.0), ("q", 80.0, 179.9)], "key string, lat double, lng double")
    sites = spark.createDataFrame([("b", 0.0, 1.0), ("a", 0.0, -1.0), ("c", 0.0, 1.0), ("d", 80.0, -179.9)], "site string, s_lat double, s_lng double")
    assert {r["key"]: r["site"] for r in proximity.nearest_site(points, sites).collect()} == {"p": "a", "q": "d"}
    assert [r["site"] for r in proximity.nearest_site(points, sites.limit(0)).collect()] == [None, None]


def test_nearest_site_meets_few_sites_and_finds_the_nearest(spark):
    rnd = random.Random(7)
    some = lambda n: [(rnd.uniform(40, 41), rnd.uniform(-121, -120)) for _ in range(n)] + [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(n // 4)] + [(90.0, 0.0), (-90.0, 7.0), (0.0, 180.0), (0.0, -180.0)]
    points, sites = list(enumerate(some(400))), list(enumerate(some(800)))
    p = spark.createDataFrame([(k, *at) for k, at in points] + [(-1, None, None)], "key int, lat double, lng double")
    s = spark.createDataFrame([(k, *at) for k, at in sites] + [(-1, None, None)], "site int, s_lat double, s_lng double")
    pairs = p.alias("p").crossJoin(s.alias("s")).select("key", "site", geo.haversine_km("lat", "lng", "s_lat", "s_lng").alias("km")).where("km IS NOT NULL")
    want = {r["key"]: r["km"] for r in pairs.groupBy("key").agg(F.min("km").alias("km")).collect()}
    got = {r["key"]: r["km"] for r in proximity.nearest_site(p, s).collect()}
    assert got == {**want, -1: None}
    within = {r["key"]: r["km"] for r in proximity.nearest_site(p, s, 5.0).collect()}
    assert within == {k: km if km is not None and km <= 5.0 else None for k, km in got.items()}
    cells = proximity.in_cells(p)
    there = proximity.candidates(cells, s.withColumn("lead", F.lit(0.0))).count()
    assert there < 10 * cells.select("i", "j", "k").distinct().count()
    plan = proximity.nearest_site(p, s)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # rows that Spark's sizes do not count, and so broadcasts


def test_nearest_site_reads_points_few_times(spark, tmp_path):
    some = [(k, *((None, 1.0) if k % 10 == 0 else (40.0 + k % 7, -120.0 + k % 3)), f"n{k}") for k in range(200)]  # 21 places
    spark.createDataFrame(some, "key int, lat double, lng double, name string").write.parquet(f"{tmp_path}/points")
    sites = spark.createDataFrame([(k, 40.0 + k / 9, -119.5) for k in range(60)], "site int, s_lat double, s_lng double")
    points = spark.read.parquet(f"{tmp_path}/points")
    rows = proximity.nearest_site(points, sites)
    got = {r["key"]: (r["name"], r["km"]) for r in rows.collect()}
    pairs = points.crossJoin(sites).groupBy("key", "name").agg(F.min(geo.haversine_km("lat", "lng", "s_lat", "s_lng")).alias("km"))
    assert got == {r["key"]: (r["name"], r["km"]) for r in pairs.collect()} and len(got) == 200
    made = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert made.count("FileScan parquet") <= 3  # not once for each level of cells


@pytest.mark.parametrize("name", ["trails_nearest_camp", "trails_near_with_camp"])
def test_nearest_camps_broadcast_cells_alone(spark, name):
    made = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in made and "rightHint=(strategy=broadcast)" in made
    # of the sites' cells, those whose number the sphere bounds
    assert made.count("strategy=broadcast") == proximity.BOUNDED


def test_lookup_meets_copies_of_names_and_questions_once(spark):
    named = [(k, ["Bear Lake", "lake bear", "Salmon Creek", "Salmon Creek North"][k % 4], k % 7) for k in range(400)]
    asked = [(k, ["lake, bear", "BEAR lake", "salmon", "no salmon"][k % 4]) for k in range(200)]
    rows = places.lookup(spark.createDataFrame(asked, "question int, text string"), places.index(spark.createDataFrame(named, "place long, name string, weight int")))
    best = lambda names: min((-w, p) for p, n, w in named if n in names)[1]
    want = [best(("Bear Lake", "lake bear")), best(("Bear Lake", "lake bear")), best(("Salmon Creek",))]
    assert {r["question"]: r["place"] for r in rows.collect()} == {k: want[k % 4] for k in range(200) if k % 4 < 3}
    made = rows._jdf.queryExecution().executedPlan()
    assert "BroadcastHashJoin" not in made.toString() and "HashAggregate(keys=[wanted" in rows._jdf.queryExecution().executedPlan().toString()


def test_devices(spark):
    some = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "device_id string")
    saved = devices.save_locations(spark.createDataFrame([("b", "old", 1.0, 2.0, 3.0)], LOCATIONS), spark.createDataFrame([("b", "new", 4.0, 5.0, 0.0, 2), ("b", "newer", 6.0, 7.0, 0.0, 3), ("c", "c", 8.0, 9.0, 10.0, 1)], LOCATIONS + ", seq int"))
    kept = devices.delete_locations(saved, spark.createDataFrame([("c",)], "device_id string"))
    got = {r["device_id"]: tuple(r)[1:] for r in devices.homes(some, kept, ("home", 47.0, -122.0, 150.0)).collect()}
    assert got == {"a": ("home", 47.0, -122.0, 150.0, False), "b": ("newer", 6.0, 7.0, 150.0, True), "c": ("home", 47.0, -122.0, 150.0, False)}
    pairs = lambda *p: spark.createDataFrame(list(p), SELECTED)
    chosen = devices.remove_genera(devices.add_genera(pairs(("a", 1)), pairs(("a", 1), ("a", 3), ("a", 2), ("a", 3), ("b", 9))), pairs(("b", 9), ("z", 1)))
    assert {r["device_id"]: r["taxa"] for r in devices.filters(some, chosen).collect()} == {"a": [1, 2, 3], "b": [], "c": []}


def test_header_of_a_plan_without_stops_or_goal(spark):
    kind = "key string, lat double, lng double, score double, distance_km double"
    walked = planner.walk(spark.createDataFrame([], kind), (45.0, -120.0), 100.0)
    goal = spark.createDataFrame([], "region_id string, center_lat double, center_lng double")
    r = planner.header(walked, (45.0, -120.0), goal, 80.0, [4, 5]).first()
    assert (r["destination_lat"], r["destination_name"], r["n_stops"], r["total_drive_km"], r["skipped_unreachable"], r["months"]) == (45.0, None, 0, 0.0, 0, [4, 5])
    far = planner.walk(spark.createDataFrame([("x", 45.1, -120.0, 1.0, 1.0), ("y", 60.0, -120.0, 2.0, 2.0)], kind), (45.0, -120.0), 100.0)
    r = planner.header(far, (45.0, -120.0), goal.union(spark.createDataFrame([("y", 60.0, -120.0)], goal.schema)), 80.0, [4]).first()
    assert (r["destination_lat"], r["destination_name"], r["n_stops"], r["skipped_unreachable"]) == (60.0, "y", 1, 1)
    assert geo.region_radius_km(0.25) == 0.25 * 111 / 2

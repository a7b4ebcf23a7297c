"""Pages up to their end, failures apart, and layer ingests over circles and tiles."""

import json

import pytest
from pyspark.sql import functions as F
from sylvan.operators import layers
from sylvan.schemas import CAMPSITES, INGEST_LOG, TRAILS
from sylvan.sources import pages as pg


def kept(spark, source, given, **more):
    """{query: (state, pages, items)} and {query: pages read} of (query, page, json) rows."""
    frame = spark.createDataFrame(given, "query string, page int, json string").repartition(3)
    report = {r["query"]: (r["state"], r["pages"], r["items"]) for r in pg.report(frame, pg.SOURCES[source], ["query"]).collect()}
    read = {}
    for r in pg.paged(frame, pg.SOURCES[source], ["query"]).collect():
        read.setdefault(r["query"], []).append(r["page"])
    assert {q: len(p) for q, p in read.items()} == {q: n for q, (_, n, _) in report.items() if n}
    return report, {q: sorted(p) for q, p in read.items()}


def test_observations_end_with_an_empty_or_short_page(spark):
    page = lambda n, **more: json.dumps({"results": [{"id": k} for k in range(n)], **more})
    report, read = kept(spark, "observations", [("a", 0, page(200)), ("a", 1, page(3)), ("a", 2, page(200)), ("b", 0, page(200)), ("b", 1, page(0)), ("b", 2, page(5)), ("c", 0, page(200)), ("d", 0, page(200)), ("d", 2, page(1)), ("e", 1, page(1)), ("f", 0, page(0))])
    assert report == {"a": ("complete", 2, 203), "b": ("complete", 2, 200), "c": ("cut", 1, 200), "d": ("cut", 1, 200), "e": ("failed", 0, 0), "f": ("complete", 1, 0)}
    assert read["a"] == [0, 1] and read["d"] == [0]


def test_campgrounds_end_at_the_total(spark):
    page = lambda n, total: json.dumps({"RECDATA": [{"FacilityID": str(k)} for k in range(n)], "METADATA": {"RESULTS": {"TOTAL_COUNT": total}} if total is not None else {}})
    report, _ = kept(spark, "campgrounds", [("a", 0, page(50, 100)), ("a", 1, page(50, 100)), ("a", 2, page(50, 100)), ("b", 0, page(50, None)), ("b", 1, page(7, None)), ("c", 0, page(50, 50)), ("d", 0, page(20, 500)), ("d", 1, page(20, 500))])
    assert report == {"a": ("complete", 2, 100), "b": ("complete", 2, 57), "c": ("complete", 1, 50), "d": ("complete", 1, 20)}


def test_land_goes_on_only_while_a_full_page_says_so(spark):
    page = lambda n, more: json.dumps({"features": [{"properties": {"OBJECTID": str(k)}} for k in range(n)], **({"exceededTransferLimit": more} if more is not None else {})})
    given = [("a", 0, page(1000, True)), ("a", 1, page(1000, None)), ("a", 2, page(9, None)), ("b", 0, page(999, True)), ("b", 1, page(5, None)), ("c", 0, page(1000, False)), ("c", 1, page(5, None))]
    assert kept(spark, "land", given)[0] == {"a": ("complete", 2, 2000), "b": ("complete", 1, 999), "c": ("complete", 1, 1000)}


@pytest.mark.parametrize("bad", ["<html>busy</html>", None, '{"features": 5}', "[1, 2]", '{"features": [{"geometry": 7}]}'])
def test_a_failed_source_leaves_the_others(spark, bad):
    full = json.dumps({"features": [{"properties": {"OBJECTID": str(k)}} for k in range(1000)], "exceededTransferLimit": True})
    report, read = kept(spark, "land", [("blm", 0, full), ("blm", 1, bad), ("blm", 2, full), ("usfs", 0, json.dumps({"features": []})), ("tribal", 0, bad)])
    assert report == {"blm": ("failed", 1, 1000), "usfs": ("complete", 1, 0), "tribal": ("failed", 0, 0)} and read["blm"] == [0]


def facility(i, lat, lng, name="Camp"):
    return {"FacilityID": str(i), "FacilityName": name, "FacilityLatitude": lat, "FacilityLongitude": lng}


def test_campground_layer(spark):
    areas = spark.createDataFrame([("home", 45.0, -120.0, 100.0), ("known", 30.0, -100.0, 50.0), ("broken", 60.0, -150.0, 100.0)], "area string, lat double, lng double, radius_km double")
    log = spark.createDataFrame([("camps:ridb:30.0:-100.0:80.0", None, 5, 30.0, -100.0, 80.0)], INGEST_LOG)
    stored = spark.createDataFrame([("ridb:1", "old", "campground", "fee", True, 1.0, 1.0, "ridb", "u"), ("osm:node/1", "kept", "reported", None, None, 1.0, 1.0, "osm", "u")], CAMPSITES)
    ask = layers.circles_to_ask(areas, log, "camps:ridb:", 60.0)
    circles = {}
    for r in ask.collect():
        circles.setdefault(r["area"], []).append(r["circle"])
    assert set(circles) == {"home", "broken"} and len(circles["home"]) > 4
    page = lambda *f: json.dumps({"RECDATA": list(f)})
    empty = [(a, c, 0, page()) for a in circles for c in circles[a][2:]]
    given = [("home", 0, 0, page(facility(1, 45.1, -120.0, "first"), facility(2, 47.0, -120.0))), ("home", 1, 0, page(facility(1, 45.2, -120.0, "second"), facility(3, 45.0, -120.5))), ("broken", 0, 0, page(facility(4, 60.0, -150.0))), ("broken", 1, 0, "no json"), ("known", 0, 0, page(facility(9, 30.0, -100.0)))]
    sites, after = layers.ingest_campgrounds(stored, log, areas, spark.createDataFrame(given + empty, "area string, circle int, page int, json string"), "2024-01-02", 60.0)
    rows = {r["id"]: r for r in sites.collect()}
    assert set(rows) == {"osm:node/1", "ridb:1", "ridb:3", "ridb:4"}  # 2 lies outside, 9 in an area that is covered
    assert (rows["ridb:1"]["name"], rows["ridb:1"]["lat"], rows["ridb:1"]["fee"]) == ("second", 45.2, None)
    assert {r["key"]: r["row_count"] for r in after.collect()} == {"camps:ridb:30.0:-100.0:80.0": 5, "camps:ridb:45.0:-120.0:100.0": 2}


def test_trail_layer(spark):
    regions = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 3.0), (2, 10.0, 0.0, 12.0, 4.0), (3, 0.0, 0.0, 1.0, 1.0), (4, 50.0, 0.0, 51.0, 1.0)], "place int, min_lat double, min_lng double, max_lat double, max_lng double")
    log = spark.createDataFrame([("trails:place:3", None, 7, None, None, None)], INGEST_LOG)
    assert {(r["place"], r["tile"]) for r in layers.tiles_to_ask(regions, log, 2.0).collect()} == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (4, 0)}
    way = lambda i, name: {"type": "way", "id": i, "tags": {"name": name}, "geometry": [{"lat": 1.0, "lon": 1.0}, {"lat": 2.0, "lon": 2.0}]}
    tile = lambda *e: json.dumps({"elements": list(e)})
    given = [(1, 0, tile(way(1, "a"), way(2, "b"), way(1, "a2"))), (1, 1, tile(way(1, "c"))), (1, 2, tile()), (1, 3, tile(way(5, "e"))), (2, 0, tile(way(3, "x"))), (2, 1, "busy"), (3, 0, tile(way(9, "y")))]
    trails, after = layers.ingest_trails(spark.createDataFrame([], TRAILS), log, regions, spark.createDataFrame(given, "place int, tile int, json string"), "2024-01-02", 2.0)
    assert {r["id"]: r["name"] for r in trails.collect()} == {"osm:way/1": "c", "osm:way/2": "b", "osm:way/3": "x", "osm:way/5": "e"}
    # 1 came whole and counts its shared way twice; 2 failed and 4 never came
    assert {r["key"]: r["row_count"] for r in after.collect()} == {"trails:place:3": 7, "trails:place:1": 4}
    assert after.where(F.col("key") == "trails:place:1").first()["lat"] is None


def test_tiles_are_dealt_over_tasks_by_their_number(spark):
    regions = spark.range(6).selectExpr("id AS place", "45.0D AS min_lat", "-121.0D AS min_lng", "45.5D AS max_lat", "-120.5D AS max_lng")
    text = '{"elements":[{"type":"way","id":%d,"geometry":[{"lat":45.0,"lon":-121.0},{"lat":45.1,"lon":-121.0}]},{"type":"way","id":7,"geometry":[{"lat":%d.0,"lon":1.0}]}]}'
    pages = spark.createDataFrame([(p, k, text % (100 + 4 * p + k, p + k)) for p in range(6) for k in range(4)], "place long, tile int, json string").coalesce(1)
    log = spark.createDataFrame([], INGEST_LOG)
    trails, logged = layers.ingest_trails(spark.createDataFrame([], TRAILS), log, regions, pages, "2001-06-29", 0.25, tiles_per_task=4)
    assert {r["id"]: r["center_lat"] for r in trails.collect() if r["id"] == "osm:way/7"} == {"osm:way/7": 8.0} and trails.count() == 25
    assert {r["key"]: r["row_count"] for r in logged.collect()} == {f"trails:place:{p}": 8 for p in range(6)}
    assert trails.rdd.getNumPartitions() >= 6 and "BroadcastHashJoin" not in trails._jdf.queryExecution().executedPlan().toString()

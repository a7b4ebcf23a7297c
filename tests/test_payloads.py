"""Payload parsers: texts are parsed once, the last row of an id stays, days and geometries of any form."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from sylvan.functions import text
from sylvan.plans import catalog
from sylvan.sources import payloads

SF = "/root/testdata/sf0.001"
PARSED = ["ingest_observations", "ingest_tallies", "ingest_counts", "campground_rows", "reported_sites", "trail_rows", "land_rows", "load_bulk", "bulk_tallies", "genus_catalogue", "recent_page_photos"]


@pytest.mark.parametrize("name", PARSED)
def test_json_is_parsed_once(spark, name):
    assert catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_parsed_rows(spark):
    rows = payloads.parsed(spark.createDataFrame([("{}",), ('{"id":3}',), (None,), ("no json",)], "json string"), "json", "id long").collect()
    assert sorted(map(str, (r["id"] for r in rows))) == ["3", "None", "None"]


def test_days_in_every_form_that_the_calendar_knows(spark):
    given = ["2024-01-15", "2024-01-15T10:00", "20240115", "2024-W03-1", "2024W031", "2024-W03", "2024W03", "2020-W53-7", "2021-W53-1", "2024-W54-1", "2024-W00-1", "2024-W01-8", "2024-1-5", "2024-02-30", "20240230", "20240115T1", "20240115T10:00", "2024W031T1", "2024W03T10", "2024-W03T1", "2024W03-1", "2024-W031", "", "tomorrow", "2026-W01-1", "0000-W01-1"]
    got = dict(spark.createDataFrame([(x,) for x in given], "x string").select("x", text.lenient_date("x").alias("d")).collect())
    for x in given:
        try:
            want = dt.date.fromisoformat(x[:10])
        except ValueError:
            want = None
        assert got[x] == want, x


def test_bounds_of_any_nesting(spark):
    walk = lambda x: [tuple(x[:2])] if len(x) > 1 and all(isinstance(v, (int, float)) for v in x[:2]) else [p for y in x if isinstance(y, list) for p in walk(y)]
    shapes = [[-120.5, 45.25], [[-120, 45, 7], [-119.5, 46e0, 9]], [[[[1.5, 2], [3, 4]]], [[5, 6]], [7, -8]], [[[-1e2, 4.5e1, 3, 4]]], [], [[]], [5], [[["a", 1]]]]
    rows = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(shapes)], "k int, c string").select("k", payloads.bounds(F.col("c")).alias("b")).collect()
    for r in rows:
        at = walk(shapes[r["k"]])
        want = (min(y for _, y in at), min(x for x, _ in at), max(y for _, y in at), max(x for x, _ in at)) if at else None
        assert (tuple(r["b"]) if r["b"] else None) == want


def unit(key, coordinates, name="Own", kind="Polygon"):
    return {"properties": {"objectid": key, "FORESTNAME": name}, "geometry": {"type": kind, "coordinates": coordinates}}


def test_land_keeps_the_last_row_of_an_id_and_its_address(spark):
    pages = [(1, json.dumps({"features": [unit(7, [[1, 2], [3, 4]], "old"), unit(8, [5, 6], kind="no such type")]})), (2, json.dumps({"features": [unit(7, [[10, 20]], "new"), unit(9, []), unit(None, [1, 2])]}))]
    given = spark.createDataFrame(pages[::-1], "page int, json string")
    pages = given.select("page", F.from_json("json", payloads.FEATURES).alias("p")).select("page", "p.*")
    rows = {r["id"]: r for r in payloads.land_rows(pages, "usfs").collect()}
    assert set(rows) == {"usfs:7", "usfs:8"}
    assert (rows["usfs:7"]["unit"], rows["usfs:7"]["min_lat"], rows["usfs:8"]["max_lng"]) == ("new", 20.0, 5.0)
    assert rows["usfs:8"]["url"].startswith("https://apps.fs.usda.gov/") and not rows["usfs:8"]["url"].endswith("/query")


def test_trails_keep_the_last_element_that_can_be_drawn(spark):
    way = lambda k, lat, name: {"type": "way", "id": k, "tags": {"name": name}, "geometry": [{"lat": lat, "lon": 1.0}, {"lat": lat + 1, "lon": 2.0}]}
    pages = [json.dumps({"elements": [way(1, 1.0, "a"), way(2, 5.0, "b"), way(1, 3.0, "c"), {"type": "way", "id": 1, "geometry": []}]})]
    frame = spark.createDataFrame([(p,) for p in pages], "json string").select(F.from_json("json", payloads.ELEMENTS).alias("p")).select("p.*")
    assert {r["id"]: r["name"] for r in payloads.trail_rows(frame).collect()} == {"osm:way/1": "c", "osm:way/2": "b"}
    kinds = payloads.trail_rows(frame).select(F.variant_get(payloads.geometry("geojson"), "$.type", "string").alias("t"), F.variant_get(payloads.geometry("geojson"), "$.coordinates[1][1]", "double").alias("y"))
    assert {tuple(r) for r in kinds.collect()} == {("LineString", 4.0), ("LineString", 6.0)}


def test_counts_by_genus_and_reason(spark):
    taxon = lambda rank, root, ancestors, own=5: {"id": own, "rank": rank, "iconic_taxon_id": root, "ancestor_ids": ancestors}
    given = [
        {"id": 1, "location": "45,-120", "observed_on": "2024-01-01", "taxon": taxon("species", 47170, [3, 8])}, {"id": 1, "location": "45,-120", "observed_on": "2024-01-01", "taxon": taxon("species", 47170, [9, 8, 3])},
        {"id": 2, "observed_on": "2024-01-01", "taxon": taxon("species", 47170, [8])}, {"id": 3, "location": "1,2", "observed_on": "x", "taxon": taxon("genus", 47170, [])}, {"id": 4, "location": "1,2", "observed_on": "2024-01-01", "taxon": taxon("species", 1, [8])}, {"id": 5, "taxon": taxon("species", 47170, None)},
    ]
    rows = spark.createDataFrame([(json.dumps(g),) for g in given], "json string")
    rows = payloads.classified(payloads.parsed(rows, "json", payloads.OBSERVATION).select(F.struct("*").alias("o")), spark.createDataFrame([(3, "c"), (8, "h"), (8, "h")], "taxon_id long, name string"))
    assert {tuple(r) for r in payloads.ingest_counts(rows).collect()} == {("stored", 3, 1), ("stored", 8, 1), ("no place or day", 8, 1), ("no place or day", 5, 1), ("no genus", None, 2)}
    assert tuple(payloads.ingest_tallies(rows).first()) == (6, 2, 2)

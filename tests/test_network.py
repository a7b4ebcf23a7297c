"""Trailhead networks from topology, and the nearest trail where there is none."""

import json
import random

import pytest
from pyspark.sql import functions as F
from sylvan.functions import geo
from sylvan.operators import network
from sylvan.schemas import TRAILS
from sylvan.sources import payloads


def line(*at):
    return [{"lat": a, "lon": b} for a, b in at]


def way(i, nodes, geometry, **tags):
    return {"type": "way", "id": i, "nodes": nodes, "geometry": geometry, "tags": {"highway": "path", **tags}}


def route(i, members, **tags):
    return {"type": "relation", "id": i, "tags": {"route": "hiking", **tags}, "members": [{"type": "way", "ref": ref, "geometry": g} for ref, g in members]}


def found(spark, *pages):
    frame = spark.createDataFrame([(k, json.dumps({"elements": p})) for k, p in enumerate(pages)][::-1], "page int, json string")
    return network.elements(frame.select("page", F.explode(F.array(F.from_json("json", payloads.ELEMENTS))).alias("p")).select("page", "p.*"))


def head(i, lat=45.0, lng=-120.0, kind="trailhead"):
    return (f"osm:node/{i}", f"Head {i}", kind, lat, lng, lat, lng, lat, lng, json.dumps({"type": "Point", "coordinates": [lng, lat]}), "osm", "")


def path(i, kind, *at):
    lats, lngs = [a for a, _ in at], [b for _, b in at]
    shape = {"type": "LineString", "coordinates": [[b, a] for a, b in at]} if len(at) > 1 else {"type": "Point", "coordinates": [at[0][1], at[0][0]]}
    return (f"osm:way/{i}", f"Path {i}", kind, min(lats), min(lngs), max(lats), max(lngs), lats[0], lngs[0], json.dumps(shape), "osm", "")


def networks(spark, *pages, nodes=(1, 2, 3)):
    return {r["node"]: r for r in network.networks(spark.createDataFrame([(n,) for n in nodes], "node long"), found(spark, *pages)).collect()}


def test_lines_are_stitched_in_order_of_elements(spark):
    a, b, c = line((1, 1), (2, 2)), line((3, 3), (4, 4)), line((5, 5), (6, 6))
    got = networks(spark, [route(50, [(10, c), (99, a)]), way(20, [1, 5], b), way(10, [7, 1, 1], a)])
    assert set(got) == {1}
    shape = json.loads(got[1]["geojson"])
    assert shape == {"type": "MultiLineString", "coordinates": [[[v["lon"], v["lat"]] for v in x] for x in (a, b, c, a)]}
    assert (got[1]["kind"], got[1]["name"]) == ("route", "Trail (OSM)")
    one = networks(spark, [way(10, [2], a, ref="R7")])[2]
    assert json.loads(one["geojson"]) == {"type": "LineString", "coordinates": [[1, 1], [2, 2]]} and (one["kind"], one["name"]) == ("path", "R7")


@pytest.mark.parametrize("elements,name", [
    ([way(1, [1], line((1, 1)), name="first"), way(2, [1], line((1, 1)), name="second")], "first"),
    ([way(1, [1], [], name="no line"), way(2, [1], line((1, 1)), ref="two")], "two"),
    ([way(1, [1], line((1, 1)), name="way"), route(9, [(1, [])]), route(8, [(1, [])], name="route")], "route"),
    ([way(1, [1], line((1, 1)), name="way"), route(9, [(1, [])], name="late"), route(8, [(1, [])], name="early")], "late"),
    ([way(1, [1], line((1, 1)), name="", ref="ref")], "ref"),
    ([way(1, [1], line((1, 1)))], "Trail (OSM)"),
])
def test_names(spark, elements, name):
    assert networks(spark, elements)[1]["name"] == name


def test_what_is_no_network(spark):
    foreign = {"type": "way", "id": 4, "nodes": [3], "geometry": line((1, 1)), "tags": {"waterway": "river"}}
    cycle = route(70, [(5, line((9, 9)))], route="bicycle")
    got = networks(spark, [foreign, cycle, way(5, [2], line((1, 1))), way(6, [1], [{"lat": 1.0, "lon": None}])], [])
    assert set(got) == {2} and got[2]["kind"] == "path"
    # the last element of an id counts, whichever page it stands on
    assert set(networks(spark, [way(5, [2], line((1, 1)))], [way(5, [3], line((1, 1)))])) == {3}
    assert networks(spark, []) == {}


def test_resolution_of_all_trailheads(spark):
    far = path(3, "path", (50.0, -110.0), (50.1, -110.0))
    trails = spark.createDataFrame([head(1), head(2, 50.0, -110.001), head(4, 10.0, 10.0), head(9, kind="path"), ("osm:way/77", *head(5)[1:]), path(1, "path", (45.001, -120.0), (46.0, -120.0)), far, path(4, "route", (50.0, -110.0)), path(5, "road", (10.0, 10.0))], TRAILS)
    asked = spark.createDataFrame([(x,) for x in ("osm:node/1", "osm:node/2", "osm:node/4", "osm:node/9", "osm:way/77", "nothing", "osm:node/1")], "id string")
    got = {r["asked"]: r for r in network.resolve(asked, trails, found(spark, [way(8, [1], line((45, -120), (45.5, -120.5)), name="Ridge")])).collect()}
    own = got["osm:node/1"]
    assert (own["state"], own["id"], own["name"], own["kind"], own["center_lat"]) == ("network", "osm:node/1", "Ridge", "path", 45.0)
    # its own place decides; the single vertex of a route is as near as the path's, whose id is less
    near = got["osm:node/2"]
    assert (near["state"], near["id"], near["name"], near["geojson"]) == ("nearest", "osm:way/3", "Path 3", far[9])
    assert {a: r["state"] for a, r in got.items()} == {"osm:node/1": "network", "osm:node/2": "nearest", "osm:node/4": "none", "osm:node/9": "unknown", "osm:way/77": "unknown", "nothing": "unknown"}


def test_long_lines_are_thinned(spark):
    got = networks(spark, [way(1, [1], line(*[(k / 10, 1.0) for k in range(500)]))])[1]
    at = json.loads(got["geojson"])["coordinates"]
    assert len(at) == 60 and (at[0][1], at[-1][1]) == (0.0, 49.9)


def test_nearest_vertices_by_bounds_are_those_of_all_pairs(spark):
    rnd = random.Random(5)
    lines = [(f"p{k}", ["path", "route", "trailhead"][k % 3], [(a + i / 500, b + i / 500) for i in range(4)]) for k in range(240) for a, b in [(rnd.uniform(45, 46), rnd.uniform(-121, -120))]]
    lines += [("pole", "path", [(88.0, 0.0)]), ("line", "path", [(0.0, 179.99)])]
    rows = [(k, kind, min(v)[0] + (k == "p1"), min(x[1] for x in v), max(v)[0] + (k == "p1"), max(x[1] for x in v), v) for k, kind, v in lines]  # the extent of p1 is wrong
    trails = spark.createDataFrame(rows, "id string, kind string, min_lat double, min_lng double, max_lat double, max_lng double, vertices array<struct<lat:double,lng:double>>")
    asked = [(k, rnd.uniform(45, 46), rnd.uniform(-121, -120)) for k in range(80)] + [(100, 88.0, 5.0), (101, 0.0, -179.99), (102, 0.0, 180.0), (103, 0.0, 180.01), (104, None, 1.0), (105, lines[1][2][0][0], lines[1][2][0][1])]
    points = spark.createDataFrame(asked, "key int, lat double, lng double")
    dlat, dlng = geo.reach("lat", 8.0)
    touched = "min_lat <= lat + dlat AND max_lat >= lat - dlat AND min_lng <= lng + dlng AND max_lng >= lng - dlng"
    pairs = points.withColumns({"dlat": dlat, "dlng": dlng}).crossJoin(trails.where("kind <> 'trailhead'").selectExpr("*", "explode(vertices) AS v")).where(touched)
    pairs = pairs.withColumn("km", geo.haversine_km("lat", "lng", "v.lat", "v.lng")).where("km <= 8")
    want = {r["key"]: tuple(r["best"]) for r in pairs.groupBy("key").agg(F.min(F.struct("km", "id")).alias("best")).collect()}
    found = network.nearest_by_vertex(points, trails, 8.0)
    assert {r["key"]: (r["km"], r["trail"]) for r in found.collect()} == want and len(want) > 40
    assert "BroadcastHashJoin [i#" not in found._jdf.queryExecution().executedPlan().toString()  # exploded rows stay distributed

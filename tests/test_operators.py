import datetime as dt
import html
import json
import math
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sylvan.functions import geo, text
from sylvan.operators import calendar, coverage, layers, merge, phenology, planner, proximity, ranking
from sylvan.plans import catalog
from sylvan.schemas import CAMPSITES, GENERA, INGEST_LOG, OBSERVATIONS, TRAILS
from sylvan.sources import payloads, versions
from sylvan.streaming.ingest import MERGED, merge_stream, stored

DAY = dt.date


@pytest.fixture(scope="module")
def base(spark):
    rows, i = [], 0
    for taxon, lat, lng, day, n in ((111, 47.6, -122.3, DAY(2022, 4, 15), 20), (222, 44.0, -121.0, DAY(2022, 10, 15), 30), (111, 44.0, -121.0, DAY(2022, 7, 1), 2)):
        for _ in range(n):
            i += 1
            rows.append((i, taxon, lat, lng, day, day.month, "research", 10, None, None, False, None))
    rows += [(1000 + k, 333, 47.6, -122.3, DAY(2022, 4, 1), 4, "casual", 10, None, None, False, None) for k in range(20)]
    return spark.createDataFrame(rows, OBSERVATIONS)


@pytest.fixture(scope="module")
def genera(spark):
    return spark.createDataFrame([(111, "Alpha", "First", 90000), (222, "Beta", None, 40000), (2001, "Same", None, 1), (2002, "Same", None, 2)], GENERA)


def rank(base, months, taxa=(), radius=1000.0, as_of="2030-01-01"):
    p = phenology.build_phenology(base, 0.5)
    return ranking.radial(p, phenology.recent_counts(base, 0.5, as_of, 4), months, list(taxa), 47.6062, -122.3321, radius).orderBy(F.desc("score")).collect()


def test_distance(spark):
    got = spark.range(1).select(geo.haversine_km(47.6062, -122.3321, 45.5152, -122.6784).alias("a"), geo.haversine_km(45.5152, -122.6784, 47.6062, -122.3321).alias("b"), geo.haversine_km(10, 10, 10, 10).alias("z")).first()
    assert 220 < got["a"] < 245
    assert got["a"] == pytest.approx(got["b"])
    assert got["z"] == 0


def test_season_decides_the_first_region(base):
    first = rank(base, [4])
    assert first[0]["region_id"] == "95_-245"
    assert first[0]["score_norm"] == 1.0
    assert rank(base, [10])[0]["region_id"] == "88_-242"
    assert rank(base, []) == []
    assert {r["n_species"] for r in rank(base, [4])} == {1}  # casual records do not count
    assert rank(base, [4], radius=10.0, taxa=[222]) == []


def test_recent_activity_multiplies(base):
    assert rank(base, [10], as_of="2022-10-20")[0]["recent_count"] == 30


def test_obscured_rows_do_not_move_a_centre(spark):
    rows = [(i, 5, 40.0, -100.0, DAY(2022, 5, 1), 5, "research", 10, None, None, None if i else False, None) for i in range(3)] + [(9, 5, 40.3, -99.6, DAY(2022, 5, 1), 5, "research", 27000, None, None, True, None), (10, 6, 50.0, -110.0, DAY(2022, 5, 1), 5, "research", 1, None, None, True, None)]
    regions = {r["region_id"]: r for r in phenology.build_regions(spark.createDataFrame(rows, OBSERVATIONS), 1.0).collect()}
    assert regions["40_-100"]["center_lat"] == 40.0
    assert regions["50_-110"]["center_lat"] == 50.0


def test_calendar(spark, genera):
    rows = [(i, 1000 + i % 20 if i < 20 else 2001 + i % 2, 44.0, -121.0, DAY(2022, 10, 1), 10, "research", 1, None, None, False, None) for i in range(24)]
    p = phenology.build_phenology(spark.createDataFrame(rows, OBSERVATIONS), 1.0)
    totals = {r["month"]: r["total"] for r in calendar.month_totals(p).collect()}
    assert len(totals) == 12
    assert (totals[10], totals[1]) == (24, 0)
    top = calendar.top_taxa(p, genera).collect()
    assert len(top) == 15
    assert {"Same", "Same #2002"} <= {r["label"] for r in top}


def test_alerts_and_points(spark):
    rows = [(1, 7, 44.25, -121.0, DAY(2024, 5, 1), 5, "research", 1, "old", "u", False, None), (2, 7, 44.75, -121.0, DAY(2024, 5, 3), 5, "research", 1, None, "v", True, None), (3, 8, 44.5, -121.0, DAY(2024, 5, 3), 5, "research", 1, "p", "w", None, None), (4, 8, 44.5, -121.0, DAY(2020, 1, 1), 1, "research", 1, "p", "w", False, None)]
    o = spark.createDataFrame(rows, OBSERVATIONS)
    recent = calendar.recent_rows(o, 1.0, "2024-05-10", 4)
    seven = calendar.alerts(recent).where("taxon_id = 7").first()
    assert (seven["cnt"], seven["place_guess"], seven["uri"], seven["obscured"]) == (2, None, "v", True)
    region = calendar.alert_regions(recent).first()
    assert (region["total"], region["center_lat"], region["weight"]) == (3, 44.375, 0.3)
    assert {r["id"] for r in calendar.precise_points(o, 44.5, -121.0, 100.0).collect()} == {1, 4}
    assert [r["id"] for r in calendar.recent_page(o, 1.0, 1, 1).collect()] == [2, 1]


def test_merges(spark):
    old = spark.createDataFrame([(1, 111, "a", None), (2, 5, "b", "x")], "id long, taxon_id long, uri string, stamp string")
    new = spark.createDataFrame([(1, 9, None, 1), (1, None, "z", 2), (3, 4, None, 3)], "id long, taxon_id long, uri string, seq int")
    got = {r["id"]: tuple(r) for r in merge.coalesce_merge(old, new, "id", "seq", ["taxon_id", "uri"]).collect()}
    assert got == {1: (1, 9, "z", None), 2: (2, 5, "b", "x"), 3: (3, 4, None, None)}
    over = {r["id"]: tuple(r) for r in merge.overwrite_merge(old.drop("stamp"), new, "id", "seq").collect()}
    assert over == {1: (1, None, "z"), 2: (2, 5, "b"), 3: (3, 4, None)}
    first = {r["id"]: tuple(r) for r in merge.first_wins_merge(old.drop("stamp"), new, "id", "seq").collect()}
    assert first == {1: (1, 111, "a"), 2: (2, 5, "b"), 3: (3, 4, None)}
    asked = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    live = spark.createDataFrame([(1, 111), (2, 6)], "id long, taxon_id long")
    assert {r["id"]: r["action"] for r in merge.recheck(live, old, asked).collect()} == {1: "keep", 2: "reassign", 4: "purge"}


def test_log(spark):
    stamp = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("obs:fungi:47.6:-122.3:200:2015-01-01:2024-02-01", stamp, 5, 47.6, -122.3, 200.0), ("obs:fungi:place:46:2015-01-01:2024-01-01", stamp, 9, None, None, None), ("obs:fungi:place:46:2024-01-01:2024-03-01", stamp + dt.timedelta(days=1), 2, None, None, None), ("land:coverage", stamp, 1, None, None, None)], INGEST_LOG)
    areas = spark.createDataFrame([("in", 47.6, -122.3, 150.0), ("wide", 47.6, -122.3, 250.0), ("far", 45.5, -122.7, 150.0)], "area string, a_lat double, a_lng double, a_radius double")
    assert {r["area"]: r["covered"] for r in coverage.covered(areas, log, "obs:fungi:").collect()} == {"in": True, "wide": False, "far": False}
    assert coverage.latest_date(log, 47.6, -122.3, 150.0).first()["latest"] == "2024-02-01"
    assert coverage.latest_by_place(log).first()["latest"] == "2024-03-01"
    place = coverage.report(spark.createDataFrame([("46",), ("47",)], "place string"), log).orderBy("place").collect()
    assert [(r["row_count"], r["fetched_at"] is None) for r in place] == [(2, False), (0, True)]


def test_nearest_site_is_exact(spark):
    import random

    rnd = random.Random(1)
    points = [(str(i), rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for i in range(150)] + [("wrap", 0.0, 179.99)]
    sites = [(str(i), rnd.uniform(-60, 60), rnd.uniform(-180, 180)) for i in range(25)] + [("w", 0.0, -179.99)]
    p, s = spark.createDataFrame(points, "key string, lat double, lng double"), spark.createDataFrame(sites, "site string, s_lat double, s_lng double")
    got = {r["key"]: r["km"] for r in proximity.nearest_site(p, s).collect()}
    want = {r["key"]: r["km"] for r in p.join(s).groupBy("key").agg(F.min(geo.haversine_km("lat", "lng", "s_lat", "s_lng")).alias("km")).collect()}
    assert got == pytest.approx(want)
    assert {r["km"] for r in proximity.nearest_site(p, s.limit(0)).collect()} == {None}


def test_plan(spark):
    ranked = spark.createDataFrame([("near", 44.2, -121.0, 22.0, 3.0, 1.0), ("mid", 45.0, -121.0, 111.0, 2.0, 0.66), ("far", 47.0, -121.0, 333.0, 1.0, 0.33)], "region_id string, center_lat double, center_lng double, distance_km double, score double, score_norm double")
    camps = spark.createDataFrame([(f"c{i}", "c", "campground", None, free, lat, -121.01, "s", "u") for i, (free, lat) in enumerate(((True, 44.25), (None, 44.2), (True, 45.05), (True, 47.0)))], CAMPSITES)
    trails = spark.createDataFrame([], TRAILS)
    chosen = planner.stops(ranked, camps, trails, 50.0, 20.0, 0.0, True, 5)
    assert {r["key"]: r["camp_id"] for r in chosen.collect()} == {"near": "c0", "mid": "c2", "far": "c3"}
    legs = planner.walk(chosen, (44.0, -121.0), 150.0).collect()
    assert [r["region_id"] for r in legs] == ["near", "mid"]
    assert {r["skipped"] for r in legs} == {1}
    assert planner.walk(chosen.limit(0), (44.0, -121.0), 150.0).first()["region_id"] is None


def test_segment(spark):
    progress, offset = geo.along_segment(45.0, -121.0, (44.0, -121.0), (48.0, -121.0))
    same, away = geo.along_segment(45.0, -121.0, (44.0, -121.0), (44.0, -121.0))
    got = spark.range(1).select(progress, offset, same, away).first()
    # a quarter of the great circle; without length, the distance from the start
    assert tuple(got) == pytest.approx((math.radians(4) * 6371.0 / 4, 0.0, 111.0, 111.0))


def test_circles_are_capped(spark):
    far = spark.range(1).select(geo.query_circles(F.lit(47.6), F.lit(-122.3), 2000.0, 80.0).alias("c"), geo.query_circles(F.lit(47.6), F.lit(-122.3), 150.0, 80.0).alias("d")).first()
    assert len(far["c"]) == 200
    assert 9 <= len(far["d"]) < 60
    assert (far["c"][0]["lat"], far["c"][0]["lng"]) == (47.6, -122.3)  # the nearest come first


def test_circles_are_the_nearest_of_the_grid(spark):
    at = spark.createDataFrame([(k, 30.0 + 7 * k, -120.0 - k, 100.0 * k) for k in range(5)] + [(5, None, 1.0, 100.0), (6, -89.9, 180.0, 300.0)], "key int, lat double, lng double, r double")
    rows = at.withColumns({"n": F.greatest(F.lit(1), F.ceil(F.col("r") / 30.0).cast("int"))}).withColumn("i", F.explode(F.sequence(-F.col("n"), "n"))).withColumn("j", F.explode(F.sequence(-F.col("n"), "n")))
    dlat, dlng = geo.reach("lat", 30.0)
    rows = rows.select("key", "r", "i", "j", "lat", "lng", (F.col("lat") + F.col("i") * dlat).alias("c_lat"), (F.col("lng") + F.col("j") * dlng).alias("c_lng"))
    want = {}
    for r in rows.withColumn("km", geo.haversine_km("lat", "lng", "c_lat", "c_lng")).where(F.col("km") <= F.col("r") + 30.0).orderBy("key", "i", "j").collect():
        want.setdefault(r["key"], []).append((r["km"], r["i"], r["j"], r["c_lat"], r["c_lng"]))
    want = {k: [c[3:] for c in (sorted(v)[:200] if len(v) > 200 else v)] for k, v in want.items()}
    made = layers.circles(at.coalesce(1), "key", F.col("r"), 30.0, at.count(), areas_per_task=2)
    got = {}
    for r in made.orderBy("key", "circle").collect():
        got.setdefault(r["key"], []).append(tuple(r["c"]))
    assert got == want and len(want[4]) == 200
    # areas in one small file are not one task
    assert made.rdd.getNumPartitions() == 4


def test_clean_html_is_that_of_python(spark):
    rnd = random.Random(5)
    parts = ["&", "&amp", "&amp;", "&#", "&#x", "&#38;", "&#38", "&#x26;", "&#X41g", "&#0;", "&#xD800;", "&#128;", "&#1114112;", "&notit;", "&notin;", "&NotEqualTilde;", "&nosuch;", "&é;", "&\U0001f332&lt;", "&nbsp;", "&Tab;", "&NewLine;", "&zwj;", "&lt", "gt;", "#", ";", "<", "<br>", ">", " ", "x", "é", "\U0001f332", "9", "&" + "a" * 40 + ";", "&" + "\U0001f332" * 33 + ";", *map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))]
    texts = [*parts, "", "plain", None] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(3000)]
    want = [None if t is None else " ".join(html.unescape(re.sub("<[^>]+>", " ", t)).split()) or None for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.clean_html("t").alias("h"))
    got = {r["k"]: r["h"] for r in frame.collect()}
    assert [(t, got[k]) for k, t in enumerate(texts)] == list(zip(texts, want, strict=True))


def test_clean_html_holds_few_texts_of_a_batch(spark):
    batch = pa.array(["caf&eacute; &amp; b\xa0 " * 100 + str(k) for k in range(5000)] + [None])
    tracemalloc.start()
    got = text._decoded.func(batch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < batch.nbytes / 5
    assert (len(got), got[7].as_py(), got[5000].as_py()) == (5001, "café & b " * 100 + "7", None) and len(text._decoded.func(batch[:0])) == 0


def test_text(spark):
    f = spark.createDataFrame([("<p>A&nbsp;&amp; B</p>\xa0 c &#8217;&#x27;&uuml;&CounterClockwiseContourIntegral;&amp;lt;", "Free of charge!", "47.6 -122.3"), ("<br>", "Smoke-free, $20. Tax: none", "99,0"), (None, None, None)], "h string, fee string, at string")
    a, b, c = f.select(text.clean_html("h").alias("h"), text.free_from_fee("fee").alias("free"), text.parse_coordinates("at").alias("at"), text.lenient_date(F.lit("2024-02-30")).alias("d")).collect()
    assert (a["h"], a["free"], a["at"]["lat"], a["d"]) == ("A & B c ’'ü∳&lt;", True, 47.6, None)
    assert tuple(c) == (None, None, None, None)
    tags = spark.createDataFrame([("No",), (" no ",), ("yes",), ("",), (" ",), (None,)], "t string").select(text.fee_tag("t").alias("t")).select("t.*").collect()
    assert [tuple(t) for t in tags] == [(True, None), (True, None), (None, "fee required"), (None, None), (None, None), (None, None)]
    assert text.months_of(None, 7) == [7]
    assert text.months_of("", 7) == list(range(1, 13))
    assert text.months_of("4, 5", 7) == [4, 5]
    with pytest.raises(ValueError, match="1-12"):
        text.months_of("13", 7)
    assert (text.taxa_of("all", [1]), text.taxa_of(",", [1]), text.taxa_of("2,3", [1]), text.or_default(0, 150.0), text.or_default(5, 150.0)) == ([1], [], [2, 3], 150.0, 5)
    assert (b["h"], b["free"], b["at"]) == (None, None, None)


def test_payloads(spark, tmp_path, genera):
    def land(name, *pages):
        (tmp_path / name).write_text("\n".join(json.dumps(p) for p in pages))
        return str(tmp_path / name)

    seen = [{"id": 1, "geojson": {"coordinates": [-122.0, 47.0]}, "observed_on": "2024-04-15T10", "quality_grade": "research", "taxon": {"id": 9, "rank": "species", "ancestor_ids": [1, 222, 111], "iconic_taxon_id": 47170}, "photos": [{"url": "a", "license_code": "cc-by"}, {"url": "b", "license_code": None}]}, {"id": 2, "location": "46.5,-121.5", "observed_on": "2024-04-15", "taxon": {"id": 77, "rank": "genus", "iconic_taxon_id": 47170}}, {"id": 3, "location": "46.5,-121.5", "observed_on": "bad", "taxon": {"id": 77, "rank": "genus", "iconic_taxon_id": 47170}}, {"id": 4, "location": "46.5,-121.5", "observed_on": "2024-04-15", "taxon": {"id": 5, "rank": "genus", "iconic_taxon_id": 1}}]
    o = payloads.read_json(spark, land("o.json", *seen), payloads.OBSERVATION).select(F.struct("*").alias("o"))
    rows = {r["id"]: (r["taxon_id"], r["lat"], r["lng"]) for r in payloads.observation_rows(o, genera).collect()}
    assert rows == {1: (222, 47.0, -122.0), 2: (77, 46.5, -121.5)}
    assert [p["url"] for p in payloads.open_photos(o).first()["photos"]] == ["a"]
    c = payloads.read_json(spark, land("c.json", {"RECDATA": [{"FacilityID": "1", "FacilityName": "", "FacilityLatitude": 1.0, "FacilityLongitude": 2.0, "FacilityUseFeeDescription": "<b>No fee</b>"}, {"FacilityID": "2", "FacilityLatitude": 0, "FacilityLongitude": 0}]}), payloads.CAMPGROUNDS)
    assert [(r["id"], r["free"], r["fee"]) for r in payloads.campgrounds(c).collect()] == [("ridb:1", True, "No fee")]
    way = {"type": "way", "id": 5, "tags": {"name": "T"}, "geometry": [{"lat": 1.0 + i / 100, "lon": 2.0} for i in range(100)] + [None]}
    e = payloads.read_json(spark, land("e.json", {"elements": [way, {"type": "node", "id": 6, "lat": 3.0, "lon": 4.0, "tags": {"fee": "no"}}, {"type": "relation", "id": 7, "members": [{"type": "way", "geometry": [{"lat": 1, "lon": 1}, {"lat": 2, "lon": 2}]}, {"type": "way", "geometry": [{"lat": 3, "lon": 3}, {"lat": 4, "lon": 4}]}]}]}), payloads.ELEMENTS)
    t = {r["id"]: r for r in payloads.trail_rows(e).collect()}
    assert len(json.loads(t["osm:way/5"]["geojson"])["coordinates"]) == 60
    assert (json.loads(t["osm:relation/7"]["geojson"])["type"], json.loads(t["osm:node/6"]["geojson"])["coordinates"], t["osm:relation/7"]["center_lat"]) == ("MultiLineString", [4.0, 3.0], 3.0)
    assert payloads.reported_sites(e).where("id = 'osm:node/6'").first()["free"]
    polygon = {"type": "Polygon", "coordinates": [[[-1.5, 2, 100], [3, 4e0, 100], [0, 1, 100]]]}
    g = payloads.read_json(spark, land("g.json", {"features": [{"properties": {"forestname": " U ", "OBJECTID": "3"}, "geometry": polygon}, {"properties": {"forestname": "no id"}, "geometry": polygon}, {"properties": {"objectid": 4}, "geometry": {"type": "Point", "coordinates": [5, 6]}}, {"properties": {"objectid": 5}, "geometry": {"type": "Polygon", "coordinates": []}}, {"properties": {"objectid": 6}, "geometry": None}]}), payloads.FEATURES)
    u = {r["id"]: r for r in payloads.land_rows(g, "usfs").collect()}
    assert {k: (r["unit"], r["min_lat"], r["min_lng"], r["max_lat"], r["max_lng"]) for k, r in u.items()} == {"usfs:3": ("U", 1.0, -1.5, 4.0, 3.0), "usfs:4": ("National Forest", 6.0, 5.0, 6.0, 5.0)}
    assert json.loads(u["usfs:3"]["geojson"]) == polygon
    cells = [[""] * 38 for _ in range(3)]
    for i, r in enumerate(cells):
        for k, v in ((0, str(i)), (16, "2020-05-01T1"), (20, "47.5"), (21, "-121"), (22, "27000"), (24, "US" if i else "CA"), (37, "Alpha")):
            r[k] = v
    lines = [",".join(f"h{k}" for k in range(38)), *[",".join(r) for r in cells], "short,row"]
    (tmp_path / "b.csv").write_text("\n".join(lines))
    bulk = payloads.bulk_rows(payloads.bulk_scan(spark, str(tmp_path / "b.csv"), 38), genera).collect()
    assert sorted((r["id"], r["taxon_id"], r["obscured"]) for r in bulk) == [(1, 111, True), (2, 111, True)]


def test_stream_merges_once(spark, tmp_path, base):
    source, root = tmp_path / "in", str(tmp_path / "out")
    base.limit(5).coalesce(1).write.parquet(str(source))
    for state in ("state", "state", "other"):  # a new checkpoint goes on from the table that is there
        stream = spark.readStream.schema(OBSERVATIONS).parquet(str(source))
        merge_stream(spark, stream, root, str(tmp_path / state)).awaitTermination()
        assert stored(spark, root).count() == 5
    base.where("id BETWEEN 4 AND 9").coalesce(1).write.mode("append").parquet(str(source))
    merge_stream(spark, spark.readStream.schema(OBSERVATIONS).parquet(str(source)), root, str(tmp_path / "other")).awaitTermination()
    assert sorted(r["id"] for r in stored(spark, root).collect()) == list(range(1, 10))
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("v-")]) == 2
    assert set(MERGED) < set(stored(spark, root).columns)


def test_publish_swaps_whole_versions(spark, tmp_path, base):
    root = str(tmp_path / "tables")
    assert versions.current(spark, root) is None
    first = phenology.publish_phenology(base, 0.5, root)
    assert versions.current(spark, root)[0] == first
    rows = spark.read.parquet(f"{first}/phenology").count()
    broken = base.withColumn("lat", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        phenology.publish_phenology(broken, 0.5, root)
    assert versions.current(spark, root)[0] == first
    second = phenology.publish_phenology(base, 0.5, root)
    assert versions.current(spark, root)[0] == second != first
    assert spark.read.parquet(f"{second}/phenology").count() == rows
    assert spark.read.parquet(f"{second}/regions").count() == 2


def test_lines_round_trip(spark, tmp_path):
    payloads.write_lines(spark.createDataFrame([(1, "Alpha", 111, 1.0, 2.0, "27000.9", "2024-02-03T1"), (2, "Beta", 222, 1.0, 2.0, None, "bad"), (3, "Beta", 222, 1.0, 2.0, None, "2024-01-01")], payloads.BULK_LINE), str(tmp_path / "lines"))
    rows = payloads.load_bulk(payloads.read_json(spark, str(tmp_path / "lines"), payloads.BULK_LINE), "obs/")
    assert sorted((r["id"], r["positional_accuracy"], r["obscured"], r["uri"]) for r in rows.collect()) == [(1, 27000, True, "obs/1"), (3, None, None, "obs/3")]
    assert {r["taxon_id"]: (r["loaded"], str(r["end_date"])) for r in payloads.bulk_tallies(rows).collect()} == {111: (1, "2024-02-03"), 222: (1, "2024-02-03")}


def test_coverage_near_the_pole_and_the_date_line(spark):
    log = spark.createDataFrame([("obs:fungi:a", None, 1, 80.0, 0.0, 500.0), ("obs:fungi:b", None, 1, 0.0, 179.5, 300.0), ("obs:fungi:c", None, 1, 89.5, 10.0, 400.0)], INGEST_LOG)
    areas = spark.createDataFrame([("north", 80.0, 20.0, 10.0), ("line", 0.0, -179.5, 50.0), ("over", 88.0, -170.0, 10.0), ("out", 70.0, 90.0, 10.0)], "area string, a_lat double, a_lng double, a_radius double")
    assert {r["area"]: r["covered"] for r in coverage.covered(areas, log, "obs:fungi:").collect()} == {"north": True, "line": True, "over": True, "out": False}


def test_bulk_filter_keeps_parts_of_any_id(spark, tmp_path):
    for name in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(1)
    ids = spark.createDataFrame([(1,), (2_000_001,), (3_000_001,)], "p_partkey long")
    part.drop("p_partkey").crossJoin(ids).write.parquet(str(tmp_path / "part.parquet"))
    got = catalog.queries()["bulk_filter"](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["positional_accuracy"]) for r in got) == [(1, 1000), (2_000_001, 2_000_001_000), (3_000_001, None)]


def test_an_area_meets_the_disks_that_can_hold_it_and_no_others(spark):
    rnd = random.Random(3)
    disks = [(f"obs:fungi:{k}", rnd.uniform(44, 48), rnd.uniform(-124, -118), float(rnd.randrange(50, 90))) for k in range(600)] + [("obs:fungi:pole", 89.9, 10.0, 300.0), ("obs:fungi:none", 45.0, -120.0, None)]
    asked = [(k, rnd.uniform(43, 49), rnd.uniform(-125, -117), float(rnd.randrange(20, 80))) for k in range(300)] + [(1000, 88.0, -170.0, 10.0), (1001, 45.0, None, 10.0)]
    areas = spark.createDataFrame(asked, "area int, a_lat double, a_lng double, a_radius double")
    log = spark.createDataFrame(disks, "key string, lat double, lng double, radius_km double")
    held = areas.crossJoin(log).where(geo.haversine_km("a_lat", "a_lng", "lat", "lng") + F.col("a_radius") <= F.col("radius_km")).select("area").distinct()
    want = {r["area"] for r in held.collect()}
    assert want and {r["area"] for r in coverage.covered(areas, log, "obs:fungi:").where("covered").collect()} == want
    cells = proximity.in_cells(areas.select(F.col("a_lat").alias("lat"), F.col("a_lng").alias("lng")))
    there = proximity.candidates(cells, log.select(F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"), F.col("radius_km").alias("lead")))
    assert there.count() < 5 * len(asked)

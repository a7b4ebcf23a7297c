"""The registered queries, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geo, text
from ..operators import calendar, coverage, devices, layers, merge, network, phenology, places, planner, proximity, ranking, runs, seasons
from ..schemas import INGEST_LOG, OBSCURED_ACCURACY, ROOT_TAXON
from ..sources import pages as paging
from ..sources import archive, payloads, stored, versions, views

CELL, AS_OF, WEEKS, MONTHS, TAXA = 1.0, "2001-06-29", 26, [4, 5, 10], [1, 2, 3, 5, 8, 13, 21, 24]
LAT, LNG, RADIUS = 46.0, -121.0, 200.0
START, END, CORRIDOR = (44.5, -123.5), (47.5, -118.5), 80.0
_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2*6371.0::DOUBLE*asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({c}-({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-({b}))/2),2)))))"


def boxed(lat: str, lng: str, r: str, overlap: bool = False, a: str = "lat", b: str = "lng") -> str:
    dlat, dlng = f"(({r})/111.0::DOUBLE)", f"(({r})/(111.0::DOUBLE*greatest(abs(cos(radians({lat}))),0.01::DOUBLE)))"
    if overlap:
        return f"(min_lat<={lat}+{dlat} AND max_lat>={lat}-{dlat} AND min_lng<={lng}+{dlng} AND max_lng>={lng}-{dlng})"
    return f"({a} BETWEEN {lat}-{dlat} AND {lat}+{dlat} AND {b} BETWEEN {lng}-{dlng} AND {lng}+{dlng})"


LAT_SQL, LNG_SQL = f"{LAT}::DOUBLE", f"({LNG}::DOUBLE)"
REGION = "floor(lat)::INT||'_'||floor(lng)::INT"
CENTER = "coalesce(avg({0}) FILTER (WHERE NOT coalesce(obscured,false)), avg({0}))"
MORE = {
    "binned": f"SELECT *, {REGION} AS region_id FROM lobs WHERE quality_grade='research'",
    "obinned": f"SELECT *, {REGION} AS region_id FROM oobs WHERE quality_grade='research'",
    "phen": f"SELECT region_id, taxon_id, month, {CENTER.format('lat')} AS center_lat, {CENTER.format('lng')} AS center_lng, count(*) AS cnt FROM binned GROUP BY ALL",
    "recent": f"SELECT region_id, count(*) AS recent_count FROM binned WHERE observed_on >= DATE '{AS_OF}' - {7 * WEEKS} AND taxon_id IN ({','.join(map(str, TAXA))}) GROUP BY 1",
    "base": f"SELECT region_id, taxon_id, sum(center_lat*cnt)/sum(cnt) AS lat, sum(center_lng*cnt)/sum(cnt) AS lng, sum(cnt)::BIGINT AS total_count, coalesce(sum(cnt) FILTER (WHERE month IN (4,5,10)),0)::BIGINT AS month_count FROM phen WHERE taxon_id IN ({','.join(map(str, TAXA))}) GROUP BY 1,2",
    "radial": f"SELECT *, month_count/total_count AS w_pheno FROM (SELECT *, {hav(LAT_SQL, LNG_SQL, 'lat', 'lng')} AS distance_km FROM base WHERE month_count>0) WHERE distance_km <= {RADIUS}",
}


def _rank_sql(rows: str) -> str:
    return f"""(SELECT *, round(score/max(score) OVER (),4) AS score_norm FROM (SELECT region_id, center_lat, center_lng, distance_km, n_species, coalesce(recent_count,0) AS recent_count, b*(1+0.1::DOUBLE*(n_species-1))*(1+ln(1+coalesce(recent_count,0))) AS score
FROM (SELECT region_id, sum(w_pheno*ln(1+month_count)) AS b, count(*) AS n_species, arg_min(lat,taxon_id) AS center_lat, arg_min(lng,taxon_id) AS center_lng, round(arg_min(distance_km,taxon_id),1) AS distance_km FROM {rows} GROUP BY 1) LEFT JOIN recent USING (region_id)))"""


def _segment_sql(start: str, end_lat: str, end_lng: str, rows: str = "base") -> str:
    """Progress and offset on the plane that touches the start; progress is a share of the great-circle length."""
    lat, lng = start
    k = f"(111.0::DOUBLE*greatest(abs(cos(radians({lat}))),0.01::DOUBLE))"
    return f"""SELECT *, month_count/total_count AS w_pheno, CASE WHEN whole=0 THEN off_km ELSE t*whole END AS distance_km FROM (SELECT *, sqrt(pow(px-t*dx,2)+pow(py-t*dy,2)) AS off_km FROM
(SELECT *, CASE WHEN dx*dx+dy*dy=0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE,greatest(0.0::DOUBLE,(px*dx+py*dy)/(dx*dx+dy*dy))) END AS t FROM
(SELECT *, (({end_lng})-({lng}))*{k} AS dx, (({end_lat})-({lat}))*111 AS dy, (lng-({lng}))*{k} AS px, (lat-({lat}))*111 AS py, {hav(lat, lng, end_lat, end_lng)} AS whole FROM {rows} WHERE month_count>0)))"""


START_SQL, END_SQL = tuple(f"({x}::DOUBLE)" for x in START), tuple(f"({x}::DOUBLE)" for x in END)
MORE["along"] = _segment_sql(START_SQL, *END_SQL)
MORE["around"] = _segment_sql(START_SQL, *START_SQL)
MORE["ranked"] = f"SELECT * FROM {_rank_sql('radial')}"
MORE["auto"] = f"SELECT region_id, center_lat, center_lng, distance_km, score FROM ranked WHERE {hav(LAT_SQL, LNG_SQL, 'center_lat', 'center_lng')}>=50 ORDER BY ranked.score DESC, region_id LIMIT 1"
MORE["toward"] = _segment_sql((LAT_SQL, LNG_SQL), "center_lat", "center_lng", "(SELECT b.*, d.center_lat, d.center_lng FROM base b CROSS JOIN auto d)")
MORE["autocorr"] = f"SELECT * FROM {_rank_sql(f'(SELECT region_id, taxon_id, lat, lng, month_count, w_pheno, distance_km FROM toward WHERE off_km <= {CORRIDOR})')}"
MORE["corr"] = f"SELECT * FROM {_rank_sql(f'(SELECT * FROM along WHERE off_km <= {CORRIDOR})')}"


def query(name: str, sql: str = "", uses: str = "", more: str = ""):
    """Register a query, with its SQL over the named views and `more` ones; round() is written as r6()."""

    def put(f: Callable) -> Callable:
        _queries[name] = f
        if sql:
            ctes = [f"{v} AS ({views.SQL.get(v) or MORE[v]})" for v in uses.split()] + ([more] if more else [])
            _sql[name] = ("WITH RECURSIVE " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return put


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n},6) AS {n}" for n in names)


def _phenology(spark, d: str) -> DataFrame:
    return stored.season_table(spark, d, "phenology", CELL)


def _recent(spark, d: str) -> DataFrame:
    return phenology.recent_from_daily(stored.season_table(spark, d, "daily", CELL), AS_OF, WEEKS, TAXA)


def _ranked(spark, d: str) -> DataFrame:
    return ranking.radial(_phenology(spark, d), _recent(spark, d), MONTHS, TAXA, LAT, LNG, RADIUS)


def _corridor(spark, d: str) -> DataFrame:
    return ranking.corridor(_phenology(spark, d), _recent(spark, d), MONTHS, TAXA, START, END, CORRIDOR)


RANK = ["region_id", "distance_km", "n_species", "recent_count", "score_norm"]
PHEN = "lobs binned phen"


@query("build_phenology", f"SELECT region_id, taxon_id, month, cnt, {s6('center_lat', 'center_lng')} FROM phen", PHEN)
def _(s, d):
    return phenology.build_phenology(views.line_observations(s, d), CELL).select("region_id", "taxon_id", "month", "cnt", *r6("center_lat", "center_lng"))


@query("published_phenology", f"SELECT region_id, taxon_id, month, cnt, {s6('center_lat', 'center_lng')} FROM phen", PHEN)
def _(s, d):
    return _phenology(s, d).select("region_id", "taxon_id", "month", "cnt", *r6("center_lat", "center_lng"))


@query("published_regions", f"SELECT region_id, round({CENTER.format('lat')},6) AS center_lat, round({CENTER.format('lng')},6) AS center_lng, count(*) AS n_obs, count(DISTINCT taxon_id) AS n_taxa FROM binned GROUP BY 1", "lobs binned")
def _(s, d):
    return stored.season_table(s, d, "regions", CELL).select("region_id", *r6("center_lat", "center_lng"), "n_obs", "n_taxa")


@query("published_daily", "SELECT region_id, taxon_id, observed_on, count(*) AS cnt FROM binned GROUP BY ALL", "lobs binned")
def _(s, d):
    return stored.season_table(s, d, "daily", CELL)


@query("build_regions", f"SELECT region_id, round({CENTER.format('lat')},6) AS center_lat, round({CENTER.format('lng')},6) AS center_lng, count(*) AS n_obs, count(DISTINCT taxon_id) AS n_taxa FROM binned GROUP BY 1", "lobs binned")
def _(s, d):
    return phenology.build_regions(views.line_observations(s, d), CELL).select("region_id", *r6("center_lat", "center_lng"), "n_obs", "n_taxa")


@query("rank_destinations", f"SELECT {', '.join(RANK)}, {s6('center_lat', 'center_lng', 'score')} FROM ranked", PHEN + " recent base radial ranked")
def _(s, d):
    return _ranked(s, d).select(*RANK, *r6("center_lat", "center_lng", "score"))


@query("destinations_in_order", "SELECT row_number() OVER (ORDER BY score DESC, region_id)::INT AS place, region_id, score_norm FROM ranked", PHEN + " recent base radial ranked")
def _(s, d):
    return ranking.in_order(_ranked(s, d)).select("place", "region_id", "score_norm")


@query("rank_around_a_point", f"SELECT {', '.join(RANK)}, round(score,6) AS score FROM {_rank_sql(f'(SELECT * FROM around WHERE off_km <= {CORRIDOR})')}", PHEN + " recent base around")
def _(s, d):
    rows = ranking.corridor(_phenology(s, d), _recent(s, d), MONTHS, TAXA, START, START, CORRIDOR)  # start = end
    return rows.select(*RANK, *r6("score"))


@query("rank_destinations_species", "SELECT region_id, taxon_id, coalesce(name, taxon_id::VARCHAR) AS name, common_name, month_count, total_count, round(w_pheno,6) AS w_pheno FROM radial LEFT JOIN genera USING (taxon_id)", PHEN + " base radial genera")
def _(s, d):
    rows = ranking.radial_rows(_phenology(s, d), MONTHS, TAXA, LAT, LNG, RADIUS)
    return ranking.species(rows, views.genera(s, d)).withColumn("w_pheno", F.round("w_pheno", 6))


@query("rank_corridor", f"SELECT {', '.join(RANK)}, {s6('center_lat', 'center_lng', 'score')} FROM corr", PHEN + " recent base along corr")
def _(s, d):
    return _corridor(s, d).select(*RANK, *r6("center_lat", "center_lng", "score"))


@query("rank_destinations_lists", "SELECT region_id, score_norm, string_agg(coalesce(name, taxon_id::VARCHAR)||':'||month_count, ',' ORDER BY month_count DESC, taxon_id) AS species FROM ranked JOIN radial USING (region_id) LEFT JOIN genera USING (taxon_id) GROUP BY 1,2", PHEN + " recent base radial ranked genera")
def _(s, d):
    rows = ranking.radial_rows(_phenology(s, d), MONTHS, TAXA, LAT, LNG, RADIUS)
    listed = ranking.with_species(ranking.rank(rows, _recent(s, d)), rows, views.genera(s, d))
    return listed.select("region_id", "score_norm", F.array_join(F.transform("species", lambda x: F.concat(x["name"], F.lit(":"), x["month_count"].cast("string"))), ",").alias("species"))


@query("recent_counts", "SELECT * FROM recent", "lobs binned recent")
def _(s, d):
    return phenology.recent_counts(views.line_observations(s, d), CELL, AS_OF, WEEKS, TAXA)


@query("recent_counts_from_daily", "SELECT * FROM recent", "lobs binned recent")
def _(s, d):
    return _recent(s, d)


TOTALS = "(SELECT g.region_id, m.month::INT AS month, coalesce(sum(cnt),0)::BIGINT AS total FROM (SELECT DISTINCT region_id FROM phen) g CROSS JOIN range(1,13) m(month) LEFT JOIN phen p ON p.region_id=g.region_id AND p.month=m.month GROUP BY 1,2)"


@query("place_calendar", f"SELECT * FROM {TOTALS}", PHEN)
def _(s, d):
    return calendar.month_totals(_phenology(s, d))


@query("calendar_heat", f"SELECT region_id, month, round(total/greatest(1,max(total) OVER (PARTITION BY region_id)),6) AS heat FROM {TOTALS}", PHEN)
def _(s, d):
    return calendar.heat(calendar.month_totals(_phenology(s, d))).withColumn("heat", F.round("heat", 6))


LABEL = "coalesce(name,taxon_id::VARCHAR)||coalesce(' ('||common_name||')','')"


@query("calendar_top15", f"SELECT region_id, month, CASE WHEN row_number() OVER (PARTITION BY region_id,month,label ORDER BY place)>1 THEN label||' #'||taxon_id ELSE label END AS label, taxon_id, cnt FROM (SELECT *, {LABEL} AS label FROM (SELECT *, row_number() OVER (PARTITION BY region_id,month ORDER BY cnt DESC,taxon_id) AS place FROM phen) LEFT JOIN genera USING (taxon_id) WHERE place<=15)", PHEN + " genera")
def _(s, d):
    return calendar.top_taxa(_phenology(s, d), views.genera(s, d))


RECENT = f"(SELECT * FROM obinned WHERE observed_on >= DATE '{AS_OF}' - {7 * WEEKS})"


@query("alerts", f"SELECT region_id, taxon_id, count(*) AS cnt, max(observed_on) AS last_observed, max_by(ROW(place_guess,uri,obscured), ROW(observed_on,id))[1] AS place_guess, max_by(ROW(place_guess,uri,obscured), ROW(observed_on,id))[2] AS uri, max_by(ROW(place_guess,uri,obscured), ROW(observed_on,id))[3] AS obscured FROM {RECENT} GROUP BY 1,2", "oobs obinned")
def _(s, d):
    return calendar.alerts(calendar.recent_rows(views.order_observations(s, d), CELL, AS_OF, WEEKS))


@query("alerts_region_total", f"SELECT region_id, round({CENTER.format('lat')},6) AS center_lat, round({CENTER.format('lng')},6) AS center_lng, count(*) AS total, round(least(1.0::DOUBLE,count(*)/10),6) AS weight FROM {RECENT} GROUP BY 1", "oobs obinned")
def _(s, d):
    return calendar.alert_regions(calendar.recent_rows(views.order_observations(s, d), CELL, AS_OF, WEEKS)).select("region_id", *r6("center_lat", "center_lng"), "total", F.round("weight", 6).alias("weight"))


@query("alerts_near", f"""SELECT dense_rank() OVER (ORDER BY total DESC, region_id)::INT AS place, region_id, round(km,1) AS distance_km, total, taxon_id, coalesce(name, taxon_id::VARCHAR) AS name, cnt, last_observed, coalesce(obscured,false) AS obscured
FROM (SELECT region_id, taxon_id, count(*) AS cnt, max(observed_on) AS last_observed, max_by(ROW(obscured), ROW(observed_on,id))[1] AS obscured FROM {RECENT} GROUP BY 1,2)
JOIN (SELECT *, {hav(LAT_SQL, LNG_SQL, 'center_lat', 'center_lng')} AS km FROM (SELECT region_id, {CENTER.format('lat')} AS center_lat, {CENTER.format('lng')} AS center_lng, count(*) AS total FROM {RECENT} GROUP BY 1)) USING (region_id)
LEFT JOIN genera USING (taxon_id) WHERE km<={RADIUS}""", "oobs obinned genera")
def _(s, d):
    recent = calendar.recent_rows(views.order_observations(s, d), CELL, AS_OF, WEEKS)
    return calendar.alerts_near(recent, views.genera(s, d), LAT, LNG, RADIUS).select("place", "region_id", "distance_km", "total", "taxon_id", "name", "cnt", "last_observed", "obscured")


@query("alert_lists", f"""SELECT region_id, total, string_agg(taxon_id||':'||cnt, ',' ORDER BY cnt DESC, taxon_id) AS species FROM (SELECT region_id, taxon_id, count(*) AS cnt FROM {RECENT} GROUP BY 1,2)
JOIN (SELECT *, {hav(LAT_SQL, LNG_SQL, 'center_lat', 'center_lng')} AS km FROM (SELECT region_id, {CENTER.format('lat')} AS center_lat, {CENTER.format('lng')} AS center_lng, count(*) AS total FROM {RECENT} GROUP BY 1)) USING (region_id) WHERE km<={RADIUS} GROUP BY 1,2""", "oobs obinned")
def _(s, d):
    recent = calendar.recent_rows(views.order_observations(s, d), CELL, AS_OF, WEEKS)
    rows = calendar.alert_lists(calendar.alerts_near(recent, views.genera(s, d), LAT, LNG, RADIUS))
    return rows.select("region_id", "total", F.array_join(F.transform("species", lambda x: F.concat(x["taxon_id"].cast("string"), F.lit(":"), x["cnt"].cast("string"))), ",").alias("species"))


PHOTOS = "CASE WHEN o_orderkey%3>0 THEN array(named_struct('url', concat('p/', o_orderkey), 'license_code', CASE o_orderkey%4 WHEN 0 THEN 'CC-BY' WHEN 1 THEN 'all-rights' WHEN 2 THEN 'cc0' END, 'attribution', o_orderpriority)) ELSE array() END"


@query("recent_page_photos", "SELECT id, observed_on, (id%3>0 AND id%4 IN (0,2))::INT AS n_photos, CASE WHEN id%3>0 AND id%4 IN (0,2) THEN 'p/'||id END AS url FROM obinned ORDER BY observed_on DESC NULLS FIRST, id DESC LIMIT 100", "oobs obinned")
def _(s, d):
    given = views.table(s, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.expr(PHOTOS).alias("photos"))).alias("json"))
    photos = payloads.open_photos(payloads.parsed(given, "json", payloads.OBSERVATION).select(F.struct("*").alias("o")))
    page = calendar.recent_page(views.order_observations(s, d), CELL, 0, 99).select("id", "observed_on")
    return calendar.with_photos(page, photos).select("id", "observed_on", F.size("photos").alias("n_photos"), F.get("photos", F.lit(0))["url"].alias("url"))


@query("points_in_order", f"SELECT row_number() OVER (ORDER BY observed_on DESC NULLS FIRST, id)::INT AS place, id, coalesce(name, taxon_id::VARCHAR) AS name, observed_on FROM (SELECT *, {hav(LAT_SQL, LNG_SQL, 'lat', 'lng')} AS km FROM oobs WHERE quality_grade='research' AND obscured=false AND {boxed(LAT_SQL, LNG_SQL, '60.0::DOUBLE')}) LEFT JOIN genera USING (taxon_id) WHERE km<=60", "oobs genera")
def _(s, d):
    rows = calendar.points_in_order(calendar.precise_points(stored.points_near(s, d, LAT, LNG, 60.0), LAT, LNG, 60.0), views.genera(s, d))
    return calendar.with_places(rows).select("place", "id", "name", "observed_on")


@query("recent_observations_page", "SELECT id, taxon_id, region_id, observed_on, place_guess FROM obinned ORDER BY observed_on DESC NULLS FIRST, id DESC LIMIT 13 OFFSET 24", "oobs obinned")
def _(s, d):
    return calendar.recent_page(views.order_observations(s, d), CELL, 24, 12).select("id", "taxon_id", "region_id", "observed_on", "place_guess")


@query("recent_page_by_cursor", "SELECT id, taxon_id, region_id, observed_on, place_guess FROM obinned ORDER BY observed_on DESC NULLS FIRST, id DESC LIMIT 13 OFFSET 36", "oobs obinned")
def _(s, d):
    folder = stored.sightings(s, d)
    rows, days, cursor = s.read.parquet(f"{folder}/by_day"), s.read.parquet(f"{folder}/days"), None
    for _ in range(3):  # three pages on, each from the last row of the one before
        page = calendar.page_after(rows, days, CELL, 12, cursor).select("observed_on", "id").collect()
        cursor = tuple(page[min(11, len(page) - 1)])
    return calendar.page_after(rows, days, CELL, 12, cursor).select("id", "taxon_id", "region_id", "observed_on", "place_guess")


@query("precise_observations", f"SELECT id, taxon_id, round(km,6) AS distance_km FROM (SELECT *, {hav(LAT_SQL, LNG_SQL, 'lat', 'lng')} AS km FROM oobs WHERE quality_grade='research' AND obscured=false AND {boxed(LAT_SQL, LNG_SQL, '60.0::DOUBLE')}) WHERE km<=60", "oobs")
def _(s, d):
    return calendar.precise_points(stored.points_near(s, d, LAT, LNG, 60.0), LAT, LNG, 60.0).select("id", "taxon_id", *r6("distance_km"))


def _near(s, d: str, name: str, radius_km: float) -> DataFrame:
    return stored.place_table(s, d, name, LAT, LNG, radius_km)


CAMPS = f"(SELECT *, round(km,1) AS distance_km FROM (SELECT *, {hav(LAT_SQL, LNG_SQL, 'lat', 'lng')} AS km FROM camps WHERE {boxed(LAT_SQL, LNG_SQL, f'{RADIUS}::DOUBLE')}) WHERE km<={RADIUS})"


@query("camps_near", f"SELECT id, name, free, distance_km FROM {CAMPS}", "camps")
def _(s, d):
    return proximity.camps_near(_near(s, d, "camps", RADIUS), LAT, LNG, RADIUS).select("id", "name", "free", "distance_km")


@query("camps_near_free_only", f"SELECT id, name, free, distance_km FROM {CAMPS} WHERE coalesce(free,false) ORDER BY km, id LIMIT 10", "camps")
def _(s, d):
    return proximity.first_camps(proximity.camps_near(_near(s, d, "camps", RADIUS), LAT, LNG, RADIUS, True), 10).select("id", "name", "free", "distance_km")


@query("land_near", f"SELECT id, agency, unit FROM land WHERE {boxed(LAT_SQL, LNG_SQL, '40.0::DOUBLE', True)}", "land")
def _(s, d):
    return proximity.land_near(_near(s, d, "land", 40.0), LAT, LNG, 40.0).select("id", "agency", "unit")


TRAILS = f"(SELECT *, round(km,1) AS distance_km FROM (SELECT *, {hav(LAT_SQL, LNG_SQL, 'center_lat', 'center_lng')} AS km FROM trails WHERE {boxed(LAT_SQL, LNG_SQL, '90.0::DOUBLE', True)}) WHERE km<=90)"


@query("trails_near", f"SELECT id, name, kind, distance_km FROM {TRAILS}", "trails")
def _(s, d):
    return proximity.trails_near(_near(s, d, "trails", 90.0), LAT, LNG, 90.0).select("id", "name", "kind", "distance_km")


@query("trails_near_kind_limit", f"SELECT id, name, kind, distance_km FROM {TRAILS} WHERE kind='trailhead' ORDER BY km, id LIMIT 8", "trails")
def _(s, d):
    return proximity.first_trails(proximity.trails_near(_near(s, d, "trails", 90.0), LAT, LNG, 90.0, "trailhead"), 8).select("id", "name", "kind", "distance_km")


@query("trails_nearest_camp", f"SELECT t.id, round(min({hav('t.center_lat', 't.center_lng', 'c.lat', 'c.lng')}),6) AS camp_km FROM trails t LEFT JOIN camps c ON true GROUP BY 1", "trails camps")
def _(s, d):
    points = views.trails(s, d).select(F.col("id").alias("key"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"))
    sites = views.camps(s, d).select(F.col("id").alias("site"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    return proximity.nearest_site(points, sites).select(F.col("key").alias("id"), F.round("km", 6).alias("camp_km"))


@query("nearest_trail_vertex", f"SELECT id, name, round(km,1) AS distance_km FROM (SELECT id, name, {hav(LAT_SQL, LNG_SQL, '(min_lat+i/1024.0::DOUBLE)', '(min_lng+i/1024.0::DOUBLE)')} AS km FROM (SELECT *, unnest(range(0,steps+1)) AS i FROM trails WHERE kind IN ('path','route') AND {boxed(LAT_SQL, LNG_SQL, '50.0::DOUBLE', True)})) WHERE km<=50 ORDER BY km, id LIMIT 1", "trails")
def _(s, d):
    return proximity.nearest_vertex(views.vertices(_near(s, d, "trails", 50.0)), LAT, LNG, 50.0).drop("kind")


@query("trail_by_id", "SELECT id, name, kind FROM trails WHERE id='7'", "trails")
def _(s, d):
    return proximity.trail_by_id(views.trails(s, d), "7").select("id", "name", "kind")


NETWORK = "SELECT p_partkey::VARCHAR AS trail_id, 'Way '||p_partkey AS name, 'path' AS kind FROM part WHERE p_partkey%6=0"
VERTEX_KM = hav(LAT_SQL, LNG_SQL, "(min_lat+i/1024.0::DOUBLE)", "(min_lng+i/1024.0::DOUBLE)")


def _network(s, d: str, trail_id: str) -> DataFrame:
    k = F.col("p_partkey")
    live = views.table(s, d, "part").where("p_partkey % 6 = 0").select(k.cast("string").alias("trail_id"), F.concat(F.lit("Way "), k.cast("string")).alias("name"), F.lit("path").alias("kind"))
    return proximity.resolve_network(views.vertices(views.trails(s, d)), live, trail_id, (LAT, LNG), 50.0)


@query("trail_network_own", f"SELECT trail_id AS id, name, kind, true AS authoritative FROM ({NETWORK}) WHERE trail_id='6'")
def _(s, d):
    return _network(s, d, "6")


@query("trail_network_nearest", f"SELECT id, name, kind, false AS authoritative FROM (SELECT id, name, kind, {VERTEX_KM} AS km FROM (SELECT *, unnest(range(0,steps+1)) AS i FROM trails WHERE kind IN ('path','route') AND {boxed(LAT_SQL, LNG_SQL, '50.0::DOUBLE', True)})) WHERE km<=50 ORDER BY km, id LIMIT 1", "trails")
def _(s, d):
    return _network(s, d, "3")  # a trailhead without a network of its own


#: Ways touch the trailheads one and, for some, four numbers below them; routes hold the ways one and four below.
WAYS = """ways AS (SELECT p_partkey AS k, CASE WHEN p_partkey%4=0 THEN 'Way '||p_partkey END AS nm, CASE WHEN p_partkey%7>0 THEN 3 ELSE 0 END AS ln FROM part WHERE p_partkey%3=1 AND p_partkey%5>0),
touch AS (SELECT k, k-1 AS head, nm, ln FROM ways WHERE k%2=0 UNION ALL SELECT k, k-4, nm, ln FROM ways WHERE k%10=0),
rels AS (SELECT p_partkey AS r, CASE WHEN p_partkey%4=1 THEN 'Route '||p_partkey END AS nm FROM part WHERE p_partkey%3=2 AND p_partkey%11>0),
via AS (SELECT DISTINCT head, r, rels.nm FROM touch JOIN rels ON r=k+1 OR r=k+4),
own AS (SELECT head, coalesce((SELECT arg_max(nm,r) FROM via v WHERE v.head=h.head AND nm IS NOT NULL), (SELECT arg_min(nm,k) FROM touch t WHERE t.head=h.head AND nm IS NOT NULL AND ln>0), 'Trail (OSM)') AS name,
  (SELECT count(*) FROM via v WHERE v.head=h.head) AS n_routes, (SELECT count(*) FROM touch t WHERE t.head=h.head AND ln>0) AS n_ways FROM (SELECT DISTINCT head FROM touch) h),
heads AS (SELECT * FROM trails WHERE kind='trailhead')"""


def _elements(s, d: str) -> DataFrame:
    spot = lambda n: f"named_struct('lat', double(k%50)+{n}, 'lon', double(k%60)+{n})"
    way = f"named_struct('type', 'way', 'id', k, 'nodes', filter(array(CASE WHEN k%2=0 THEN k-1 END, CASE WHEN k%10=0 THEN k-4 END, 9000000+k), x -> x IS NOT NULL), 'tags', map_filter(map('highway', CASE WHEN k%5>0 THEN 'path' END, 'name', CASE WHEN k%4=0 THEN concat('Way ', k) END), (a, b) -> b IS NOT NULL), 'geometry', CASE WHEN k%7>0 THEN array({spot(0)}, {spot(1)}, {spot(2)}) ELSE array() END)"
    member = lambda n: f"named_struct('type', 'way', 'ref', k-{n}, 'geometry', array({spot(n)}, {spot(n + 1)}))"
    rel = f"named_struct('type', 'relation', 'id', k, 'tags', map_filter(map('route', CASE WHEN k%11>0 THEN 'hiking' ELSE 'bicycle' END, 'name', CASE WHEN k%4=1 THEN concat('Route ', k) END), (a, b) -> b IS NOT NULL), 'members', array({member(1)}, named_struct('type', 'node', 'ref', 5L, 'geometry', null), {member(4)}))"
    given = views.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("k"))
    json = F.expr(f"CASE WHEN k%3=1 THEN concat('{{\"elements\":[', to_json({way}), ']}}') WHEN k%3=2 THEN concat('{{\"elements\":[', to_json({rel}), ']}}') END")
    return network.elements(payloads.parsed(given.select(json.alias("json")), "json", payloads.ELEMENTS))


@query("trailhead_networks", f"""SELECT h.id AS asked, CASE WHEN o.n_routes+o.n_ways>0 THEN 'network' WHEN g.id IS NULL THEN 'none' ELSE 'nearest' END AS state, CASE WHEN o.n_routes+o.n_ways>0 THEN h.id ELSE g.id END AS id,
CASE WHEN o.n_routes+o.n_ways>0 THEN o.name ELSE g.name END AS name, CASE WHEN o.n_routes>0 THEN 'route' WHEN o.n_ways>0 THEN 'path' ELSE g.kind END AS kind, CASE WHEN o.n_routes+o.n_ways>0 THEN 3*o.n_ways+4*o.n_routes END::INT AS vertices
FROM heads h LEFT JOIN own o ON o.head=h.id::BIGINT LEFT JOIN (SELECT head, arg_min(id, ROW(km, id)) AS id, arg_min(name, ROW(km, id)) AS name, arg_min(kind, ROW(km, id)) AS kind FROM
(SELECT h.id AS head, t.id, t.name, t.kind, {hav('h.center_lat', 'h.center_lng', '(t.min_lat+i/1024.0::DOUBLE)', '(t.min_lng+i/1024.0::DOUBLE)')} AS km FROM heads h JOIN (SELECT *, unnest(range(0,steps+1)) AS i FROM trails WHERE kind IN ('path','route')) t ON {boxed('h.center_lat', 'h.center_lng', '8.0::DOUBLE', True).replace('min_lat', 't.min_lat').replace('max_lat', 't.max_lat').replace('min_lng', 't.min_lng').replace('max_lng', 't.max_lng')}) WHERE km<=8 GROUP BY 1) g ON g.head=h.id""", "trails", WAYS)
def _(s, d):
    at = F.when(F.col("kind") == "trailhead", F.concat(F.lit("osm:node/"), "id")).otherwise(F.col("id"))
    trails = views.vertices(views.trails(s, d)).withColumn("id", at)
    rows = network.resolve(trails.where("kind = 'trailhead'").select("id"), trails, _elements(s, d), 8.0)
    plain = lambda c: F.regexp_replace(c, "^osm:node/", "").alias(c)
    return rows.select(plain("asked"), "state", plain("id"), "name", "kind", F.when(F.col("state") == "network", F.size(payloads.vertices_of("geojson"))).alias("vertices"))


@query("trails_near_with_camp", f"SELECT t.id, t.distance_km, round(min({hav('t.center_lat', 't.center_lng', 'c.lat', 'c.lng')}),1) AS camp_km FROM {TRAILS} t LEFT JOIN camps c ON true GROUP BY 1,2", "trails camps")
def _(s, d):
    near = proximity.trails_near(_near(s, d, "trails", 90.0), LAT, LNG, 90.0)
    sites = views.camps(s, d).select(F.col("id").alias("site"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    points = near.select(F.col("id").alias("key"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"), "distance_km")
    return proximity.nearest_site(points, sites).select(F.col("key").alias("id"), "distance_km", F.round("km", 1).alias("camp_km"))


@query("thin_vertices", "SELECT id, count(*) AS n, round(sum(min_lat+round_even(i*steps/19.0,0)/1024.0::DOUBLE),6) AS sum_lat FROM (SELECT *, unnest(range(0,20)) AS i FROM trails WHERE steps+1>20) GROUP BY 1", "trails")
def _(s, d):
    t = views.vertices(views.trails(s, d)).where("steps + 1 > 20").select("id", F.explode(geo.thin("vertices", 20)).alias("v"))
    return t.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("v.lat"), 6).alias("sum_lat"))


@query("union_bbox", "SELECT agency, min(min_lat) AS min_lat, min(min_lng) AS min_lng, max(max_lat) AS max_lat, max(max_lng) AS max_lng FROM land GROUP BY 1", "land")
def _(s, d):
    return payloads.union_bbox(views.land(s, d), "agency")


@query("tile_bboxes", "SELECT id, min_lat+i*0.25::DOUBLE AS min_lat, min_lng+j*0.25::DOUBLE AS min_lng, least(max_lat,min_lat+(i+1)*0.25::DOUBLE) AS max_lat, least(max_lng,min_lng+(j+1)*0.25::DOUBLE) AS max_lng FROM (SELECT *, unnest(range(0,ceil(size/0.25)::INT)) AS j FROM (SELECT *, unnest(range(0,ceil(size/0.25)::INT)) AS i FROM land))", "land")
def _(s, d):
    return views.land(s, d).select("id", F.inline(geo.tiles("min_lat", "min_lng", "max_lat", "max_lng", 0.25)))


def _circles_sql(r: float, q: float, n: int) -> str:
    return f"""SELECT id, round(clat,6) AS lat, round(clng,6) AS lng FROM (SELECT id, clat, clng, km, i, j FROM (SELECT *, {hav('lat', 'lng', 'clat', 'clng')} AS km FROM (SELECT id, lat, lng, i, j, lat+i*({q}::DOUBLE/111.0::DOUBLE) AS clat, lng+j*({q}::DOUBLE/(111.0::DOUBLE*greatest(abs(cos(radians(lat))),0.01::DOUBLE))) AS clng
FROM camps CROSS JOIN range({-n},{n + 1}) a(i) CROSS JOIN range({-n},{n + 1}) b(j))) WHERE km <= {r + q}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, i, j)<=200"""


@query("query_centers", _circles_sql(100.0, 30.0, 4), "camps")
def _(s, d):
    camps = views.camps(s, d)
    rows = layers.circles(camps, "id", 100.0, 30.0, camps.count())
    return rows.select("id", F.round("c.lat", 6).alias("lat"), F.round("c.lng", 6).alias("lng"))


@query("query_centers_capped", f"SELECT id, count(*) AS n, round(sum(lat),3) AS lat FROM ({_circles_sql(500.0, 45.5, 11)}) GROUP BY 1", "camps")
def _(s, d):
    camps = views.camps(s, d)
    rows = layers.circles(camps, "id", 500.0, 45.5, camps.count())
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(F.round("c.lat", 6)), 3).alias("lat"))


@query("region_center", "SELECT DISTINCT region_id, split_part(region_id,'_',1)::INT+0.5::DOUBLE AS lat, split_part(region_id,'_',2)::INT+0.5::DOUBLE AS lng FROM binned", "lobs binned")
def _(s, d):
    lat, lng = geo.region_center("region_id", CELL)
    return phenology.binned(views.line_observations(s, d), CELL).select("region_id").distinct().select("region_id", lat.alias("lat"), lng.alias("lng"))


@query("envelopes", "SELECT id, round(lat-25/111.0::DOUBLE,6) AS min_lat, round(lng-25/(111.0::DOUBLE*greatest(abs(cos(radians(lat))),0.01::DOUBLE)),6) AS min_lng, round(lat+25/111.0::DOUBLE,6) AS max_lat, round(lng+25/(111.0::DOUBLE*greatest(abs(cos(radians(lat))),0.01::DOUBLE)),6) AS max_lng FROM camps", "camps")
def _(s, d):
    return views.camps(s, d).select("id", geo.envelope("lat", "lng", 25.0).alias("e")).select("id", "e.*").select("id", *r6("min_lat", "min_lng", "max_lat", "max_lng"))


def _stops(s, d: str) -> DataFrame:
    return planner.stops(_corridor(s, d), views.camps(s, d), views.trails(s, d), 60.0, 30.0, 0.05, True, 8)


def _site(sites: str, lat: str, lng: str, r: float, order: str, more: str) -> str:
    return f"LEFT JOIN LATERAL (SELECT id, {hav('k.center_lat', 'k.center_lng', lat, lng)} AS km{more} FROM {sites} WHERE {boxed('k.center_lat', 'k.center_lng', f'{r}::DOUBLE', a=lat, b=lng)} AND {hav('k.center_lat', 'k.center_lng', lat, lng)}<={r} ORDER BY {order} LIMIT 1)"


MORE["stops"] = f"""SELECT k.region_id, k.center_lat AS lat, k.center_lng AS lng, k.score, k.distance_km, c.id AS camp_id, round(c.km,1) AS camp_km, c.f AS camp_free, t.id AS trail_id, round(t.km,1) AS trail_km
FROM (SELECT * FROM corr WHERE score_norm>=0.05) k {_site('camps', 'lat', 'lng', 60.0, 'coalesce(free,false) DESC, km, id', ', coalesce(free,false) AS f')} c ON true {_site('trails', 'center_lat', 'center_lng', 30.0, 'km, id', '')} t ON true WHERE coalesce(c.f,false) ORDER BY k.score DESC, k.region_id LIMIT 8"""
PLAN = PHEN + " recent base along corr camps trails stops"


@query("plan_candidates", "SELECT region_id, distance_km, camp_id, camp_km, camp_free, trail_id, trail_km FROM stops", PLAN)
def _(s, d):
    return _stops(s, d).select(F.col("key").alias("region_id"), "distance_km", "camp_id", "camp_km", "camp_free", "trail_id", "trail_km")


LEG = hav("w.lat", "w.lng", "o.lat", "o.lng")


MORE["ordered"] = "SELECT *, row_number() OVER (ORDER BY distance_km, score DESC, region_id) AS n FROM stops"
MORE["walk"] = f"""SELECT 0::BIGINT AS n, ''::VARCHAR AS region_id, {START[0]}::DOUBLE AS lat, {START[1]}::DOUBLE AS lng, 0.0::DOUBLE AS leg, 0.0::DOUBLE AS total, 0 AS skipped, true AS took
UNION ALL SELECT o.n, o.region_id, CASE WHEN {LEG}>170 THEN w.lat ELSE o.lat END, CASE WHEN {LEG}>170 THEN w.lng ELSE o.lng END, {LEG}, CASE WHEN {LEG}>170 THEN w.total ELSE w.total+{LEG} END, CASE WHEN {LEG}>170 THEN w.skipped+1 ELSE w.skipped END, {LEG}<=170 FROM walk w JOIN ordered o ON o.n=w.n+1"""


@query("plan_route", f"""SELECT (row_number() OVER (ORDER BY n)-1)::INT AS pos, region_id, round(leg,4) AS leg_km, round(total,4) AS total_km, (SELECT max(skipped) FROM walk)::INT AS skipped FROM walk WHERE n>0 AND took""", PLAN + " ordered walk")
def _(s, d):
    return planner.walk(_stops(s, d), START, 170.0).select("pos", "region_id", "leg_km", "total_km", "skipped")


def _trip_sql(corridor: str) -> str:
    """stops, ordered and walk of a plan over a corridor, with all that a stop carries."""
    sites = f"{_site('camps', 'lat', 'lng', 60.0, 'coalesce(free,false) DESC, km, id', ', coalesce(free,false) AS f')} c ON true {_site('trails', 'center_lat', 'center_lng', 60.0, 'km, id', '')} t ON true"
    leg = hav("w.lat", "w.lng", "o.center_lat", "o.center_lng")
    return f"""stops AS (SELECT k.*, c.id AS camp_id, c.f AS camp_free, t.id AS trail_id, round(t.km,1) AS trail_km FROM {corridor} k {sites} ORDER BY k.score DESC, k.region_id LIMIT 8),
ordered AS (SELECT *, row_number() OVER (ORDER BY distance_km, score DESC, region_id) AS n FROM stops),
walk AS (SELECT 0::BIGINT AS n, {LAT_SQL} AS lat, {LNG_SQL} AS lng, 0.0::DOUBLE AS leg, 0.0::DOUBLE AS total, 0 AS skipped, true AS took
UNION ALL SELECT o.n, CASE WHEN {leg}>150 THEN w.lat ELSE o.center_lat END, CASE WHEN {leg}>150 THEN w.lng ELSE o.center_lng END, {leg}, CASE WHEN {leg}>150 THEN w.total ELSE w.total+{leg} END, CASE WHEN {leg}>150 THEN w.skipped+1 ELSE w.skipped END, {leg}<=150 FROM walk w JOIN ordered o ON o.n=w.n+1)"""


AUTO = PHEN + " recent base radial ranked auto toward autocorr"


@query("plan_trip", f"SELECT (row_number() OVER (ORDER BY w.n)-1)::INT AS pos, region_id, distance_km AS progress_km, score_norm, n_species, recent_count, camp_id, camp_free, trail_id, trail_km, round(leg,1) AS leg_km, round(total,1) AS total_km, (SELECT max(skipped) FROM walk)::INT AS skipped FROM walk w JOIN ordered o ON o.n=w.n WHERE took", AUTO + " camps trails", _trip_sql("autocorr"))
def _(s, d):
    p, recent = _phenology(s, d), _recent(s, d)
    goal = planner.destination(ranking.radial(p, recent, MONTHS, TAXA, LAT, LNG, RADIUS), (LAT, LNG), 50.0)
    corridor = ranking.corridor_to(p, recent, MONTHS, TAXA, (LAT, LNG), goal, CORRIDOR)
    chosen = planner.stops(corridor, views.camps(s, d), views.trails(s, d), 60.0, 60.0, 0.0, False, 8)
    rows = planner.walk(chosen, (LAT, LNG), 150.0)
    return rows.select("pos", "region_id", "progress_km", "score_norm", "n_species", "recent_count", "camp_id", "camp_free", "trail_id", "trail_km", F.round("leg_km", 1).alias("leg_km"), F.round("total_km", 1).alias("total_km"), "skipped")


@query("plan_header", f"SELECT round(coalesce((SELECT center_lat FROM auto),{LAT}),6) AS destination_lat, (SELECT region_id FROM auto) AS destination_name, count(*) FILTER (WHERE n>0 AND took) AS n_stops, round(max(total),1) AS total_drive_km, max(skipped)::INT AS skipped_unreachable FROM walk", AUTO + " camps trails", _trip_sql("autocorr"))
def _(s, d):
    p, recent = _phenology(s, d), _recent(s, d)
    goal = planner.destination(ranking.radial(p, recent, MONTHS, TAXA, LAT, LNG, RADIUS), (LAT, LNG), 50.0)
    corridor = ranking.corridor_to(p, recent, MONTHS, TAXA, (LAT, LNG), goal, CORRIDOR)
    walked = planner.walk(planner.stops(corridor, views.camps(s, d), views.trails(s, d), 60.0, 60.0, 0.0, False, 8), (LAT, LNG), 150.0)
    return planner.header(walked, (LAT, LNG), goal, CORRIDOR, MONTHS).select(*r6("destination_lat"), "destination_name", "n_stops", "total_drive_km", "skipped_unreachable")


@query("auto_destination", "SELECT region_id, distance_km, round(score,6) AS score FROM auto", PHEN + " recent base radial ranked auto")
def _(s, d):
    return planner.destination(_ranked(s, d), (LAT, LNG), 50.0).select("region_id", "distance_km", F.round("score", 6).alias("score"))


@query("search_genera", "SELECT taxon_id, name, common_name, observations_count FROM genera WHERE name ILIKE '%on_1%' OR coalesce(common_name ILIKE '%on_1%',false) ORDER BY observations_count DESC NULLS LAST, name, taxon_id LIMIT 20", "genera")
def _(s, d):
    return coverage.search(views.genera(s, d), "on_1").select("taxon_id", "name", "common_name", F.col("observations_count").cast("int").alias("observations_count"))


@query("selected_genera", "SELECT device_id, taxon_id, name FROM (SELECT DISTINCT 'device-'||(c_custkey%100) AS device_id, (c_custkey%40)::BIGINT AS taxon_id FROM customer) JOIN genera USING (taxon_id)", "genera")
def _(s, d):
    picks = views.table(s, d, "customer").select(F.concat(F.lit("device-"), (F.col("c_custkey") % 100).cast("string")).alias("device_id"), (F.col("c_custkey") % 40).alias("taxon_id")).distinct()
    return picks.join(views.genera(s, d), "taxon_id").select("device_id", "taxon_id", "name")


@query("selected_in_order", "SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY name, taxon_id)::INT AS place, taxon_id, name FROM (SELECT DISTINCT 'device-'||(c_custkey%100) AS device_id, (c_custkey%40)::BIGINT AS taxon_id FROM customer) JOIN genera USING (taxon_id)", "genera")
def _(s, d):
    picks = views.table(s, d, "customer").select(F.concat(F.lit("device-"), (F.col("c_custkey") % 100).cast("string")).alias("device_id"), (F.col("c_custkey") % 40).alias("taxon_id")).distinct()
    rows = picks.join(views.genera(s, d), "taxon_id")
    return rows.select("device_id", F.row_number().over(Window.partitionBy("device_id").orderBy("name", "taxon_id")).alias("place"), "taxon_id", "name")


WORDS = "list_distinct([t FOR t IN regexp_split_to_array(lower({0}), '[^a-z0-9]+') IF t <> ''])"
NAMED = f"""named AS (SELECT p_partkey::BIGINT AS place, p_name||' '||p_brand AS name, p_size AS weight, {WORDS.format("p_name||' '||p_brand")} AS t FROM part),
asks AS (SELECT s_suppkey::BIGINT AS question, CASE WHEN s_suppkey%4=0 THEN 'nowhere '||p_name ELSE upper(p_brand)||', '||p_name END AS text FROM supplier JOIN part ON p_partkey=s_suppkey*13%200)"""


def _named(s, d: str) -> tuple[DataFrame, DataFrame]:
    part, k = views.table(s, d, "part"), F.col("s_suppkey")
    named = part.select(F.col("p_partkey").cast("long").alias("place"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.col("p_size").alias("weight"))
    rows = views.table(s, d, "supplier").join(part.hint("merge"), F.col("p_partkey") == k * 13 % 200)
    return rows.select(k.cast("long").alias("question"), F.when(k % 4 == 0, F.concat(F.lit("nowhere "), "p_name")).otherwise(F.concat(F.upper("p_brand"), F.lit(", "), "p_name")).alias("text")), named


@query("place_lookup", f"SELECT question, arg_min(place, ROW(len(t), -weight, place)) AS place FROM (SELECT question, place, n.t, weight FROM (SELECT *, {WORDS.format('text')} AS w FROM asks) a JOIN named n ON list_has_all(n.t, a.w)) GROUP BY 1", more=NAMED)
def _(s, d):
    asked, named = _named(s, d)
    return places.lookup(asked, places.index(named)).select("question", "place")


@query("nearest_place", f"SELECT t.id, arg_min(c.id, ROW(round({hav('t.center_lat', 't.center_lng', 'c.lat', 'c.lng')},9), c.id)) AS camp, round(min({hav('t.center_lat', 't.center_lng', 'c.lat', 'c.lng')}),6) AS km FROM trails t CROSS JOIN camps c GROUP BY 1", "trails camps")
def _(s, d):
    points = views.trails(s, d).select(F.col("id").alias("key"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"))
    sites = views.camps(s, d).select(F.col("id").alias("site"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    return proximity.nearest_site(points, sites).select(F.col("key").alias("id"), F.col("site").alias("camp"), F.round("km", 6).alias("km"))


DEVICE = "'device-'||(c_custkey%100)"


def _devices(s, d: str) -> DataFrame:
    return views.table(s, d, "customer").select(F.concat(F.lit("device-"), (F.col("c_custkey") % 100).cast("string")).alias("device_id"), F.col("c_custkey").cast("long").alias("k"))


def _locations(s, d: str) -> DataFrame:
    """Homes after some changes, of which some devices made several, and some deletions."""
    rows = _devices(s, d).select("device_id", F.concat(F.lit("home "), F.col("k").cast("string")).alias("name"), (F.col("k") % 90).cast("double").alias("lat"), (-(F.col("k") % 180)).cast("double").alias("lng"), (F.col("k") % 4 * 50).cast("double").alias("radius_km"), F.col("k").alias("seq"))
    saved = devices.save_locations(s.createDataFrame([], schemas.LOCATIONS), rows.where("seq % 3 > 0"))
    return devices.delete_locations(saved, _devices(s, d).where("k % 50 = 7"))


@query("device_homes", f"SELECT v.device_id, coalesce(l.name,'Seattle') AS name, coalesce(l.lat,47.5::DOUBLE) AS lat, coalesce(nullif(l.radius_km,0),150.0::DOUBLE) AS radius_km, l.name IS NOT NULL AS is_own FROM (SELECT DISTINCT {DEVICE} AS device_id FROM customer) v LEFT JOIN (SELECT {DEVICE} AS device_id, 'home '||max(c_custkey) AS name, (max(c_custkey)%90)::DOUBLE AS lat, (max(c_custkey)%4*50)::DOUBLE AS radius_km FROM customer WHERE c_custkey%3>0 GROUP BY 1 HAVING bool_and(c_custkey%50<>7)) l USING (device_id)")
def _(s, d):
    return devices.homes(_devices(s, d), _locations(s, d), ("Seattle", 47.5, -122.25, 150.0)).select("device_id", "name", "lat", "radius_km", "is_own")


@query("device_genera", f"SELECT v.device_id, coalesce(taxa,'') AS taxa FROM (SELECT DISTINCT {DEVICE} AS device_id FROM customer) v LEFT JOIN (SELECT device_id, string_agg(taxon_id, ',' ORDER BY taxon_id) AS taxa FROM (SELECT DISTINCT {DEVICE} AS device_id, c_custkey%40 AS taxon_id FROM customer WHERE c_custkey%5<3 AND NOT (c_custkey%100<20 OR c_custkey%40=9)) GROUP BY 1) USING (device_id)")
def _(s, d):
    rows = _devices(s, d).select("device_id", (F.col("k") % 40).alias("taxon_id"), "k")
    chosen = devices.add_genera(devices.add_genera(rows.where("k % 5 = 0"), rows.where("k % 5 = 1")), rows.where("k % 5 < 3"))
    chosen = devices.remove_genera(chosen, rows.where("k % 100 < 20 OR taxon_id = 9"))
    return devices.filters(_devices(s, d), chosen).select("device_id", F.array_join(F.col("taxa").cast("array<string>"), ",").alias("taxa"))


@query("is_ingested", "SELECT key, key IN (SELECT key FROM log) AS ingested FROM (SELECT 'obs:fungi:place:'||n_nationkey||':2015-01-01:2024-01-15' AS key FROM nation)", "log")
def _(s, d):
    keys = views.table(s, d, "nation").select(F.concat(F.lit("obs:fungi:place:"), F.col("n_nationkey").cast("string"), F.lit(":2015-01-01:2024-01-15")).alias("key"))
    return coverage.is_ingested(views.ingest_log(s, d), keys)


@query("region_titles", "SELECT region_id, CASE WHEN kept THEN place WHEN n_nationkey%3=1 THEN 'F'||n_nationkey END AS place_name, CASE WHEN kept THEN 'cached' WHEN n_nationkey%3<2 THEN 'found' ELSE 'failed' END AS state FROM (SELECT n_nationkey, n_nationkey||'_0' AS region_id, n_nationkey%4=0 AS kept, CASE WHEN n_nationkey%8=0 THEN n_name END AS place FROM nation)")
def _(s, d):
    n, k = views.table(s, d, "nation"), F.col("n_nationkey")
    region = F.concat(k.cast("string"), F.lit("_0")).alias("region_id")
    kept = n.where("n_nationkey % 4 = 0").select(region, F.when(k % 8 == 0, F.col("n_name")).alias("place_name"))
    found = n.where("n_nationkey % 3 < 2").select(region, F.when(k % 3 == 1, F.concat(F.lit("F"), k.cast("string"))).alias("place_name"))
    return coverage.region_titles(n.select(region), kept, found)


@query("record_ingest", "SELECT coalesce(r.key,l.key) AS key, CASE WHEN r.key IS NULL THEN l.row_count ELSE r.row_count END AS row_count, CASE WHEN r.key IS NULL THEN l.fetched_at ELSE TIMESTAMP '2001-06-29' END AS fetched_at FROM (SELECT key, row_count, fetched_at FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY row_count DESC)=1) l FULL JOIN (SELECT 'obs:fungi:place:'||n_nationkey||':2015-01-01:2024-01-15' AS key, n_nationkey::BIGINT AS row_count FROM nation) r ON l.key=r.key", "log")
def _(s, d):
    k = F.col("n_nationkey").cast("long")
    runs = views.table(s, d, "nation").select(F.concat(F.lit("obs:fungi:place:"), k.cast("string"), F.lit(":2015-01-01:2024-01-15")).alias("key"), k.alias("row_count"), *[F.lit(None).cast("double").alias(c) for c in ("lat", "lng", "radius_km")], F.lit(1).alias("seq"))
    log = payloads.dedupe_last(views.ingest_log(s, d).withColumn("seq", F.col("row_count")), "key", "seq")
    return merge.record_ingest(log, runs, AS_OF).select("key", "row_count", "fetched_at")


@query("duplicate_genus_names", "SELECT name, count(*) AS n, sum(stored)::BIGINT AS stored FROM (SELECT name, taxon_id, count(*) AS stored FROM oobs JOIN genera USING (taxon_id) GROUP BY 1,2) GROUP BY 1 HAVING count(*)>1", "oobs genera")
def _(s, d):
    counts = phenology.species_counts(views.order_observations(s, d)).join(views.genera(s, d), "taxon_id")
    return counts.groupBy("name").agg(F.count("*").alias("n"), F.sum("cnt").alias("stored")).where("n > 1")


@query("suspect_genera", "SELECT taxon_id, name, count(*) AS stored, observations_count FROM oobs JOIN genera USING (taxon_id) GROUP BY 1,2,4 HAVING count(*)>1.5*coalesce(observations_count,0)", "oobs genera")
def _(s, d):
    return coverage.suspects(views.order_observations(s, d), views.genera(s, d), 1.5).withColumn("observations_count", F.col("observations_count").cast("int"))


@query("stale_batch", "SELECT id, revalidated_at FROM oobs ORDER BY revalidated_at ASC NULLS FIRST, id LIMIT 200", "oobs")
def _(s, d):
    return coverage.stale(views.order_observations(s, d), 200).select("id", "revalidated_at")


@query("coverage_report", "SELECT place, coalesce(row_count,0)::BIGINT AS row_count, fetched_at FROM (SELECT DISTINCT n_nationkey::VARCHAR AS place FROM nation) LEFT JOIN (SELECT split_part(key,':',4) AS place, row_count, fetched_at FROM log WHERE starts_with(key,'obs:fungi:place:') QUALIFY row_number() OVER (PARTITION BY split_part(key,':',4) ORDER BY fetched_at DESC, row_count DESC)=1) USING (place)", "log")
def _(s, d):
    places = views.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("place")).distinct()
    return coverage.report(places, views.ingest_log(s, d))


@query("latest_obs_date_by_place", "SELECT split_part(key,':',4) AS place, max(split_part(key,':',6)) AS latest FROM log WHERE starts_with(key,'obs:fungi:place:') GROUP BY 1", "log")
def _(s, d):
    return coverage.latest_by_place(views.ingest_log(s, d))


@query("latest_obs_date", f"SELECT max(split_part(key,':',-1)) AS latest FROM log WHERE lat IS NOT NULL AND {hav(LAT_SQL, LNG_SQL, 'lat', 'lng')}+20<=radius_km", "log")
def _(s, d):
    return coverage.latest_date(views.ingest_log(s, d), LAT, LNG, 20.0)


@query("covered_area", f"SELECT id AS area, coalesce(bool_or({hav('c.lat', 'c.lng', 'l.lat', 'l.lng')}+60<=l.radius_km),false) AS covered FROM camps c LEFT JOIN (SELECT DISTINCT lat,lng,radius_km FROM log WHERE lat IS NOT NULL) l ON true GROUP BY 1", "log camps")
def _(s, d):
    areas = views.camps(s, d).select(F.col("id").alias("area"), F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), F.lit(60.0).alias("a_radius"))
    return coverage.covered(areas, views.ingest_log(s, d), "obs:fungi:")


@query("covered_area_north", f"SELECT c.id AS area, bool_or({hav('(c.lat+36)', '(c.lng-50)', '(l.lat+36)', '(l.lng-60)')}+10<=l.radius_km*3) AS covered FROM camps c CROSS JOIN (SELECT DISTINCT lat,lng,radius_km FROM log WHERE lat IS NOT NULL) l GROUP BY 1", "log camps")
def _(s, d):
    areas = views.camps(s, d).select(F.col("id").alias("area"), (F.col("lat") + 36).alias("a_lat"), (F.col("lng") - 50).alias("a_lng"), F.lit(10.0).alias("a_radius"))
    log = views.ingest_log(s, d).withColumns({"lat": F.col("lat") + 36, "lng": F.col("lng") - 60, "radius_km": F.col("radius_km") * 3})
    return coverage.covered(areas, log, "obs:fungi:")


MERGED = ["taxon_id", "observed_on", "place_guess", "uri", "obscured"]
MORE["stored"] = "SELECT id, taxon_id, observed_on, place_guess, uri, obscured FROM oobs WHERE id%3>0"
MORE["batch"] = "SELECT id//2 AS id, id AS seq, CASE WHEN id%5>0 THEN taxon_id END AS taxon_id, CASE WHEN id%4>0 THEN observed_on END AS observed_on, CASE WHEN id%2>0 THEN place_guess END AS place_guess, uri, obscured FROM oobs"


def _stored(s, d: str) -> DataFrame:
    return views.order_observations(s, d).where("id % 3 > 0").select("id", *MERGED)


def _batch(s, d: str) -> DataFrame:
    o, k = views.order_observations(s, d), F.col("id")
    return o.select(F.floor(k / 2).cast("long").alias("id"), k.alias("seq"), F.when(k % 5 > 0, F.col("taxon_id")).alias("taxon_id"), F.when(k % 4 > 0, F.col("observed_on")).alias("observed_on"), F.when(k % 2 > 0, F.col("place_guess")).alias("place_guess"), "uri", "obscured")


@query("coalesce_merge", f"SELECT coalesce(s.id,b.id) AS id, {', '.join(f'coalesce(b.{c},s.{c}) AS {c}' for c in MERGED)} FROM stored s FULL JOIN (SELECT id, {', '.join(f'max_by({c},seq) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in MERGED)} FROM batch GROUP BY 1) b ON s.id=b.id", "oobs stored batch")
def _(s, d):
    return merge.coalesce_merge(_stored(s, d), _batch(s, d), "id", "seq", MERGED)


@query("overwrite_merge", f"SELECT id, {', '.join(MERGED)} FROM stored WHERE id NOT IN (SELECT id FROM batch) UNION ALL SELECT id, {', '.join(MERGED)} FROM batch QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC)=1", "oobs stored batch")
def _(s, d):
    return merge.overwrite_merge(_stored(s, d), _batch(s, d), "id", "seq")


@query("first_wins_merge", f"SELECT id, {', '.join(MERGED)} FROM stored UNION ALL (SELECT id, {', '.join(MERGED)} FROM batch WHERE id NOT IN (SELECT id FROM stored) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq)=1)", "oobs stored batch")
def _(s, d):
    return merge.first_wins_merge(_stored(s, d), _batch(s, d), "id", "seq")


@query("delete_observations", "SELECT id, taxon_id FROM stored WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')", "oobs stored")
def _(s, d):
    ids = views.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return merge.delete(_stored(s, d), ids, "id").select("id", "taxon_id")


@query("mark_revalidated", "SELECT id, CASE WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='A') THEN DATE '2001-06-29' ELSE revalidated_at END AS revalidated_at FROM oobs", "oobs")
def _(s, d):
    ids = views.table(s, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"))
    return merge.mark(views.order_observations(s, d).select("id", "revalidated_at"), ids, "id", "revalidated_at", AS_OF).select("id", F.col("revalidated_at").cast("date").alias("revalidated_at"))


@query("recheck_diff", "SELECT a.id, s.taxon_id, b.taxon_id AS live_taxon, CASE WHEN b.id IS NULL OR b.taxon_id IS NULL THEN 'purge' WHEN s.taxon_id<>b.taxon_id THEN 'reassign' ELSE 'keep' END AS action FROM (SELECT id FROM oobs WHERE id%4<2) a LEFT JOIN stored s ON a.id=s.id LEFT JOIN (SELECT id, CASE WHEN id%11>0 THEN (taxon_id+(id%13)//12)%25 END AS taxon_id FROM oobs WHERE id%10>0) b ON a.id=b.id", "oobs stored")
def _(s, d):
    o, k = views.order_observations(s, d), F.col("id")
    live = o.where("id % 10 > 0").select("id", F.when(k % 11 > 0, (F.col("taxon_id") + F.floor((k % 13) / 12)) % 25).alias("taxon_id"))
    return merge.recheck(live, _stored(s, d), o.where("id % 4 < 2").select("id"))


@query("resolve_genus", f"SELECT id AS key, CASE WHEN id%6=0 THEN NULL WHEN id%4=0 THEN taxon_id ELSE coalesce((SELECT min_by(g.taxon_id,p) FROM genera g JOIN (VALUES (0,24::BIGINT),(1,(id*7)%30),(2,(id*3)%25)) x(p,anc) ON g.taxon_id=anc), NULL) END AS genus_id FROM oobs", "oobs genera")
def _(s, d):
    k = F.col("id")
    rows = views.order_observations(s, d).select(k.alias("key"), "taxon_id", F.when(k % 4 == 0, "genus").otherwise("species").alias("rank"), F.when(k % 6 > 0, ROOT_TAXON).otherwise(1).alias("iconic_taxon_id"), F.array(F.lit(24).cast("long"), k * 7 % 30, k * 3 % 25).alias("ancestor_ids"))
    return payloads.resolve_genus(rows, views.genera(s, d)).select("key", "genus_id")


@query("bulk_filter", "SELECT p_partkey AS id, g.taxon_id, (p_partkey%90)::DOUBLE AS lat, TRY_CAST(p_partkey::BIGINT*1000 AS INT) AS positional_accuracy, CASE WHEN p_partkey::BIGINT*1000 BETWEEN 26000 AND 31000 THEN true END AS obscured FROM part JOIN (SELECT name, min(taxon_id) AS taxon_id FROM genera GROUP BY 1) g ON g.name='NATION_'||(p_partkey%30) WHERE p_partkey%5>0 AND p_partkey%7>0", "genera")
def _(s, d):
    k = F.col("p_partkey").cast("long")
    t = lambda c: c.cast("string")
    scan = views.table(s, d, "part").select(t(k).alias("id"), F.lit("2020-01-05T10:00").alias("event_date"), F.when(k % 7 > 0, t(k % 90)).otherwise("").alias("lat"), t(-k % 180).alias("lng"), t(k * 1000).alias("accuracy"), F.when(k % 5 > 0, "US").otherwise("CA").alias("country"), F.concat(F.lit("NATION_"), t(k % 30)).alias("genus"))
    return payloads.bulk_rows(scan, views.genera(s, d)).select("id", "taxon_id", "lat", "positional_accuracy", "obscured")


@query("obscured_heuristic", "SELECT id, CASE WHEN positional_accuracy BETWEEN 26000 AND 31000 THEN true END AS obscured FROM oobs", "oobs")
def _(s, d):
    return views.order_observations(s, d).select("id", text.obscured_by_accuracy("positional_accuracy", *OBSCURED_ACCURACY).alias("obscured"))


#: Character references that the tables' pages and the ones added here hold: fixed values. `&amp;`, which
#: also counts without its end, must come last.
REFERENCES = {"&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&hellip;": "…", "&eacute;": "é", "&uuml;": "ü", "&#8217;": "’", "&#x27;": "'", "&#39;": "'", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}


def _replaced(x: str) -> str:
    for k, v in REFERENCES.items():
        x = f"replace({x}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')" if k != "&amp;" else f"regexp_replace({x}, '&amp;?', '&', 'g')"
    return x


ADDED = "'<p>caf&eacute;&#8217;s &uuml;ber&#x27;s&nbsp; &amp;lt; <br>'||page_id||'</p>'"


@query("clean_html", "SELECT page_id, nullif(trim(regexp_replace(replace(" + _replaced(f"regexp_replace(html||{ADDED}, '<[^>]+>', ' ', 'g')") + ", chr(160), ' '), '\\s+', ' ', 'g')),'') AS text FROM pages")
def _(s, d):
    page = F.concat(F.col("html"), F.lit("<p>caf&eacute;&#8217;s &uuml;ber&#x27;s&nbsp; &amp;lt; <br>"), F.col("page_id").cast("string"), F.lit("</p>"))
    return views.table(s, d, "pages").select("page_id", text.clean_html(page).alias("text"))


FEE = "CASE p_partkey%16 WHEN 0 THEN 'No Fee here' WHEN 1 THEN '$0.50 a night' WHEN 2 THEN '$20' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'no' WHEN 6 THEN 'Smoke-free area, $20 per night. Tax: none' WHEN 7 THEN 'Free of charge' WHEN 8 THEN 'FEE: NONE' WHEN 9 THEN 'no charge in winter' WHEN 10 THEN 'free' WHEN 11 THEN ' No ' WHEN 12 THEN 'toll-free number' WHEN 13 THEN 'yes' WHEN 14 THEN '  ' ELSE 'No cost' END"


def _fees(s, d: str) -> DataFrame:
    return views.table(s, d, "part").select("p_partkey", F.expr(FEE).alias("fee"))


@query("free_from_fee", f"SELECT p_partkey, CASE WHEN regexp_matches(lower(fee), 'no fee|no charge|free of charge|fee: none|\\$0|\\$0\\.00') THEN true END AS free FROM (SELECT p_partkey, {FEE} AS fee FROM part)")
def _(s, d):
    return _fees(s, d).select("p_partkey", text.free_from_fee("fee").alias("free"))


@query("fee_tag", f"SELECT p_partkey, CASE WHEN lower(trim(fee))='no' THEN true END AS free, CASE WHEN trim(fee)<>'' AND lower(trim(fee))<>'no' THEN 'fee required' END AS fee FROM (SELECT p_partkey, {FEE} AS fee FROM part)")
def _(s, d):
    return _fees(s, d).select("p_partkey", text.fee_tag("fee").alias("t")).select("p_partkey", "t.free", "t.fee")


@query("parse_coords", "SELECT c_custkey, CASE WHEN ok THEN (c_custkey%100)::DOUBLE END AS lat, CASE WHEN ok THEN (-(c_custkey%170))::DOUBLE END AS lng FROM (SELECT c_custkey, c_custkey%4>0 AND c_custkey%100<=90 AS ok FROM customer)")
def _(s, d):
    k = F.col("c_custkey")
    sign = F.when(k % 4 == 1, F.lit(" , ")).when(k % 4 == 2, F.lit(",")).when(k % 4 == 3, F.lit("   ")).otherwise(F.lit(";"))
    raw = F.concat((k % 100).cast("string"), sign, (-(k % 170)).cast("string"), F.lit(" "))
    return views.table(s, d, "customer").select("c_custkey", text.parse_coordinates(raw).alias("p")).select("c_custkey", "p.lat", "p.lng")


PLACES = ["national_park", "protected_area", "forest", "state_forest", "nature_reserve", "city", "town", "village", "hamlet", "county"]


@query("notable_place", "SELECT c_custkey, (SELECT min_by(k||c_custkey, n) FROM (VALUES " + ",".join(f"({n},'{k}')" for n, k in enumerate(PLACES)) + ") x(n,k) WHERE (c_custkey>>n)%2=1 AND (c_custkey+n)%5>0) AS place FROM customer")
def _(s, d):
    k = F.col("c_custkey").cast("int")
    # in the map's order the least telling come first; some are there but empty
    address = F.map_from_entries(F.filter(F.array(*[F.when(F.shiftright(k, n) % 2 == 1, F.struct(F.lit(p), F.when((k + n) % 5 > 0, F.concat(F.lit(p), k.cast("string"))).otherwise(""))) for n, p in reversed(list(enumerate(PLACES)))]), lambda e: e.isNotNull()))
    return views.table(s, d, "customer").select("c_custkey", text.notable_place(address).alias("place"))


OBSERVED = "named_struct('id', o_orderkey, 'geojson', CASE WHEN o_orderkey%3=0 THEN named_struct('coordinates', array(-120.5D, 45.25D)) END, 'location', CASE o_orderkey%3 WHEN 1 THEN '46.5,-121.5' END, 'observed_on', CASE WHEN o_orderkey%7>0 THEN concat(date_format(o_orderdate,'yyyy-MM-dd'),'T10:00') ELSE 'bad' END, 'quality_grade', 'research', 'taxon', named_struct('id', o_custkey%25, 'rank', CASE WHEN o_orderkey%4=0 THEN 'genus' ELSE 'species' END, 'iconic_taxon_id', CASE WHEN o_orderkey%5>0 THEN 47170 ELSE 1 END, 'ancestor_ids', array(24, (o_orderkey*7)%30, (o_orderkey*3)%25)))"
INGESTED = "SELECT o_orderkey AS id, CASE WHEN o_orderkey%4=0 THEN o_custkey%25 ELSE (SELECT min_by(g.taxon_id,p) FROM genera g JOIN (VALUES (0,24::BIGINT),(1,(o_orderkey*7)%30),(2,(o_orderkey*3)%25)) x(p,anc) ON g.taxon_id=anc) END AS taxon_id, CASE WHEN o_orderkey%3=0 THEN 45.25::DOUBLE ELSE 46.5::DOUBLE END AS lat, CASE WHEN o_orderkey%3=0 THEN -120.5::DOUBLE ELSE -121.5::DOUBLE END AS lng, o_orderdate::DATE AS observed_on, month(o_orderdate)::SMALLINT AS month FROM orders WHERE o_orderkey%3<2 AND o_orderkey%7>0 AND o_orderkey%5>0"


def _payloads(s, d: str) -> DataFrame:
    given = views.table(s, d, "orders").select(F.to_json(F.expr(OBSERVED)).alias("json"))
    return payloads.parsed(given, "json", payloads.OBSERVATION).select(F.struct("*").alias("o"))


@query("ingest_observations", f"SELECT * FROM ({INGESTED}) WHERE taxon_id IS NOT NULL", "genera")
def _(s, d):
    return payloads.observation_rows(_payloads(s, d), views.genera(s, d)).select("id", "taxon_id", "lat", "lng", "observed_on", "month")


@query("ingest_tallies", f"SELECT (SELECT count(*) FROM orders) AS scanned, count(*) AS stored, count(DISTINCT taxon_id) AS genera FROM ({INGESTED}) WHERE taxon_id IS NOT NULL", "genera")
def _(s, d):
    return payloads.ingest_tallies(payloads.classified(_payloads(s, d), views.genera(s, d)))


@query("ingest_counts", "SELECT fate, CASE WHEN fate<>'no genus' THEN genus END AS taxon_id, count(*) AS n FROM (SELECT genus, CASE WHEN genus IS NULL THEN 'no genus' WHEN o_orderkey%3=2 OR o_orderkey%7=0 THEN 'no place or day' ELSE 'stored' END AS fate FROM (SELECT o_orderkey, CASE WHEN o_orderkey%5=0 THEN NULL WHEN o_orderkey%4=0 THEN o_custkey%25 ELSE (SELECT min_by(g.taxon_id,p) FROM genera g JOIN (VALUES (0,24::BIGINT),(1,(o_orderkey*7)%30),(2,(o_orderkey*3)%25)) x(p,anc) ON g.taxon_id=anc) END AS genus FROM orders)) GROUP BY 1,2", "genera")
def _(s, d):
    return payloads.ingest_counts(payloads.classified(_payloads(s, d), views.genera(s, d)))


#: Two runs whose windows overlap by a week; the second finds other grades, and moved rows of one genus rank.
FIRST_END, SECOND_END, HOME = dt.date(1999, 6, 30), dt.date(2001, 12, 31), runs.Area(LAT, LNG, 80.0)
HOME_KM = hav(LAT_SQL, LNG_SQL, "lat", "lng")
RUNS = f"""r1 AS (SELECT * FROM ({INGESTED}) WHERE taxon_id IS NOT NULL AND observed_on BETWEEN DATE '1996-01-01' AND DATE '1999-06-30' AND {HOME_KM}<=80),
r2 AS (SELECT * FROM ({INGESTED}) WHERE taxon_id IS NOT NULL AND observed_on BETWEEN DATE '1999-06-23' AND DATE '2001-12-31' AND {HOME_KM}<=80)"""


def _scratch(s, name: str) -> str:
    return f"{versions.shared_dir(s)}/sylvan-runs/{name}-{uuid.uuid4().hex}"


def _two_runs(s, d: str) -> str:
    root, genera, given = _scratch(s, "ingest"), views.genera(s, d), _payloads(s, d)
    later = given.select(F.col("o").withField("quality_grade", F.lit("casual")).withField("uri", F.concat(F.lit("u"), F.col("o.id").cast("string"))).alias("o"))
    for rows, end, at in ((given, FIRST_END, "1999-07-01"), (later, SECOND_END, "2002-01-01")):
        runs.ingest(s, root, rows, genera, HOME, dt.date(1996, 1, 1), end, at)
    return root


@query("ingest_two_runs", "SELECT coalesce(r2.id, r1.id) AS id, coalesce(r2.taxon_id, r1.taxon_id) AS taxon_id, coalesce(r2.observed_on, r1.observed_on) AS observed_on, CASE WHEN r2.id IS NULL THEN 'research' ELSE 'casual' END AS quality_grade, CASE WHEN r2.id IS NOT NULL THEN 'u'||r2.id END AS uri FROM r1 FULL JOIN r2 ON r1.id=r2.id", "genera", RUNS)
def _(s, d):
    return runs.tables(s, _two_runs(s, d))[0].select("id", "taxon_id", "observed_on", "quality_grade", "uri")


@query("ingest_two_runs_log", "SELECT 'obs:fungi:46.0:-121.0:80.0:1996-01-01:1999-06-30' AS key, TIMESTAMP '1999-07-01' AS fetched_at, count(*) AS row_count FROM r1 UNION ALL SELECT 'obs:fungi:46.0:-121.0:80.0:1999-06-23:2001-12-31', TIMESTAMP '2002-01-01', count(*) FROM r2", "genera", RUNS)
def _(s, d):
    return runs.tables(s, _two_runs(s, d))[1].select("key", "fetched_at", "row_count")


def _resynced(s, d: str, size: int, batches: int) -> tuple[str, list]:
    """The stored observations after some batches, against JSON in which every tenth is gone."""
    root, k = _scratch(s, "resync"), F.col("o.id")
    rows = views.order_observations(s, d).withColumn("revalidated_at", F.col("revalidated_at").cast("timestamp")).withColumn("month", F.col("month").cast("short"))
    runs.commit(s, versions.new_version(root), rows, s.createDataFrame([], INGEST_LOG))
    return root, runs.resync_until_done(s, root, _payloads(s, d).where(k % 10 != 3), views.genera(s, d), size, AS_OF, batches)


RESYNC = f"asked AS (SELECT * FROM oobs ORDER BY revalidated_at NULLS FIRST, id LIMIT 4000), live AS (SELECT * FROM ({INGESTED}) WHERE taxon_id IS NOT NULL AND id%10<>3)"


@query("resync_two_batches", f"SELECT o.id, coalesce(l.taxon_id, o.taxon_id) AS taxon_id, coalesce(l.lat, o.lat) AS lat, coalesce(l.observed_on, o.observed_on) AS observed_on, CASE WHEN l.id IS NULL THEN o.revalidated_at ELSE DATE '{AS_OF}' END AS revalidated_at FROM oobs o LEFT JOIN (SELECT * FROM live WHERE id IN (SELECT id FROM asked)) l ON o.id=l.id WHERE l.id IS NOT NULL OR o.id NOT IN (SELECT id FROM asked)", "oobs genera", RESYNC)
def _(s, d):
    root, _ = _resynced(s, d, 2000, 2)
    return runs.tables(s, root)[0].select("id", "taxon_id", "lat", "observed_on", F.col("revalidated_at").cast("date").alias("revalidated_at"))


@query("resync_counts", "SELECT count(*) AS checked, count(*) FILTER (WHERE l.id IS NULL) AS purged, count(*) FILTER (WHERE l.taxon_id<>a.taxon_id) AS reassigned FROM asked a LEFT JOIN live l ON a.id=l.id", "oobs genera", RESYNC)
def _(s, d):
    _, done = _resynced(s, d, 2000, 2)
    return s.createDataFrame([tuple(sum(getattr(b, c) for b in done) for c in ("checked", "purged", "reassigned"))], "checked long, purged long, reassigned long")


def _landed(s, d: str) -> DataFrame:
    """Pages of 200 orders, ten a query; some are no JSON, some were never landed."""
    k = F.col("o_orderkey")
    rows = views.table(s, d, "orders").select(F.floor(k / 2000).alias("query"), F.floor(k % 2000 / 200).cast("int").alias("page"), F.struct(k.alias("id")).alias("item"))
    rows = rows.groupBy("query", "page").agg(F.to_json(F.struct(F.collect_list("item").alias("results"))).alias("json"))  # 200 each
    return rows.where("NOT (query % 5 = 2 AND page = 6)").withColumn("json", F.when(F.expr("query % 3 = 1 AND page = 4"), "busy").otherwise(F.col("json")))


PAGES = """counted AS (SELECT o_orderkey//2000 AS query, o_orderkey%2000//200 AS page, count(*) AS n FROM orders GROUP BY ALL),
landed AS (SELECT *, query%3=1 AND page=4 AS bad FROM counted WHERE NOT (query%5=2 AND page=6)),
stops AS (SELECT query, min(page) AS stop FROM landed l WHERE bad OR n<200 OR NOT EXISTS (SELECT 1 FROM landed m WHERE m.query=l.query AND m.page=l.page+1) GROUP BY 1)"""


@query("page_report", "SELECT s.query, CASE WHEN bool_or(l.page=stop AND bad) THEN 'failed' WHEN bool_or(l.page=stop AND n<200) THEN 'complete' ELSE 'cut' END AS state, count(*) FILTER (WHERE l.page<=stop AND NOT bad) AS pages, coalesce(sum(n) FILTER (WHERE l.page<=stop AND NOT bad),0)::BIGINT AS items FROM stops s JOIN landed l USING (query) GROUP BY s.query", more=PAGES)
def _(s, d):
    return paging.report(_landed(s, d), paging.SOURCES["observations"], ["query"])


@query("paged_observations", "SELECT o_orderkey AS id, query, page::INT AS page FROM orders JOIN stops ON query=o_orderkey//2000 JOIN landed USING (query) WHERE page=o_orderkey%2000//200 AND page<=stop AND NOT bad", more=PAGES)
def _(s, d):
    return paging.paged(_landed(s, d), paging.SOURCES["observations"], ["query"]).select("query", "page", F.explode("results.id").alias("id"))


def _tiled(s, d: str) -> tuple[DataFrame, DataFrame]:
    """Trails and log after the tiles of each land unit, in which two ways lie, one of them in all tiles."""
    regions = views.land(s, d).select(F.col("id").cast("long").alias("place"), "min_lat", "min_lng", "max_lat", "max_lng")
    log = regions.where("place % 6 = 0").select(F.concat(F.lit("trails:place:"), F.col("place").cast("string")).alias("key"), F.lit("2001-01-01").cast("timestamp").alias("fetched_at"), F.lit(1).cast("long").alias("row_count"), *[F.lit(None).cast("double").alias(c) for c in ("lat", "lng", "radius_km")])
    way = "named_struct('type', 'way', 'id', {0}, 'geometry', array(named_struct('lat', double(tile), 'lon', 1D), named_struct('lat', double(tile), 'lon', 2D)))"
    tile = regions.select("place", F.posexplode(geo.tiles("min_lat", "min_lng", "max_lat", "max_lng", 0.25)).alias("tile", "t"))
    text_of = F.to_json(F.expr(f"named_struct('elements', array({way.format('place')}, {way.format('1000000 + place * 100 + tile')}))"))
    given = tile.where("NOT (place % 10 = 7 AND tile = 0)").select("place", "tile", F.when(F.expr("place % 10 = 3 AND tile = 0"), "busy").otherwise(text_of).alias("json"))
    return layers.ingest_trails(s.createDataFrame([], schemas.TRAILS), log, regions, given, AS_OF, 0.25)


TILED = "tiled AS (SELECT id::BIGINT AS place, unnest(range((ceil(size/0.25)*ceil(size/0.25))::INT)) AS tile FROM land WHERE id::BIGINT%6>0), came AS (SELECT * FROM tiled WHERE NOT (place%10 IN (3,7) AND tile=0))"


@query("layer_trails", "SELECT 'osm:way/'||place AS id, max(tile)::DOUBLE AS center_lat FROM came GROUP BY place UNION ALL SELECT 'osm:way/'||(1000000+place*100+tile), tile::DOUBLE FROM came", "land", TILED)
def _(s, d):
    return _tiled(s, d)[0].select("id", "center_lat")


@query("layer_trails_log", "SELECT 'trails:place:'||id AS key, 1::BIGINT AS row_count FROM land WHERE id::BIGINT%6=0 UNION ALL SELECT 'trails:place:'||place, 2*count(*) FROM came WHERE place%10 NOT IN (3,7) GROUP BY place", "land", TILED)
def _(s, d):
    return _tiled(s, d)[1].select("key", "row_count")


def _circled(s, d: str) -> tuple[DataFrame, DataFrame]:
    """Sites and log after nine circles around each camp, which give it and a far one; some circles never came."""
    camps = views.camps(s, d).select(F.col("id").cast("long").alias("area"), "lat", "lng", F.lit(30.0).alias("radius_km"))
    log = camps.where("area % 5 = 0").select(F.concat(F.lit("camps:ridb:"), F.col("area").cast("string")).alias("key"), F.lit("2001-01-01").cast("timestamp").alias("fetched_at"), F.lit(1).cast("long").alias("row_count"), "lat", "lng", F.lit(60.0).alias("radius_km"))
    site = "named_struct('FacilityID', string(area + {0}), 'FacilityName', concat('c', circle), 'FacilityLatitude', lat + {1}, 'FacilityLongitude', lng)"
    text_of = F.to_json(F.expr(f"named_struct('RECDATA', array({site.format(0, '0D')}, {site.format(1000000, '1D')}))"))
    given = camps.select("*", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("circle")).where("NOT (area % 7 = 0 AND circle = 4)").select("area", "circle", F.lit(0).alias("page"), text_of.alias("json"))
    return layers.ingest_campgrounds(s.createDataFrame([], schemas.CAMPSITES), log, camps, given, AS_OF, 30.0)


FREE = f"open AS (SELECT * FROM camps c WHERE NOT EXISTS (SELECT 1 FROM camps l WHERE l.id::BIGINT%5=0 AND {hav('c.lat', 'c.lng', 'l.lat', 'l.lng')}+30<=60))"


@query("layer_camps", "SELECT 'ridb:'||id AS id, 'c8' AS name, lat, lng FROM open", "camps", FREE)
def _(s, d):
    return _circled(s, d)[0].select("id", "name", "lat", "lng")


@query("layer_camps_log", "SELECT lat, lng, 60.0::DOUBLE AS radius_km, 1::BIGINT AS row_count FROM camps WHERE id::BIGINT%5=0 UNION ALL SELECT lat, lng, 30.0::DOUBLE, 1 FROM open WHERE id::BIGINT%7>0", "camps", FREE)
def _(s, d):
    return _circled(s, d)[1].select("lat", "lng", "radius_km", "row_count")


@query("genus_catalogue", "SELECT n_nationkey::BIGINT AS taxon_id, n_name AS name, CASE WHEN n_nationkey%2=0 THEN 'c'||n_nationkey END AS common_name, (n_nationkey*3)::INT AS observations_count FROM nation WHERE n_nationkey%3>0 AND n_nationkey%4>0")
def _(s, d):
    row = "named_struct('id', n_nationkey, 'name', n_name, 'rank', CASE WHEN n_nationkey%3>0 THEN 'genus' ELSE 'species' END, 'preferred_common_name', CASE WHEN n_nationkey%2=0 THEN concat('c', n_nationkey) END, 'observations_count', n_nationkey*3, 'ancestor_ids', CASE WHEN n_nationkey%4>0 THEN array(1, 47170, n_nationkey) ELSE array(1) END)"
    given = views.table(s, d, "nation").select(F.to_json(F.expr(row)).alias("json"))
    return payloads.genus_catalogue(payloads.parsed(given, "json", payloads.TAXA))


@query("campground_rows", f"SELECT 'ridb:'||p_partkey AS id, CASE WHEN p_partkey%3>0 THEN p_name ELSE 'Facility '||p_partkey END AS name, 'campground' AS kind, nullif(trim(fee),'') AS fee, CASE WHEN regexp_matches(lower(fee), 'no fee|no charge|free of charge|fee: none|\\$0') THEN true END AS free, (p_partkey%90)::DOUBLE AS lat, (p_partkey%4)::DOUBLE AS lng, 'https://www.recreation.gov/camping/campgrounds/'||p_partkey AS url FROM (SELECT *, {FEE} AS fee FROM part) WHERE p_partkey%11>0 AND NOT (p_partkey%90=0 AND p_partkey%4=0)")
def _(s, d):
    row = f"named_struct('RECDATA', array(named_struct('FacilityID', string(p_partkey), 'FacilityName', CASE WHEN p_partkey%3>0 THEN p_name ELSE '' END, 'FacilityLatitude', CASE WHEN p_partkey%11>0 THEN double(p_partkey%90) END, 'FacilityLongitude', double(p_partkey%4), 'FacilityUseFeeDescription', concat('<b>', {FEE}, '</b>'))))"
    given = views.table(s, d, "part").select(F.to_json(F.expr(row)).alias("json"))
    return payloads.campgrounds(payloads.parsed(given, "json", payloads.CAMPGROUNDS)).drop("source")


TYPED = "CASE k%3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END"


@query("reported_sites", f"SELECT 'osm:'||kind||'/'||k AS id, CASE WHEN k%5=0 THEN s_name WHEN k%7=0 THEN 'Backcountry campsite (OSM)' WHEN k%11=0 THEN 'Camp pitch (OSM)' ELSE 'Campsite (OSM)' END AS name, CASE WHEN k%4=0 THEN true END AS free, CASE WHEN k%4=1 THEN 'fee required' END AS fee, (k%50)::DOUBLE AS lat, (k%60)::DOUBLE AS lng, 'https://www.openstreetmap.org/'||kind||'/'||k AS url FROM (SELECT s_suppkey AS k, s_name, {TYPED} AS kind FROM (SELECT *, s_suppkey AS k FROM supplier)) WHERE k%13>0")
def _(s, d):
    tags = "map_filter(map('name', CASE WHEN k%5=0 THEN s_name END, 'backcountry', CASE WHEN k%7=0 THEN 'yes' END, 'tourism', CASE WHEN k%11=0 THEN 'camp_pitch' END, 'fee', CASE k%4 WHEN 0 THEN ' No' WHEN 1 THEN '$5' WHEN 2 THEN ' ' END), (a, b) -> b IS NOT NULL)"
    row = f"named_struct('elements', array(named_struct('type', {TYPED}, 'id', k, 'lat', CASE WHEN k%3=0 AND k%13>0 THEN double(k%50) END, 'lon', CASE WHEN k%3=0 THEN double(k%60) END, 'center', CASE WHEN k%3>0 AND k%13>0 THEN named_struct('lat', double(k%50), 'lon', double(k%60)) END, 'tags', {tags})))"
    given = views.table(s, d, "supplier").withColumnRenamed("s_suppkey", "k").select(F.to_json(F.expr(row)).alias("json"))
    return payloads.reported_sites(payloads.parsed(given, "json", payloads.ELEMENTS)).select("id", "name", "free", "fee", "lat", "lng", "url")


@query("trail_rows", f"""SELECT 'osm:'||kind||'/'||k AS id, CASE WHEN k%5=0 THEN p_name WHEN k%4=0 AND k%3>0 THEN 'R'||k WHEN k%3=0 THEN 'Trailhead (OSM)' WHEN k%3=1 THEN 'Trail (OSM)' ELSE 'Hiking route (OSM)' END AS name, CASE k%3 WHEN 0 THEN 'trailhead' WHEN 1 THEN 'path' ELSE 'route' END AS kind,
CASE k%3 WHEN 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS min_lat, CASE k%3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN p_size/8.0::DOUBLE ELSE 3.0::DOUBLE END AS max_lat, CASE k%3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN round_even(least(p_size+1,60)//2*(CASE WHEN p_size+1>60 THEN p_size/59.0::DOUBLE ELSE 1.0::DOUBLE END),0)/8 ELSE 2.0::DOUBLE END AS center_lat,
CASE k%3 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'MultiLineString' END AS shape FROM (SELECT p_partkey AS k, p_name, p_size*3 AS p_size, {TYPED} AS kind FROM (SELECT *, p_partkey AS k FROM part))""")
def _(s, d):
    line = "transform(sequence(0, p_size*3), i -> named_struct('lat', i/8D, 'lon', 2D))"
    members = "array(named_struct('type', 'way', 'geometry', array(named_struct('lat', 0D, 'lon', 1D), named_struct('lat', 1D, 'lon', 1D))), named_struct('type', 'node', 'geometry', null), named_struct('type', 'way', 'geometry', array(named_struct('lat', 2D, 'lon', 1D), named_struct('lat', 3D, 'lon', 1D))))"
    tags = "map_filter(map('name', CASE WHEN k%5=0 THEN p_name END, 'ref', CASE WHEN k%4=0 THEN concat('R', k) END), (a, b) -> b IS NOT NULL)"
    row = f"named_struct('elements', array(named_struct('type', {TYPED}, 'id', k, 'lat', CASE WHEN k%3=0 THEN 1.5D END, 'lon', CASE WHEN k%3=0 THEN 2.5D END, 'tags', {tags}, 'geometry', CASE WHEN k%3=1 THEN {line} END, 'members', CASE WHEN k%3=2 THEN {members} END)))"
    given = views.table(s, d, "part").withColumnRenamed("p_partkey", "k").select(F.to_json(F.expr(row)).alias("json"))
    rows = payloads.trail_rows(payloads.parsed(given, "json", payloads.ELEMENTS))
    return rows.select("id", "name", "kind", "min_lat", "max_lat", "center_lat", F.get_json_object("geojson", "$.type").alias("shape"))


@query("land_rows", """SELECT 'usfs:'||c_custkey AS id, 'USFS' AS agency, CASE WHEN c_custkey%3=0 THEN 'National Forest' ELSE c_name END AS unit, c_custkey%50-0.5::DOUBLE AS min_lat, (0-c_custkey%100)::DOUBLE AS min_lng, CASE c_custkey%4 WHEN 0 THEN c_custkey%50-0.5::DOUBLE ELSE c_custkey%50+2.0::DOUBLE END AS max_lat, CASE c_custkey%4 WHEN 0 THEN (0-c_custkey%100)::DOUBLE ELSE 1.0-c_custkey%100 END AS max_lng FROM customer WHERE c_custkey%7>0""")
def _(s, d):
    # a point, a line with heights, a polygon and a multipolygon
    a, b = "concat('[', -(k%100), ',', k%50-0.5, '{0}]')", "concat('[', 1-k%100, ',', k%50+2, '{0}]')"
    shapes = [("Point", a.format(",100")), ("LineString", f"concat('[', {a.format(',100')}, ',', {b.format(',9e3')}, ']')"), ("Polygon", f"concat('[[', {a.format('')}, ',', {b.format('')}, ']]')"), ("MultiPolygon", f"concat('[[[', {b.format('')}, ']],[[', {a.format(',7')}, ']]]')")]
    pick = lambda i: "CASE k%4 " + " ".join(f"WHEN {n} THEN {x if i else repr(t)}" for n, (t, x) in enumerate(shapes)) + " END"
    props = "concat('{\"objectid\":', CASE WHEN k%7>0 THEN string(k) ELSE 'null' END, ',\"forestname\":\"', CASE WHEN k%3=0 THEN '' ELSE concat(' ', c_name, ' ') END, '\"}')"
    text_of = F.expr(f"concat('{{\"features\":[{{\"properties\":', {props}, ',\"geometry\":{{\"type\":\"', {pick(0)}, '\",\"coordinates\":', {pick(1)}, '}}}}]}}')")
    given = views.table(s, d, "customer").withColumnRenamed("c_custkey", "k").select(text_of.alias("json"))
    return payloads.land_rows(payloads.parsed(given, "json", payloads.FEATURES), "usfs").drop("geojson", "source", "url")


BULK_TEXT = "SELECT p_partkey::BIGINT AS id, g.taxon_id, (p_partkey%90)::DOUBLE AS lat, DATE '2020-01-05' AS observed_on FROM part JOIN (SELECT name, min(taxon_id) AS taxon_id FROM genera GROUP BY 1) g ON g.name='NATION_'||(p_partkey%30) WHERE p_partkey%5>0 AND p_partkey%7>0 AND p_partkey%6>0"


def _bulk_lines(s, d: str, quoted: str) -> DataFrame:
    k = F.col("p_partkey")
    t = lambda c: c.cast("string")
    values = {0: t(k), 16: F.lit("2020-01-05T10:00"), 20: F.when(k % 7 > 0, t(k % 90)).otherwise(""), 21: t(-k % 180), 22: t(k % 40000), 24: F.when(k % 5 > 0, "US").otherwise("CA"), 29: F.lit(f'"{quoted}"'), 37: F.concat(F.lit("NATION_"), t(k % 30))}
    line = F.concat_ws(",", *[values.get(n, F.lit("")) for n in range(38)])
    return views.table(s, d, "part").select(F.when(k % 6 > 0, line).otherwise(F.concat(t(k), F.lit(",short"))).alias("line"))


@query("bulk_scan_text", BULK_TEXT, "genera")
def _(s, d):
    return payloads.bulk_rows(payloads.bulk_lines(_bulk_lines(s, d, "a, b"), "line", 38), views.genera(s, d)).select("id", "taxon_id", "lat", "observed_on")


@query("bulk_scan_zip", BULK_TEXT, "genera")
def _(s, d):
    archive.register(s)
    path = _scratch(s, "zip")
    _bulk_lines(s, d, "two\nlines, one record").write.format("zippedcsv").mode("append").option("headerLine", "h").save(path)
    lines = s.read.format("zippedcsv").load(path)
    return payloads.bulk_rows(payloads.bulk_lines(lines, "line", 38), views.genera(s, d)).select("id", "taxon_id", "lat", "observed_on")


LINES = "SELECT p_partkey::BIGINT AS id, (p_partkey%25)::BIGINT AS taxon_id, CASE WHEN p_partkey%3>0 THEN (p_partkey*10)%40000 END::INT AS positional_accuracy, DATE '2020-01-01'+(p_partkey%300)::INT AS observed_on FROM part WHERE p_partkey%9>0"


def _loaded(s, d: str) -> DataFrame:
    row = "named_struct('inat_id', p_partkey, 'taxon_id', p_partkey%25, 'lat', 1.5D, 'lng', 2.5D, 'coordinate_uncertainty_m', CASE WHEN p_partkey%3>0 THEN concat((p_partkey*10)%40000, '.7') END, 'event_date', CASE WHEN p_partkey%9>0 THEN concat(date_add(DATE'2020-01-01', int(p_partkey%300)), 'T1') END)"
    given = views.table(s, d, "part").select(F.to_json(F.expr(row)).alias("json"))
    return payloads.load_bulk(payloads.parsed(given, "json", payloads.BULK_LINE), "obs/")


@query("load_bulk", f"SELECT id, taxon_id, positional_accuracy, observed_on, month(observed_on)::SMALLINT AS month, 'obs/'||id AS uri, CASE WHEN positional_accuracy BETWEEN 26000 AND 31000 THEN true END AS obscured FROM ({LINES})")
def _(s, d):
    return _loaded(s, d).select("id", "taxon_id", "positional_accuracy", "observed_on", "month", "uri", "obscured")


@query("bulk_tallies", f"SELECT taxon_id, count(*) AS loaded, max(observed_on) AS last_day, max(max(observed_on)) OVER () AS end_date FROM ({LINES}) GROUP BY 1")
def _(s, d):
    return payloads.bulk_tallies(_loaded(s, d))


@query("last_row_wins", "SELECT l_orderkey AS id, max_by(l_quantity, l_extendedprice*100000+l_linenumber*100+l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY 1")
def _(s, d):
    rows = views.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_extendedprice") * 100000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).alias("seq"))
    return payloads.dedupe_last(rows, "id", "seq")


@query("trailhead_nodes", "SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN p_partkey::BIGINT END AS node FROM part")
def _(s, d):
    k = F.col("p_partkey")
    trail = F.concat(F.when(k % 3 == 0, "osm:node/").when(k % 3 == 1, "osm:way/").otherwise("osm:node/x"), k.cast("string"))
    return views.table(s, d, "part").select("p_partkey", text.node_id(trail).alias("node"))


@query("species_counts", "SELECT taxon_id, count(*) AS cnt FROM lobs GROUP BY 1", "lobs")
def _(s, d):
    return phenology.species_counts(views.line_observations(s, d))


@query("monthly_histogram", "SELECT month, count(*) AS cnt FROM lobs GROUP BY 1", "lobs")
def _(s, d):
    return phenology.monthly_histogram(views.line_observations(s, d))


@query("keyset_page", "SELECT id, taxon_id, observed_on FROM oobs WHERE id>1000 ORDER BY id LIMIT 200", "oobs")
def _(s, d):
    return views.order_observations(s, d).where("id > 1000").orderBy("id").limit(200).select("id", "taxon_id", "observed_on")


@query("fetch_by_ids", "SELECT id, taxon_id FROM oobs WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity>45)", "oobs")
def _(s, d):
    ids = views.table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return views.order_observations(s, d).join(ids, "id", "left_semi").select("id", "taxon_id")


@query("ingest_window", "SELECT place, greatest(DATE '2024-01-10', latest::DATE - 7) AS start FROM (SELECT split_part(key,':',4) AS place, max(split_part(key,':',6)) AS latest FROM log WHERE starts_with(key,'obs:fungi:place:') GROUP BY 1)", "log")
def _(s, d):
    rows = coverage.latest_by_place(views.ingest_log(s, d))
    return rows.select("place", coverage.window_start(F.lit("2024-01-10").cast("date"), text.lenient_date("latest")).alias("start"))


SEASONAL = ["taxon_id", "lat", "lng", "observed_on", "month", "quality_grade", "obscured"]
REJECTED = "(SELECT l_orderkey FROM lineitem WHERE l_returnflag='R' AND l_linenumber=1)"
FOLLOWED = f"""news AS (SELECT id//2 AS id, id AS seq, CASE WHEN id%5>0 THEN taxon_id END AS taxon_id, lat, lng, CASE WHEN id%4>0 THEN observed_on END AS observed_on, month, quality_grade, CASE WHEN id%2>0 THEN obscured END AS obscured FROM oobs),
once AS (SELECT coalesce(s.id,b.id) AS id, {', '.join(f'coalesce(b.{c},s.{c}) AS {c}' for c in SEASONAL)} FROM (SELECT * FROM oobs WHERE id%3>0) s FULL JOIN (SELECT id, {', '.join(f'max_by({c},seq) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in SEASONAL)} FROM news GROUP BY 1) b ON s.id=b.id),
binned AS (SELECT *, {REGION} AS region_id FROM once WHERE quality_grade='research' AND id NOT IN {REJECTED})"""


def _followed(s, d: str, compacted: bool) -> str:
    """A state that follows a merge of new values and then one that purges rows, without another full build."""
    root, o, k = _scratch(s, "seasons"), views.order_observations(s, d), F.col("id")
    stored_rows = o.where("id % 3 > 0").select("id", *SEASONAL)
    news = o.select(F.floor(k / 2).cast("long").alias("id"), k.alias("seq"), F.when(k % 5 > 0, F.col("taxon_id")).alias("taxon_id"), "lat", "lng", F.when(k % 4 > 0, F.col("observed_on")).alias("observed_on"), "month", "quality_grade", F.when(k % 2 > 0, F.col("obscured")).alias("obscured"))
    merge.coalesce_merge(stored_rows, news, "id", "seq", SEASONAL).write.parquet(f"{root}/observations")
    merged = s.read.parquet(f"{root}/observations")
    seasons.start(stored_rows, CELL, f"{root}/state")
    seasons.follow(seasons.images(stored_rows, merged, news), CELL, f"{root}/state", 1)
    gone = views.table(s, d, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_orderkey").alias("id"))
    seasons.follow(seasons.images(merged, merge.delete(merged, gone, "id"), gone), CELL, f"{root}/state", 2)
    if compacted:
        seasons.compact(s, f"{root}/state")
    return f"{root}/state"


@query("phenology_after_merges", f"SELECT region_id, taxon_id, month, cnt, {s6('center_lat', 'center_lng')} FROM ({MORE['phen']})", "oobs", FOLLOWED)
def _(s, d):
    return seasons.phenology(s, _followed(s, d, False)).select("region_id", "taxon_id", "month", "cnt", *r6("center_lat", "center_lng"))


@query("regions_after_merges", f"SELECT region_id, round({CENTER.format('lat')},6) AS center_lat, round({CENTER.format('lng')},6) AS center_lng, count(*) AS n_obs, count(DISTINCT taxon_id) AS n_taxa FROM binned GROUP BY 1", "oobs", FOLLOWED)
def _(s, d):
    return seasons.regions(s, _followed(s, d, False)).select("region_id", *r6("center_lat", "center_lng"), "n_obs", "n_taxa")


@query("daily_after_merges", "SELECT region_id, taxon_id, observed_on, count(*) AS cnt FROM binned WHERE observed_on IS NOT NULL GROUP BY ALL", "oobs", FOLLOWED)
def _(s, d):
    return seasons.daily(s, _followed(s, d, True))


@query("phenology_changed_groups", f"SELECT p.region_id, p.taxon_id, p.month, cnt, {s6('center_lat', 'center_lng')} FROM ({MORE['phen']}) p WHERE EXISTS (SELECT 1 FROM once c WHERE quality_grade='research' AND id IN {REJECTED} AND {REGION}=p.region_id AND c.taxon_id IS NOT DISTINCT FROM p.taxon_id AND c.month IS NOT DISTINCT FROM p.month)", "oobs", FOLLOWED)
def _(s, d):
    return seasons.changed_groups(s, _followed(s, d, False), 2).select("region_id", "taxon_id", "month", "cnt", *r6("center_lat", "center_lng"))


@query("region_reach", f"SELECT region_id, count(*) AS n, count(*) FILTER (WHERE {hav('lat', 'lng', 'c_lat', 'c_lng')} <= {CELL*111.0/2}) AS n_within, {CELL*111.0/2}::DOUBLE AS radius_km FROM (SELECT *, split_part(region_id,'_',1)::INT+0.5::DOUBLE AS c_lat, split_part(region_id,'_',2)::INT+0.5::DOUBLE AS c_lng FROM binned) GROUP BY 1", "lobs binned")
def _(s, d):
    rows, (c_lat, c_lng), radius = phenology.binned(views.line_observations(s, d), CELL), geo.region_center("region_id", CELL), geo.region_radius_km(CELL)
    near = geo.haversine_km("lat", "lng", c_lat, c_lng) <= radius
    return rows.groupBy("region_id").agg(F.count("*").alias("n"), F.count_if(near).alias("n_within"), F.lit(radius).alias("radius_km"))


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in _sql.items() if v}

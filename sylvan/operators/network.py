"""The trails that start at trailheads, from the map's own topology: node to ways, ways to hiking routes.

Two bounded steps over an incidence table, each a join on ids, resolve all trailheads at once. Where the map
links a trailhead to no way, the path or route with the nearest vertex is a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell_index, haversine_km, reach, thin
from ..functions.text import first_text, node_id
from ..schemas import KM_PER_DEGREE
from ..sources.payloads import dedupe_last, vertices_of
from .proximity import nearest_site


def _line(geometry) -> Column:
    return F.filter(geometry, lambda v: v["lat"].isNotNull() & v["lon"].isNotNull())


def _tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def elements(pages: DataFrame) -> DataFrame:
    """Ways and relations of landed pages, the last element of a type and id."""
    page = F.col("page") if "page" in pages.columns else F.monotonically_increasing_id()
    e = pages.select(page.alias("page"), F.posexplode("elements").alias("place", "e")).select(F.struct("page", "place").alias("seq"), F.struct("e.type", "e.id").alias("key"), "e.nodes", "e.tags", "e.geometry", "e.members")
    return dedupe_last(e.where("key.type IN ('way', 'relation') AND key.id IS NOT NULL"), "key", "seq").select("key.type", "key.id", "nodes", "tags", "geometry", "members")


def networks(heads: DataFrame, found: DataFrame, most: int = 60) -> DataFrame:
    """For each node of heads that a road or path touches: name, kind and geometry of those ways and of the hiking routes that
    hold them. heads: node. found: elements().

    Lines stand in the order of elements, ways before routes, each by id, and in a route's own order. The name is that of the
    last route with one, else of the first way with one. Ways without a vertex count for nothing.
    """
    roads = found.where((F.col("type") == "way") & _tag("highway").isNotNull())
    touching = roads.select(F.explode(F.array_distinct("nodes")).alias("node"), F.col("id").alias("way"), first_text(_tag("name"), _tag("ref")).alias("name"), _line(F.col("geometry")).alias("line"))
    touching = touching.join(heads.select("node").distinct().hint("merge"), "node")
    routes = found.where((F.col("type") == "relation") & (_tag("route") == "hiking"))
    of_ways = F.transform(F.filter("members", lambda m: (m["type"] == "way") & m["ref"].isNotNull()), lambda m: m["ref"])
    via = touching.select("node", "way").join(routes.select("id", F.explode(F.array_distinct(of_ways)).alias("way")).hint("merge"), "way").select("node", "id").distinct()
    lines = F.filter(F.transform(F.filter("members", lambda m: m["type"] == "way"), lambda m: _line(m["geometry"])), lambda x: F.size(x) > 0)
    whole = routes.select("id", first_text(_tag("name"), _tag("ref")).alias("name"), F.coalesce(F.transform(lines, lambda x: thin(x, most)), F.array().cast("array<array<struct<lat:double,lon:double>>>")).alias("lines"))
    parts = touching.where(F.size("line") > 0).select("node", F.lit(0).alias("rank"), F.col("way").alias("id"), "name", F.array(thin("line", most)).alias("lines"))
    parts = parts.unionByName(via.join(whole.hint("merge"), "id").select("node", F.lit(1).alias("rank"), "id", "name", "lines"))
    one = parts.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "name", "lines"))).alias("parts"))  # the ways and routes of one node
    named = lambda rank: F.filter("parts", lambda p: (p["rank"] == rank) & p["name"].isNotNull())
    route_name, way_name = F.try_element_at(named(1), F.lit(-1))["name"], F.try_element_at(named(0), F.lit(1))["name"]
    kind = F.when(F.exists("parts", lambda p: p["rank"] == 1), "route").otherwise("path")
    one = one.select("node", F.coalesce(route_name, way_name, F.lit("Trail (OSM)")).alias("name"), kind.alias("kind"), F.flatten(F.transform("parts", lambda p: p["lines"])).alias("lines")).where(F.size("lines") > 0)
    pairs = lambda x: F.transform(x, lambda v: F.array(v["lon"], v["lat"]))
    single = F.to_json(F.struct(F.lit("LineString").alias("type"), pairs(F.get("lines", F.lit(0))).alias("coordinates")))
    several = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.transform("lines", pairs).alias("coordinates")))
    return one.select("node", "name", "kind", F.when(F.size("lines") == 1, single).otherwise(several).alias("geojson"))


def _met_in_cells(points: DataFrame, vertices: DataFrame, max_km: float) -> DataFrame:
    """key, km, trail of all pairs within max_km whose extent the point's box touches, by cells as high as max_km."""
    cell = max(max_km / KM_PER_DEGREE, 0.01)
    dlat, dlng = reach("lat", max_km)
    span = lambda x, d: F.explode(F.sequence(cell_index(F.col(x) - d * 1.01, cell), cell_index(F.col(x) + d * 1.01, cell)))
    look = points.select("key", "lat", "lng", span("lat", dlat).alias("i")).withColumn("j", span("lng", dlng))
    own = vertices.withColumn("i", cell_index("v.lat", cell)).withColumn("j", cell_index("v.lng", cell))
    touched = (F.col("min_lat") <= F.col("lat") + dlat) & (F.col("max_lat") >= F.col("lat") - dlat) & (F.col("min_lng") <= F.col("lng") + dlng) & (F.col("max_lng") >= F.col("lng") - dlng)
    hits = look.join(own.hint("merge"), ["i", "j"]).where(touched).withColumn("km", haversine_km("lat", "lng", "v.lat", "v.lng"))
    return hits.where(F.col("km") <= max_km).select("key", "km", "trail")


def nearest_by_vertex(points: DataFrame, trails: DataFrame, max_km: float) -> DataFrame:
    """For each point (key, lat, lng) the path or route whose extent its box touches with the nearest vertex within max_km;
    of equally near ones that with the least id.

    A vertex inside its trail's extent and away from the poles and the date line is in the box of any point within max_km
    (up to 100 km), so of those the nearest site is the answer; the others, and points off the map, are met in cells.

    trails: id, kind, extent and vertices (lat, lng).
    """
    own = trails.where(F.col("kind").isin("path", "route")).select(F.col("id").alias("trail"), "min_lat", "min_lng", "max_lat", "max_lng", F.explode("vertices").alias("v"))
    inside = F.col("v.lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("v.lng").between(F.col("min_lng"), F.col("max_lng"))
    plain = F.coalesce(inside & (F.abs("v.lat") <= 75) & (F.abs("v.lng") <= 180 - max_km / 18), F.lit(False)) if max_km <= 100 else F.lit(False)
    on_map = F.coalesce((F.abs("lat") <= 90) & (F.abs("lng") <= 180), F.lit(False))
    sites = own.where(plain).select(F.col("trail").alias("site"), F.col("v.lat").alias("s_lat"), F.col("v.lng").alias("s_lng"))
    near = nearest_site(points.where(on_map), sites, max_km).where("km IS NOT NULL").select("key", "km", F.col("site").alias("trail"))
    met = near.unionByName(_met_in_cells(points.where(on_map), own.where(~plain), max_km)).unionByName(_met_in_cells(points.where(~on_map), own, max_km))
    return met.groupBy("key").agg(F.min(F.struct("km", "trail")).alias("best")).select("key", F.col("best.trail").alias("trail"), F.col("best.km").alias("km"))


def resolve(asked: DataFrame, trails: DataFrame, found: DataFrame, max_km: float = 2.0) -> DataFrame:
    """For each asked id: its state and the trail to draw.

    state: `network` (the map's own, under the trailhead's id and place), `nearest` (a guess, with all of its own), `none`
    (a trailhead without either), `unknown` (no trailhead of that id). trails: the stored trails; their vertices are read
    from geojson unless there is a column of them.
    """
    trails = trails if "vertices" in trails.columns else trails.withColumn("vertices", vertices_of("geojson"))
    heads = trails.where(F.col("kind") == "trailhead").select("id", "center_lat", "center_lng", node_id("id").alias("node")).where("node IS NOT NULL")
    heads = asked.select(F.col("id").alias("asked")).distinct().join(heads.hint("merge"), F.col("asked") == F.col("id"), "left")
    own = networks(heads.where("node IS NOT NULL").select("node"), found).select(F.col("node").alias("of"), "name", "kind", "geojson")
    both = heads.join(own.hint("merge"), F.col("node") == F.col("of"), "left")
    live = both.where("of IS NOT NULL").select("asked", F.lit("network").alias("state"), "id", "name", "kind", "center_lat", "center_lng", "geojson")
    left = both.where("of IS NULL")
    guess = nearest_by_vertex(left.where("node IS NOT NULL").select(F.col("asked").alias("key"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng")), trails, max_km)
    shape = F.col("geojson") if "geojson" in trails.columns else F.lit(None).cast("string").alias("geojson")
    rows = trails.select("id", "name", "kind", "center_lat", "center_lng", shape)
    state = F.when(F.col("node").isNull(), "unknown").when(F.col("trail").isNull(), "none").otherwise("nearest")
    rest = left.select("asked", "node").join(guess.hint("merge"), F.col("asked") == F.col("key"), "left").join(rows.hint("merge"), F.col("trail") == F.col("id"), "left")
    return live.unionByName(rest.select("asked", state.alias("state"), "id", "name", "kind", "center_lat", "center_lng", "geojson"))

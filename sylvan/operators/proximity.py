"""Searches around a point, and nearest-site joins on grid cells.

A join between two large layers never compares all pairs: bounds on the distances between a cell and a site tell which
sites can be the nearest of a point in the cell, from large cells to small ones, and a point meets only those of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import box_overlaps, cell_index, haversine_km, in_box, reach
from ..schemas import EARTH_KM, KM_PER_DEGREE


def camps_near(camps: DataFrame, lat: float, lng: float, radius_km: float, free_only: bool = False) -> DataFrame:
    rows = camps.where(in_box("lat", "lng", lat, lng, radius_km)).withColumn("exact_km", haversine_km(lat, lng, "lat", "lng")).where(F.col("exact_km") <= radius_km)
    rows = rows.where(F.coalesce("free", F.lit(False))) if free_only else rows
    return rows.withColumn("distance_km", F.round("exact_km", 1))


def first_camps(camps: DataFrame, limit: int) -> DataFrame:
    return camps.orderBy(F.coalesce("free", F.lit(False)).desc(), "exact_km", "id").limit(limit)


def land_near(land: DataFrame, lat: float, lng: float, radius_km: float) -> DataFrame:
    """Units whose extent touches the disk's box; there is no exact cut."""
    return land.where(box_overlaps(lat, lng, radius_km))


def trails_near(trails: DataFrame, lat: float, lng: float, radius_km: float, kind: str | None = None) -> DataFrame:
    rows = trails.where(box_overlaps(lat, lng, radius_km)).withColumn("exact_km", haversine_km(lat, lng, "center_lat", "center_lng")).where(F.col("exact_km") <= radius_km)
    rows = rows.where(F.col("kind") == kind) if kind else rows
    return rows.withColumn("distance_km", F.round("exact_km", 1))


def first_trails(trails: DataFrame, limit: int) -> DataFrame:
    return trails.orderBy("exact_km", "id").limit(limit)


def nearest_vertex(trails: DataFrame, lat: float, lng: float, max_km: float) -> DataFrame:
    """The path or route with the vertex nearest to a point. trails: id, kind, extent and vertices (lat, lng)."""
    rows = trails.where(F.col("kind").isin("path", "route") & box_overlaps(lat, lng, max_km)).select("id", "name", "kind", F.explode("vertices").alias("v"))
    rows = rows.withColumn("km", haversine_km(lat, lng, "v.lat", "v.lng")).where(F.col("km") <= max_km)
    return rows.orderBy("km", "id").limit(1).select("id", "name", "kind", F.round("km", 1).alias("distance_km"))


#: Levels of cells on the unit sphere, from half its radius to about 3 km: the edge of each is a fourth of that of the one above.
LEVELS = 6
LEAST_EDGE = 2.0**-11
#: Slices in which a cell's sites are compared, by level: few cells hold many sites each, so these are not one group.
SLICES = (64, 16, 4, 1, 1, 1)
#: So many levels have cells whose number the sphere bounds (about 25,000), whatever the points.
BOUNDED = 3
#: Kilometres by which bounds on distances may err.
SLACK_KM = 0.001
CELL = ["i", "j", "k"]


def _on_sphere(frame: DataFrame, lat: str, lng: str) -> DataFrame:
    """frame with its point on the unit sphere, which has no poles and no date line."""
    a, b = F.radians(lat), F.radians(lng)
    return frame.withColumns({"x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)})


def in_cells(points: DataFrame) -> DataFrame:
    """points (lat, lng) with their finest cell (i, j, k); nulls without a place."""
    at = _on_sphere(points, "lat", "lng")
    return at.select(*points.columns, *[F.floor(F.col(c) / LEAST_EDGE).cast("int").alias(o) for c, o in zip("xyz", CELL, strict=True)])


def _judged(pairs: DataFrame, level: int, within_km: float | None) -> DataFrame:
    """The pairs of a cell and a site that may be best for some point of the cell."""
    edge = LEAST_EDGE * 4.0 ** (LEVELS - 1 - level)
    off = [F.abs(F.col(c) - (F.col(o) + 0.5) * edge) for c, o in zip("xyz", CELL, strict=True)]
    km = lambda parts: 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0])) / 2))
    rows = pairs.withColumns({"least_km": km([F.greatest(F.lit(0.0), d - edge / 2) for d in off]), "most_km": km([d + edge / 2 for d in off])})
    rows = rows if within_km is None else rows.where(F.col("least_km") <= within_km + SLACK_KM)
    slices = F.pmod(F.xxhash64("x", "y", "z"), F.lit(SLICES[level]))
    best = F.max(F.col("lead") - F.col("most_km")).over(Window.partitionBy(*CELL, slices))
    return rows.withColumn("best", best).where(F.col("lead") - F.col("least_km") >= F.col("best") - SLACK_KM).drop("least_km", "most_km", "best")


def _once_each(frame: DataFrame, *names: str) -> DataFrame:
    """The distinct rows of these columns, as one result for all that reads them: of distinct() in distinct(), Spark keeps
    the outer one alone, and so reads frame again for each level of cells."""
    return frame.groupBy(*names).agg(F.count("*").alias("copies")).where("copies > 0").select(*names)


def candidates(cells: DataFrame, sites: DataFrame, within_km: float | None = None) -> DataFrame:
    """For each of the finest cells (i, j, k): the sites that can have the greatest lead less distance for a point in it.

    sites: s_lat, s_lng, lead (km) and any others, a row for each place. With within_km, farther sites count for nothing.
    Cells of half the sphere's radius meet all sites, and each level hands on to its parts only the sites that no other
    one beats everywhere in the cell. So pairs stay in proportion to cells and sites, and no cell's sites are one group
    while they are many.
    """
    cells = _once_each(cells.where("i IS NOT NULL AND j IS NOT NULL AND k IS NOT NULL"), *CELL)
    cells = cells.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in CELL])  # never null, or each level's join has Spark read others
    up = lambda level, names: [F.shiftright(c, 2 * (LEVELS - 1 - level)).alias(n) for c, n in zip(CELL, names, strict=True)]
    pairs = _on_sphere(sites, "s_lat", "s_lng").where("x IS NOT NULL AND lead IS NOT NULL").crossJoin(F.broadcast(cells.select(*up(0, CELL)).distinct()))
    pairs = _judged(pairs, 0, within_km)
    above = ["above_i", "above_j", "above_k"]
    for level in range(1, LEVELS):
        parts = cells.select(*up(level, CELL)).distinct().select(*CELL, *[F.shiftright(c, 2).alias(n) for c, n in zip(CELL, above, strict=True)])
        parts = F.broadcast(parts) if level < BOUNDED else parts.hint("merge")
        pairs = _judged(pairs.withColumnsRenamed(dict(zip(CELL, above, strict=True))).join(parts, above).drop(*above), level, within_km)
    return pairs.drop("x", "y", "z")


def nearest_site(points: DataFrame, sites: DataFrame, within_km: float | None = None) -> DataFrame:
    """For each point (key, lat, lng and any others): its columns but lat and lng, the nearest site (site, s_lat, s_lng) and
    its distance km, or nulls without a place or sites (with within_km: without sites so near). Of equally near ones, the
    least site. Points of one place are one until the end; those without a place are not shuffled."""
    nowhere, placed = points.where("lat IS NULL OR lng IS NULL"), points.where("lat IS NOT NULL AND lng IS NOT NULL")
    own = in_cells(_once_each(placed, "lat", "lng"))
    there = candidates(own, sites.groupBy("s_lat", "s_lng").agg(F.min("site").alias("site")).withColumn("lead", F.lit(0.0)), within_km)
    pairs = own.join(there.hint("merge"), CELL).select("lat", "lng", haversine_km("lat", "lng", "s_lat", "s_lng").alias("km"), "site")
    pairs = pairs if within_km is None else pairs.where(F.col("km") <= within_km)
    found = pairs.groupBy("lat", "lng").agg(F.min(F.struct("km", "site")).alias("best"))
    kept = [c for c in points.columns if c not in ("lat", "lng")]
    rows = placed.join(found.hint("merge"), ["lat", "lng"], "left").select(*kept, "best.site", "best.km")
    return rows.unionByName(nowhere.select(*kept), allowMissingColumns=True)


def trail_by_id(trails: DataFrame, trail_id: str) -> DataFrame:
    return trails.where(F.col("id") == trail_id)


def resolve_network(trails: DataFrame, live: DataFrame, trail_id: str, at: tuple[float, float], max_km: float = 2.0) -> DataFrame:
    """The trail of a trailhead: what its own network says (live: trail_id, name, kind), else the path or route with the
    nearest vertex within max_km of the trailhead's place, which is no more than a guess. No row if neither is there or
    the id is not a trailhead's."""
    head = trail_by_id(trails, trail_id).where(F.col("kind") == "trailhead").select("id")
    own = head.join(live.where(F.col("trail_id") == trail_id).limit(1), F.col("id") == F.col("trail_id")).select("id", "name", "kind", F.lit(True).alias("authoritative"))
    near = nearest_vertex(trails, *at, max_km)
    near = head.withColumnRenamed("id", "head").join(near, how="cross").select("id", "name", "kind", F.lit(False).alias("authoritative"))  # one row each
    both = own.unionByName(near)
    return both.orderBy(F.desc("authoritative")).limit(1)


def best_within(points: DataFrame, sites: DataFrame, radius_km: float, prefer: list[str], cell: float | None = None) -> DataFrame:
    """For each point (key, lat, lng) the first site within its box and disk, by `prefer` and then distance.

    sites: site, s_lat, s_lng and the columns of prefer, smaller first. Cells are as high as the radius by default.
    """
    cell = cell or max(radius_km / KM_PER_DEGREE, 0.01)
    dlat, dlng = reach("lat", radius_km)
    span = lambda x, d: F.explode(F.sequence(cell_index(F.col(x) - d, cell), cell_index(F.col(x) + d, cell)))
    look = points.select("key", "lat", "lng", span("lat", dlat).alias("i")).withColumn("j", span("lng", dlng))
    own = sites.withColumn("i", cell_index("s_lat", cell)).withColumn("j", cell_index("s_lng", cell))
    hits = look.join(own, ["i", "j"]).where(in_box("s_lat", "s_lng", F.col("lat"), F.col("lng"), radius_km)).withColumn("km", haversine_km("lat", "lng", "s_lat", "s_lng")).where(F.col("km") <= radius_km)
    return hits.groupBy("key").agg(F.min(F.struct(*prefer, "km", "site")).alias("best")).select("key", F.col("best.site").alias("site"), F.col("best.km").alias("km"), *[F.col(f"best.{p}").alias(p) for p in prefer])

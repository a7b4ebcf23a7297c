"""Layer ingests for many areas at once: cull what is covered, ask by circles or tiles, keep the last row of an id, clip, upsert,
and log what came whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, query_circles, tiles
from ..sources.pages import SOURCES, judged, paged, report
from ..sources.payloads import campgrounds, dedupe_last, trail_rows
from .coverage import covered, is_ingested
from .merge import overwrite_merge, record_ingest


def circles(areas: DataFrame, key: str, radius_km, circle_km: float, number: int, areas_per_task: int = 2_000) -> DataFrame:
    """The query circles (key, circle, c) of areas (key, lat, lng), which are dealt over tasks by their number: an area is a
    few bytes and its grid is hundreds of places, so the size of the table tells nothing of the work."""
    dealt = areas.repartition(max(1, -(-number // areas_per_task)), key)
    return dealt.select(key, F.posexplode(query_circles("lat", "lng", radius_km, circle_km)).alias("circle", "c"))


def circles_to_ask(areas: DataFrame, log: DataFrame, prefix: str, circle_km: float) -> DataFrame:
    """The query circles (area, circle, lat, lng) of areas (area, lat, lng, radius_km) that no logged disk holds whole."""
    asked = areas.select("area", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), F.col("radius_km").alias("a_radius"))
    new = covered(asked, log, prefix).where("NOT covered").select("area")
    rows = circles(areas.join(new, "area"), "area", F.col("radius_km"), circle_km, areas.count())
    return rows.select("area", "circle", F.col("c.lat").alias("lat"), F.col("c.lng").alias("lng"))


def ingest_campgrounds(stored: DataFrame, log: DataFrame, areas: DataFrame, pages: DataFrame, at: str, circle_km: float, prefix: str = "camps:ridb:") -> tuple[DataFrame, DataFrame]:
    """Sites and log after the landed pages (area, circle, page, json) of all areas that were not covered. Sites that
    several circles give count once, the last circle's row; those outside their area's disk are left out. An area is logged
    when every one of its circles came whole."""
    ask, query = circles_to_ask(areas, log, prefix, circle_km), ["area", "circle"]
    given = pages.join(ask.select(*query), query, "left_semi")
    numbered = paged(given, SOURCES["campgrounds"], query)
    rows = campgrounds(numbered).join(areas.select("area", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), "radius_km"), "area")
    rows = rows.where(haversine_km("a_lat", "a_lng", "lat", "lng") <= F.col("radius_km")).drop("a_lat", "a_lng", "radius_km")
    own = dedupe_last(rows.withColumn("own", F.struct("area", "id")), "own", "seq")
    whole = ask.join(report(given, SOURCES["campgrounds"], query).where("state = 'complete'").select(*query, F.lit(True).alias("came")), query, "left").groupBy("area").agg(F.bool_and(F.col("came").isNotNull()).alias("whole")).where("whole")
    counts = own.groupBy("area").agg(F.count("*").alias("n"))
    text = lambda c: F.col(c).cast("string")
    runs = whole.join(areas, "area").join(counts, "area", "left").select(F.concat(F.lit(prefix), text("lat"), F.lit(":"), text("lng"), F.lit(":"), text("radius_km")).alias("key"), F.coalesce("n", F.lit(0)).alias("row_count"), "lat", "lng", "radius_km", F.lit(1).alias("seq"))
    sites = own.withColumn("order", F.struct("area")).select(*stored.columns, "order")
    return overwrite_merge(stored, sites, "id", "order"), record_ingest(log, runs, at)


def tiles_to_ask(regions: DataFrame, log: DataFrame, tile: float, prefix: str = "trails:place:") -> DataFrame:
    """The tiles (place, tile, extent) of regions (place, extent) that the log does not have."""
    key = F.concat(F.lit(prefix), F.col("place").cast("string"))
    new = is_ingested(log, regions.select(key.alias("key")).distinct()).where("NOT ingested").select(F.col("key").alias("new")).hint("merge")
    rows = regions.join(new, key == F.col("new"), "left_semi").select("place", F.posexplode(tiles("min_lat", "min_lng", "max_lat", "max_lng", tile)).alias("tile", "t"))
    return rows.select("place", "tile", "t.*")


def ingest_trails(stored: DataFrame, log: DataFrame, regions: DataFrame, pages: DataFrame, at: str, tile: float, prefix: str = "trails:place:", tiles_per_task: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Trails and log after the landed tiles (place, tile, json) of all regions that were not logged. What came is kept; a region
    is logged only if none of its tiles is missing or failed. A trail counts once for each tile that it touches.

    Pages are dealt by their tile and trails by their id, in as many tasks as the number of pages asks for: compressed sizes
    tell too little of what a task holds."""
    ask, query = tiles_to_ask(regions, log, tile, prefix), ["place", "tile"]
    tasks = max(1, -(-pages.count() // tiles_per_task))
    dealt = pages.repartition(tasks, *query)
    given = judged(dealt.join(ask.select(*query).hint("merge"), query, "left_semi").withColumn("page", F.lit(0)), SOURCES["elements"]).where("NOT failed")
    rows = trail_rows(given.select(*query, F.struct(*query).alias("page"), "p.elements"), by=query)
    missing = ask.join(given.select(*query).hint("merge"), query, "left_anti").select("place").distinct()
    done = ask.select("place").distinct().join(missing.hint("merge"), "place", "left_anti")
    counts = rows.groupBy("place").agg(F.count("*").alias("n"))
    none = [F.lit(None).cast("double").alias(c) for c in ("lat", "lng", "radius_km")]
    runs = done.join(counts.hint("merge"), "place", "left").select(F.concat(F.lit(prefix), F.col("place").cast("string")).alias("key"), F.coalesce("n", F.lit(0)).alias("row_count"), *none, F.lit(1).alias("seq"))
    return overwrite_merge(stored, rows.withColumn("order", F.struct(*query)).select(*stored.columns, "order").repartition(tasks, "id"), "id", "order"), record_ingest(log, runs, at)

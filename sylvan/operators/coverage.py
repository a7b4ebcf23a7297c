"""Questions about the ingest log and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from .proximity import CELL, candidates, in_cells


def covered(areas: DataFrame, log: DataFrame, prefix: str, ending: str = "") -> DataFrame:
    """Per area (key, a_lat, a_lng, a_radius): whether one logged disk holds it whole. If any does, that one does whose
    radius less its distance is greatest, so an area meets only the disks that can be that one in its cell."""
    disks = log.where(F.startswith("key", F.lit(prefix)) & F.endswith("key", F.lit(ending)) & F.col("lat").isNotNull()).groupBy(F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng")).agg(F.max("radius_km").alias("lead"))
    own = in_cells(areas.select("area", F.col("a_lat").alias("lat"), F.col("a_lng").alias("lng"), "a_radius"))
    hits = own.join(candidates(own, disks).hint("merge"), CELL)
    inside = hits.where(haversine_km("lat", "lng", "s_lat", "s_lng") + F.col("a_radius") <= F.col("lead")).select("area").distinct()
    return areas.select("area").join(inside.withColumn("covered", F.lit(True)).hint("merge"), "area", "left").select("area", F.coalesce("covered", F.lit(False)).alias("covered"))


def is_ingested(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Each asked key, and whether the log has it."""
    there = log.select(F.col("key").alias("logged")).distinct()
    return keys.join(there, F.col("key") == F.col("logged"), "left").select("key", F.col("logged").isNotNull().alias("ingested"))


def region_titles(asked: DataFrame, places: DataFrame, looked_up: DataFrame) -> DataFrame:
    """region_id, place_name, state of each asked region: the cached name, a null one included; else what a lookup found,
    to be cached; else null, to be asked again (`looked_up` has no row where the lookup failed)."""
    cached = places.select("region_id", F.col("place_name").alias("kept"), F.lit(True).alias("is_kept"))
    rows = asked.join(cached, "region_id", "left").join(looked_up.select("region_id", F.col("place_name").alias("found"), F.lit(True).alias("is_found")), "region_id", "left")
    state = F.when(F.col("is_kept"), "cached").when(F.col("is_found"), "found").otherwise("failed")
    return rows.select("region_id", F.when(F.col("is_kept"), F.col("kept")).otherwise(F.col("found")).alias("place_name"), state.alias("state"))


def latest_by_place(log: DataFrame) -> DataFrame:
    """The last end date of each place's keys obs:fungi:place:<id>:<start>:<end>."""
    rows = log.where(F.startswith("key", F.lit("obs:fungi:place:")))
    return rows.groupBy(F.split_part("key", F.lit(":"), F.lit(4)).alias("place")).agg(F.max(F.split_part("key", F.lit(":"), F.lit(6))).alias("latest"))


def latest_date(log: DataFrame, lat: float, lng: float, radius_km: float) -> DataFrame:
    """The last end date of the home disks that hold a disk whole."""
    rows = log.where(F.startswith("key", F.lit("obs:fungi:")) & F.col("lat").isNotNull())
    rows = rows.where(haversine_km(lat, lng, "lat", "lng") + F.lit(radius_km) <= F.col("radius_km"))
    return rows.agg(F.max(F.element_at(F.split("key", ":"), -1)).alias("latest"))


def report(places: DataFrame, log: DataFrame) -> DataFrame:
    """Each place with its latest run's rows and time, never a sum over runs."""
    rows = log.where(F.startswith("key", F.lit("obs:fungi:place:")))
    last = rows.groupBy(F.split_part("key", F.lit(":"), F.lit(4)).alias("place")).agg(F.max_by(F.struct("row_count", "fetched_at"), F.struct("fetched_at", "row_count")).alias("run"))
    return places.join(last, "place", "left").select("place", F.coalesce("run.row_count", F.lit(0)).alias("row_count"), F.col("run.fetched_at").alias("fetched_at"))


def search(genera: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Names that contain the text, without regard to case; % and _ in it match anything."""
    rows = genera.where(F.col("name").ilike(f"%{text}%") | F.coalesce(F.col("common_name").ilike(f"%{text}%"), F.lit(False)))
    return rows.orderBy(F.desc_nulls_last("observations_count"), "name", "taxon_id").limit(limit)


def suspects(observations: DataFrame, genera: DataFrame, ratio: float) -> DataFrame:
    """Genera with more stored rows than `ratio` times what the source counts."""
    stored = observations.groupBy("taxon_id").agg(F.count("*").alias("stored"))
    return stored.join(genera, "taxon_id").where(F.col("stored") > ratio * F.coalesce("observations_count", F.lit(0))).select("taxon_id", "name", "stored", "observations_count")


def stale(observations: DataFrame, limit: int) -> DataFrame:
    return observations.orderBy(F.asc_nulls_first("revalidated_at"), "id").limit(limit)


def window_start(floor, latest):
    """Seven days before the last run's end, but not before the floor."""
    return F.greatest(floor, F.coalesce(F.date_sub(latest, 7), floor))

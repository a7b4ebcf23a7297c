"""Regions ranked by seasonal abundance, diversity and recent activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import along_segment, haversine_km


def _chosen(frame: DataFrame, taxa) -> DataFrame:
    return frame.where(F.col("taxon_id").isin(*taxa)) if taxa else frame


def candidates(phenology: DataFrame, months: list[int], taxa: list[int], keep: Column, distance: Column) -> DataFrame:
    """(region, taxon) rows in season whose own count-weighted centre is kept. No month at all selects nothing."""
    inside = F.col("month").isin(*months) if months else F.lit(False)
    rows = _chosen(phenology, taxa).groupBy("region_id", "taxon_id").agg(
        (F.sum(F.col("center_lat") * F.col("cnt")) / F.sum("cnt")).alias("lat"), (F.sum(F.col("center_lng") * F.col("cnt")) / F.sum("cnt")).alias("lng"),
        F.sum("cnt").alias("total_count"), F.coalesce(F.sum(F.when(inside, F.col("cnt"))), F.lit(0)).alias("month_count"),
    )
    rows = rows.where("month_count > 0").withColumn("distance_km", distance).where(keep)
    return rows.withColumn("w_pheno", F.try_divide("month_count", "total_count"))


def species(rows: DataFrame, genera: DataFrame) -> DataFrame:
    """The candidates' names; a taxon that the catalogue lacks goes by its number."""
    named = rows.join(genera.select("taxon_id", "name", "common_name"), "taxon_id", "left")
    return named.select("region_id", "taxon_id", F.coalesce("name", F.col("taxon_id").cast("string")).alias("name"), "common_name", "month_count", "total_count", "w_pheno")


def rank(rows: DataFrame, recent: DataFrame) -> DataFrame:
    """Score of each region. Its centre and distance are those of its kept row with the least taxon_id."""
    r = rows.groupBy("region_id").agg(F.sum(F.col("w_pheno") * F.log1p("month_count")).alias("base"), F.count("*").alias("n_species"), F.min_by(F.struct("lat", "lng", "distance_km"), "taxon_id").alias("at"))
    r = r.join(recent, "region_id", "left").withColumn("recent_count", F.coalesce("recent_count", F.lit(0)))
    r = r.withColumn("score", F.col("base") * (1 + 0.1 * (F.col("n_species") - 1)) * (1 + F.log1p("recent_count")))
    r = r.withColumn("top", F.max("score").over(Window.partitionBy()))  # a row for each grid cell, after all aggregation
    return r.select("region_id", F.col("at.lat").alias("center_lat"), F.col("at.lng").alias("center_lng"), F.round("at.distance_km", 1).alias("distance_km"), "n_species", "recent_count", "score", F.coalesce(F.round(F.try_divide("score", "top"), 4), F.lit(0.0)).alias("score_norm"))


def radial(phenology: DataFrame, recent: DataFrame, months, taxa, lat: float, lng: float, radius_km: float) -> DataFrame:
    return rank(radial_rows(phenology, months, taxa, lat, lng, radius_km), recent)


def radial_rows(phenology: DataFrame, months, taxa, lat: float, lng: float, radius_km: float) -> DataFrame:
    return candidates(phenology, months, taxa, F.col("distance_km") <= radius_km, haversine_km(lat, lng, "lat", "lng"))


def corridor(phenology: DataFrame, recent: DataFrame, months, taxa, start: tuple, end: tuple, corridor_km: float) -> DataFrame:
    """As radial, but along a segment: distance_km is the progress from its start."""
    progress, offset = along_segment("lat", "lng", start, end)
    return rank(candidates(phenology, months, taxa, offset <= corridor_km, progress), recent)


def corridor_to(phenology: DataFrame, recent: DataFrame, months, taxa, start: tuple, destination: DataFrame, corridor_km: float) -> DataFrame:
    """As corridor, to the one row of `destination` (center_lat, center_lng); without a row there is no region."""
    end = destination.select(F.col("center_lat").alias("end_lat"), F.col("center_lng").alias("end_lng")).limit(1)
    progress, offset = along_segment("lat", "lng", start, ("end_lat", "end_lng"))
    rows = candidates(phenology, months, taxa, F.lit(True), F.lit(0.0)).join(F.broadcast(end))  # one row
    rows = rows.withColumn("distance_km", progress).where(offset <= corridor_km)
    return rank(rows, recent)


def in_order(ranked: DataFrame) -> DataFrame:
    """Regions from the best score down, with their place."""
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "region_id"))).orderBy("place")


def with_species(ranked: DataFrame, rows: DataFrame, genera: DataFrame) -> DataFrame:
    """Ranked regions, each with its kept species as an array, the most frequent of the season first. rows: the candidates that
    were ranked. A region has no more of them than the catalogue."""
    own = species(rows, genera).withColumn("fewer", -F.col("month_count"))
    lists = own.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("fewer", "taxon_id", "name", "common_name", "month_count", "total_count", "w_pheno"))).alias("s"))
    listed = lists.select(F.col("region_id").alias("of"), F.transform("s", lambda x: x.dropFields("fewer")).alias("species"))
    return ranked.join(listed, F.col("region_id") == F.col("of"), "left").drop("of")

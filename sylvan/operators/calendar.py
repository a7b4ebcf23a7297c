"""Twelve-month calendars, recent activity and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, in_box
from .phenology import binned, precise_center


def month_totals(phenology: DataFrame, taxa: list[int] = ()) -> DataFrame:
    """Per region that has any row: all twelve months, absent ones as 0."""
    rows = phenology.where(F.col("taxon_id").isin(*taxa)) if taxa else phenology
    rows = rows.groupBy("region_id").agg(*[F.coalesce(F.sum(F.when(F.col("month") == m, F.col("cnt"))), F.lit(0)).alias(f"m{m}") for m in range(1, 13)])
    return rows.select("region_id", F.inline(F.array(*[F.struct(F.lit(m).alias("month"), F.col(f"m{m}").alias("total")) for m in range(1, 13)])))


def heat(totals: DataFrame) -> DataFrame:
    peak = F.max("total").over(Window.partitionBy("region_id"))  # twelve rows each
    return totals.select("region_id", "month", (F.col("total") / F.greatest(F.lit(1), peak)).alias("heat"))


def top_taxa(phenology: DataFrame, genera: DataFrame, most: int = 15) -> DataFrame:
    """The largest taxa of each region and month; equal labels of a month are told apart by number."""
    order = Window.partitionBy("region_id", "month").orderBy(F.desc("cnt"), "taxon_id")
    rows = phenology.select("region_id", "month", "taxon_id", "cnt").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    rows = rows.join(genera.select("taxon_id", "name", "common_name"), "taxon_id", "left")
    name = F.coalesce("name", F.col("taxon_id").cast("string"))
    rows = rows.withColumn("label", F.when(F.col("common_name").isNotNull(), F.concat(name, F.lit(" ("), "common_name", F.lit(")"))).otherwise(name))
    again = F.row_number().over(Window.partitionBy("region_id", "month", "label").orderBy("place"))
    return rows.withColumn("again", again).select("region_id", "month", F.when(F.col("again") > 1, F.concat("label", F.lit(" #"), F.col("taxon_id").cast("string"))).otherwise(F.col("label")).alias("label"), "taxon_id", "cnt")


def recent_rows(observations: DataFrame, cell: float, as_of: str, weeks: int, taxa: list[int] = ()) -> DataFrame:
    rows = binned(observations, cell).where(F.col("observed_on") >= F.date_sub(F.lit(as_of).cast("date"), 7 * weeks))
    return rows.where(F.col("taxon_id").isin(*taxa)) if taxa else rows


def alerts(recent: DataFrame) -> DataFrame:
    """Per region and taxon: how many, the last day, and the place, link and flag of the latest observation."""
    latest = F.max_by(F.struct("place_guess", "uri", "obscured"), F.struct("observed_on", "id"))
    rows = recent.groupBy("region_id", "taxon_id").agg(F.count("*").alias("cnt"), F.max("observed_on").alias("last_observed"), latest.alias("latest"))
    return rows.select("region_id", "taxon_id", "cnt", "last_observed", "latest.place_guess", "latest.uri", "latest.obscured")


def alert_regions(recent: DataFrame) -> DataFrame:
    """Centres over all recent rows of a region, its total and the weight that a map gives it."""
    rows = recent.groupBy("region_id").agg(precise_center("lat").alias("center_lat"), precise_center("lng").alias("center_lng"), F.count("*").alias("total"))
    return rows.withColumn("weight", F.least(F.lit(1.0), F.col("total") / 10))


def recent_page(observations: DataFrame, cell: float, offset: int, size: int) -> DataFrame:
    """A page of the newest observations, undated ones first, with one row more than the page to tell whether there are others."""
    rows = binned(observations, cell).orderBy(F.desc_nulls_first("observed_on"), F.desc("id"))
    return rows.offset(offset).limit(size + 1)


def page_after(observations: DataFrame, days: DataFrame, cell: float, size: int, after: tuple | None = None) -> DataFrame:
    """The page behind a cursor, the (observed_on, id) of the last row that was shown, in the order of recent_page; with one
    row more than the page. Without a cursor it is the first page.

    days: how many research-grade observations each day has (observed_on, n; null for undated ones). They tell how far back
    a page can reach, so that a deep page reads no more than the days it shows.
    """
    day, key = after or (None, None)
    at = F.lit(day).cast("date")
    undated = after is None or day is None  # undated rows come first
    rest = days if undated else days.where(F.col("observed_on") <= at)
    # a day that was begun may hold no further row
    begun = F.lit(False) if after is None else F.col("observed_on").eqNullSafe(at)
    before = F.coalesce(F.sum(F.when(begun, 0).otherwise(F.col("n"))).over(Window.orderBy(F.desc_nulls_first("observed_on")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each day
    low = rest.withColumn("before", before).where(F.col("before") <= size).agg(F.min("observed_on").alias("low")).first()["low"]
    dated = (F.col("observed_on") >= F.lit(low).cast("date")) if low else F.lit(False)
    dated = dated if undated else dated & (F.col("observed_on") <= at)
    rows = binned(observations.where(dated | F.col("observed_on").isNull() if undated else dated), cell)
    if after is not None:
        same = F.col("observed_on").eqNullSafe(at) & (F.col("id") < key)
        rows = rows.where(same | (F.col("observed_on").isNotNull() if day is None else F.col("observed_on") < at))
    return rows.orderBy(F.desc_nulls_first("observed_on"), F.desc("id")).limit(size + 1)


def days_of(observations: DataFrame) -> DataFrame:
    """Research-grade observations by day, for page_after."""
    return observations.where(F.col("quality_grade") == "research").groupBy("observed_on").agg(F.count("*").alias("n"))


def with_places(points: DataFrame) -> DataFrame:
    """Points with their place in the order of points_in_order: that of their day, and that within it."""
    days = points.groupBy(F.col("observed_on").alias("day")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc_nulls_first("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each day
    rows = points.join(days.select("day", before.alias("before")), F.col("observed_on").eqNullSafe(F.col("day")))
    return rows.withColumn("place", (F.col("before") + F.row_number().over(Window.partitionBy("observed_on").orderBy("id"))).cast("int")).drop("day", "before")


def alerts_near(recent: DataFrame, genera: DataFrame, lat: float, lng: float, radius_km: float) -> DataFrame:
    """The alerts of regions whose recent centre lies in a disk, with centre, distance and total of the region, names, and
    the region's place by its total."""
    regions = alert_regions(recent).withColumn("exact_km", haversine_km(lat, lng, "center_lat", "center_lng")).where(F.col("exact_km") <= radius_km)
    regions = regions.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "region_id")))  # grid cells of a disk
    rows = alerts(recent).join(regions, "region_id").join(genera.select("taxon_id", "name", "common_name"), "taxon_id", "left")
    return rows.select(
        "place", "region_id", "center_lat", "center_lng", F.round("exact_km", 1).alias("distance_km"), "total", "taxon_id", F.coalesce("name", F.col("taxon_id").cast("string")).alias("name"), "common_name",
        "cnt", "last_observed", "place_guess", "uri", F.coalesce("obscured", F.lit(False)).alias("obscured"),
    )


def alert_lists(near: DataFrame) -> DataFrame:
    """The regions of alerts_near, each with its taxa as an array, the most frequent first."""
    entry = F.struct((-F.col("cnt")).alias("fewer"), "taxon_id", "name", "common_name", "cnt", "last_observed", "place_guess", "uri", "obscured")
    rows = near.groupBy("place", "region_id", "center_lat", "center_lng", "distance_km", "total").agg(F.array_sort(F.collect_list(entry)).alias("s"))  # at most the catalogue
    return rows.withColumn("species", F.transform("s", lambda x: x.dropFields("fewer"))).drop("s")


def with_photos(page: DataFrame, photos: DataFrame) -> DataFrame:
    """A page of observations, each with its open photos, an empty array where it has none."""
    own = photos.select(F.col("id").alias("of"), "photos")
    empty = F.array().cast(photos.schema["photos"].dataType)
    return page.join(own, page["id"] == own["of"], "left").select(*page.columns, F.coalesce("photos", empty).alias("photos"))


def points_in_order(points: DataFrame, genera: DataFrame) -> DataFrame:
    """Points with names, newest first (those without a day before all others)."""
    rows = points.join(genera.select("taxon_id", "name", "common_name"), "taxon_id", "left").withColumn("name", F.coalesce("name", F.col("taxon_id").cast("string")))
    return rows.orderBy(F.desc_nulls_first("observed_on"), "id")


def precise_points(observations: DataFrame, lat: float, lng: float, radius_km: float) -> DataFrame:
    """Research-grade points that are known to be exact, within a disk."""
    rows = observations.where((F.col("quality_grade") == "research") & (F.col("obscured") == F.lit(False)) & in_box("lat", "lng", lat, lng, radius_km))
    return rows.withColumn("distance_km", haversine_km(lat, lng, "lat", "lng")).where(F.col("distance_km") <= radius_km)

"""Grid-binned observations and the two tables that ranking and calendars read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import region_id
from ..sources.versions import make_current, new_version


def binned(observations: DataFrame, cell: float) -> DataFrame:
    """Research-grade observations with their region."""
    return observations.where(F.col("quality_grade") == "research").withColumn("region_id", region_id("lat", "lng", cell))


def precise_center(name: str) -> Column:
    """Mean over rows that are not known to be obscured, or over all if there are none."""
    exact = ~F.coalesce(F.col("obscured"), F.lit(False))
    return F.coalesce(F.avg(F.when(exact, F.col(name))), F.avg(name))


def build_phenology(observations: DataFrame, cell: float) -> DataFrame:
    rows = binned(observations, cell)
    return rows.groupBy("region_id", "taxon_id", "month").agg(precise_center("lat").alias("center_lat"), precise_center("lng").alias("center_lng"), F.count("*").alias("cnt"))


def build_regions(observations: DataFrame, cell: float) -> DataFrame:
    """Distinct taxa are counted over (region, taxon) partial rows, so that no task sees a region's observations whole."""
    exact = F.when(~F.coalesce(F.col("obscured"), F.lit(False)), 1)
    rows = binned(observations, cell).groupBy("region_id", "taxon_id").agg(
        F.count("*").alias("n"), F.sum("lat").alias("lat"), F.sum("lng").alias("lng"),
        F.count(exact).alias("en"), F.sum(exact * F.col("lat")).alias("elat"), F.sum(exact * F.col("lng")).alias("elng"),
    )
    mean = lambda c: F.coalesce(F.try_divide(F.sum(f"e{c}"), F.sum("en")), F.sum(c) / F.sum("n"))
    return rows.groupBy("region_id").agg(mean("lat").alias("center_lat"), mean("lng").alias("center_lng"), F.sum("n").alias("n_obs"), F.count("taxon_id").alias("n_taxa"))


def build_daily(observations: DataFrame, cell: float) -> DataFrame:
    """How many observations of each taxon a region had on each day: what recency needs of them."""
    return binned(observations, cell).where("observed_on IS NOT NULL").groupBy("region_id", "taxon_id", "observed_on").agg(F.count("*").alias("cnt"))


def write_seasons(observations: DataFrame, cell: float, folder: str) -> None:
    """phenology, regions and daily below folder; daily in order of days, so that a trailing window reads its end."""
    build_phenology(observations, cell).write.parquet(f"{folder}/phenology")
    build_regions(observations, cell).write.parquet(f"{folder}/regions")
    build_daily(observations, cell).repartitionByRange("observed_on").sortWithinPartitions("observed_on", "region_id").write.parquet(f"{folder}/daily")


def publish_phenology(observations: DataFrame, cell: float, root: str, mark: str = "") -> str:
    """The tables as one version under root; readers see all new or all old ones."""
    folder = new_version(root)
    write_seasons(observations, cell, folder)
    return make_current(observations.sparkSession, folder, mark)


def recent_from_daily(daily: DataFrame, as_of: str, weeks: int, taxa: list[int] = ()) -> DataFrame:
    """As recent_counts, from daily counts."""
    rows = daily.where(F.col("observed_on") >= F.date_sub(F.lit(as_of).cast("date"), 7 * weeks))
    rows = rows.where(F.col("taxon_id").isin(*taxa)) if taxa else rows
    return rows.groupBy("region_id").agg(F.sum("cnt").alias("recent_count"))


def recent_counts(observations: DataFrame, cell: float, as_of: str, weeks: int, taxa: list[int] = ()) -> DataFrame:
    """Observations per region in the trailing weeks, whatever the months or the radius."""
    rows = binned(observations, cell).where(F.col("observed_on") >= F.date_sub(F.lit(as_of).cast("date"), 7 * weeks))
    rows = rows.where(F.col("taxon_id").isin(*taxa)) if taxa else rows
    return rows.groupBy("region_id").agg(F.count("*").alias("recent_count"))


def species_counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy("taxon_id").agg(F.count("*").alias("cnt"))


def monthly_histogram(observations: DataFrame) -> DataFrame:
    return observations.groupBy("month").agg(F.count("*").alias("cnt"))

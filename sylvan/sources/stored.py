"""Materialised tables of the benchmark views: built once for each state of their source files, then read by version.

places: camps, trails or land along a curve. points: observations along it. sightings: observations by day. seasons: phenology, regions, and daily counts in order of days.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..operators import phenology as ph
from ..operators.calendar import days_of
from . import layout, views
from .versions import mark_of, refreshed, shared_dir


def _root(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{shared_dir(spark)}/sylvan-store/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}/{name}"


#: Tables of places: the source of each, and the columns that bound its rows.
PLACES = {"camps": ("supplier", layout.POINT), "trails": ("part", layout.EXTENT), "land": ("customer", layout.EXTENT)}


def places(spark: SparkSession, sf_dir: str, name: str = "camps", rows_per_file: int = 1_000_000) -> str:
    """The folder of the current camps, trails or land: a version each, so that a search builds no other one than its own."""
    source, by = PLACES[name]
    mark = mark_of(spark, f"{sf_dir}/{source}.parquet")
    return refreshed(spark, _root(spark, sf_dir, f"{name}-{rows_per_file}"), mark, lambda folder: layout.write(getattr(views, name)(spark, sf_dir), f"{folder}/{name}", by, rows_per_file))


def place_table(spark: SparkSession, sf_dir: str, name: str, lat: float, lng: float, radius_km: float) -> DataFrame:
    """camps, trails or land: the files that a search can need."""
    return layout.near(spark, f"{places(spark, sf_dir, name)}/{name}", lat, lng, radius_km)


def points(spark: SparkSession, sf_dir: str, rows_per_file: int = 1_000_000) -> str:
    """The folder of single observations along a curve."""
    mark = mark_of(spark, f"{sf_dir}/orders.parquet")
    return refreshed(spark, _root(spark, sf_dir, f"points-{rows_per_file}"), mark, lambda folder: layout.write(views.order_observations(spark, sf_dir), f"{folder}/points", layout.POINT, rows_per_file))


def points_near(spark: SparkSession, sf_dir: str, lat: float, lng: float, radius_km: float) -> DataFrame:
    return layout.near(spark, f"{points(spark, sf_dir)}/points", lat, lng, radius_km)


def sightings(spark: SparkSession, sf_dir: str, rows_per_file: int = 1_000_000) -> str:
    """The folder of single observations by day: by_day in order of days, and days with their counts."""
    mark = mark_of(spark, f"{sf_dir}/orders.parquet")

    def build(folder: str) -> None:
        rows = views.order_observations(spark, sf_dir)
        files = max(1, -(-rows.count() // rows_per_file))
        rows.repartitionByRange(files, "observed_on", "id").sortWithinPartitions("observed_on", "id").write.parquet(f"{folder}/by_day")
        days_of(rows).coalesce(1).write.parquet(f"{folder}/days")

    return refreshed(spark, _root(spark, sf_dir, f"sightings-{rows_per_file}"), mark, build)


def seasons(spark: SparkSession, sf_dir: str, cell: float) -> str:
    """The folder of the current phenology, regions and daily counts, built from the observations when these have changed."""
    mark = f"{cell} {mark_of(spark, f'{sf_dir}/lineitem.parquet')}"
    return refreshed(spark, _root(spark, sf_dir, f"seasons-{cell}"), mark, lambda folder: ph.write_seasons(views.line_observations(spark, sf_dir), cell, folder))


def season_table(spark: SparkSession, sf_dir: str, name: str, cell: float) -> DataFrame:
    return spark.read.parquet(f"{seasons(spark, sf_dir, cell)}/{name}")

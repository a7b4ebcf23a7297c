"""What a device has chosen: its home and its genera."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import delete, first_wins_merge, overwrite_merge


def homes(devices: DataFrame, locations: DataFrame, default: tuple[str, float, float, float]) -> DataFrame:
    """Each device's own home (device_id, name, lat, lng, radius_km), or else the default one. An own radius of 0 counts as the
    default one."""
    own = locations.select(F.col("device_id").alias("of"), *[F.col(c).alias(f"own_{c}") for c in ("name", "lat", "lng", "radius_km")])
    rows = devices.select("device_id").distinct().join(own, F.col("device_id") == F.col("of"), "left")
    given = F.col("of").isNotNull()
    pick = [F.when(given, F.col(f"own_{c}")).otherwise(F.lit(v)).alias(c) for c, v in zip(("name", "lat", "lng"), default[:3], strict=True)]
    return rows.select("device_id", *pick, F.coalesce(F.nullif("own_radius_km", F.lit(0.0)), F.lit(default[3])).alias("radius_km"), given.alias("is_own"))


def save_locations(locations: DataFrame, changes: DataFrame) -> DataFrame:
    """The last change of a device (with `seq`) replaces its home whole."""
    return overwrite_merge(locations, changes, "device_id", "seq")


def delete_locations(locations: DataFrame, devices: DataFrame) -> DataFrame:
    return delete(locations, devices.select("device_id"), "device_id")


def add_genera(chosen: DataFrame, added: DataFrame) -> DataFrame:
    """Pairs of device and genus, each once."""
    keyed = lambda df: df.select(F.struct("device_id", "taxon_id").alias("pair"))
    return first_wins_merge(keyed(chosen).distinct(), keyed(added).withColumn("seq", F.lit(0)), "pair", "seq").select("pair.*")


def remove_genera(chosen: DataFrame, removed: DataFrame) -> DataFrame:
    return chosen.join(removed.select("device_id", "taxon_id"), ["device_id", "taxon_id"], "left_anti")


def filters(devices: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each device's genera as an ordered array; an empty one means everything nearby, not nothing."""
    own = chosen.groupBy("device_id").agg(F.array_sort(F.collect_set("taxon_id")).alias("own"))  # at most the catalogue
    return devices.select("device_id").distinct().join(own, "device_id", "left").select("device_id", F.coalesce("own", F.array().cast("array<long>")).alias("taxa"))

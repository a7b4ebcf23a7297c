"""Tables laid out along a space-filling curve, beside the bounds of each of their files.

Neighbours on the map are neighbours in the files: rows are dealt by ranges of the curve and sorted along it. A search
first asks the small table of bounds which files its box touches and scans only those; within them the box's limits reach
the scan as filters on stored columns, so that row groups and pages are skipped by their statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import box_overlaps, col

#: Columns that bound a row: of a point, and of an extent.
POINT = {"min_lat": "lat", "min_lng": "lng", "max_lat": "lat", "max_lng": "lng"}
EXTENT = {c: c for c in POINT}
BITS = 16


def _spread(x: Column) -> Column:
    """The 16 low bits of x, with a zero between each two: its binary digits read in base 4. x occurs once, as Spark would
    work out each of its copies anew."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def curve(lat, lng) -> Column:
    """The place of a point on a Z-curve over the globe, by 16 bits of latitude and of longitude; null without a place."""
    step = lambda x, low, span: F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor((col(x) - low) / span * (1 << BITS)))).cast("long")
    place = F.shiftleft(_spread(step(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(step(lng, -180.0, 360.0)))
    return F.when(col(lat).isNotNull() & col(lng).isNotNull(), place)


def write(frame: DataFrame, path: str, by: dict[str, str] = POINT, rows_per_file: int = 1_000_000) -> None:
    """Write frame to path, and its files' bounds to path + "_bounds"."""
    spark = frame.sparkSession
    files = max(1, -(-frame.count() // rows_per_file))
    middle = lambda axis: (F.col(by[f"min_{axis}"]) + F.col(by[f"max_{axis}"])) / 2
    placed = frame.withColumn("_curve", curve(middle("lat"), middle("lng")))
    placed.repartitionByRange(files, "_curve").sortWithinPartitions("_curve").drop("_curve").write.parquet(path)
    low = [F.min(by[c]).alias(c) for c in ("min_lat", "min_lng")]
    high = [F.max(by[c]).alias(c) for c in ("max_lat", "max_lng")]
    spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(*low, *high, F.count("*").alias("rows")).coalesce(1).write.parquet(f"{path}_bounds")


def near(spark: SparkSession, path: str, lat: float, lng: float, radius_km: float) -> DataFrame:
    """The rows of the files that the box around a disk touches; what is inside the box is left to the caller's filter."""
    touched = spark.read.parquet(f"{path}_bounds").where(box_overlaps(lat, lng, radius_km)).select("file")
    files = [r["file"] for r in touched.collect()]  # names, as any scan lists them
    return spark.read.parquet(*files) if files else spark.read.parquet(path).where(F.lit(False))

"""Phenology, regions and daily counts that follow merges without a new build.

The state below a root is partial rows, counts and sums by region, taxon, month and day, in one folder for each batch. A
merge adds what its rows bring and takes off what the same rows brought before, so it reads nothing but the images of the
rows that it touches. Readers add the partial rows of a group, whose sums are exact decimals, so that what is taken off leaves
nothing behind. A batch counts once its row in `batches` is there, and only once: a lost run is repeated under its
number, and a number that counts already is left alone. `compact` adds all up into one whole batch, from which readers then start.

Rows without a month, day or taxon make groups of their own, as in a full build. A group whose rows are all gone is gone. Values
of lat and lng are kept to 15 decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import delete_folder
from .phenology import binned

KEYS = {"daily": ["region_id", "taxon_id", "month", "observed_on"], "monthly": ["region_id", "taxon_id", "month"]}
GIVEN = ["taxon_id", "lat", "lng", "observed_on", "month", "quality_grade", "obscured"]
SUMS = [f"{kind}{c}_{x}" for c in ("lat", "lng") for kind in ("", "exact_") for x in ("n", "sum")]
VALUE, SUM = "decimal(18,15)", "decimal(38,15)"


def images(stored: DataFrame, merged: DataFrame, ids: DataFrame) -> DataFrame:
    """What a merge changed: the rows of ids (id) as they were, with sign -1, and as they are, with sign 1."""
    touched = ids.select("id").distinct()
    one = lambda rows, sign: rows.join(touched, "id", "left_semi").select(*GIVEN, F.lit(sign).cast("long").alias("sign"))
    return one(stored, -1).unionByName(one(merged, 1))


def _partial(rows: DataFrame) -> DataFrame:
    """Signed rows with a region, added up by day."""
    exact, sums = ~F.coalesce("obscured", F.lit(False)), [F.sum("sign").alias("cnt")]
    for c in ("lat", "lng"):
        x = F.col(c).try_cast(VALUE)
        for kind, ok in (("", x.isNotNull()), ("exact_", x.isNotNull() & exact)):
            sums.append(F.sum(F.when(ok, F.col("sign")).otherwise(0)).alias(f"{kind}{c}_n"))
            sums.append(F.sum(F.when(ok, F.when(F.col("sign") > 0, x).otherwise(-x)).otherwise(F.lit(0).cast(VALUE))).cast(SUM).alias(f"{kind}{c}_sum"))
    return rows.groupBy(*KEYS["daily"]).agg(*sums)


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), *[F.sum(c).cast(SUM if c.endswith("sum") else "long").alias(c) for c in SUMS])


def _changing(parts: DataFrame) -> DataFrame:
    """Without groups in which what came and what went are the same."""
    return parts.where(" OR ".join(f"{c} <> 0" for c in ("cnt", *SUMS)))


def _write(spark: SparkSession, root: str, batch: int, daily: DataFrame, whole: bool) -> None:
    """Both tables of a batch, and only then its row."""
    at = {name: f"{root}/{name}/batch={batch}" for name in (*KEYS, "batches")}
    _changing(daily).write.mode("overwrite").parquet(at["daily"])
    _changing(_added(spark.read.parquet(at["daily"]), KEYS["monthly"])).write.mode("overwrite").parquet(at["monthly"])
    spark.range(1).select(F.lit(whole).alias("whole")).write.mode("overwrite").parquet(at["batches"])


def start(observations: DataFrame, cell: float, root: str) -> None:
    """The state of all observations, as batch 0."""
    _write(observations.sparkSession, root, 0, _partial(binned(observations.select(*GIVEN, F.lit(1).cast("long").alias("sign")), cell)), True)


def follow(changed: DataFrame, cell: float, root: str, batch: int) -> None:
    """Take over the images of a merge. The caller numbers batches upward; one up to the last that counts is left alone."""
    spark = changed.sparkSession
    if batch > _batches(spark, root)[-1]:
        _write(spark, root, batch, _partial(binned(changed, cell)), False)


def _batches(spark: SparkSession, root: str) -> list[int]:
    """The batches that readers add up: the last whole one and those after it. Their number is that of merges since then."""
    rows = spark.read.schema("whole boolean, batch long").parquet(f"{root}/batches")
    first = rows.where("whole").agg(F.max("batch")).first()[0]
    return sorted(r["batch"] for r in rows.where(F.col("batch") >= first).select("batch").collect())


def parts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The partial rows of monthly or daily that count now."""
    return spark.read.parquet(*[f"{root}/{name}/batch={b}" for b in _batches(spark, root)])


def _center(c: str, add=lambda name: F.col(name)) -> Column:
    mean = lambda kind: F.try_divide(add(f"{kind}{c}_sum").cast("double"), add(f"{kind}{c}_n"))
    return F.coalesce(mean("exact_"), mean("")).alias(f"center_{c}")


def _seasons(monthly: DataFrame) -> DataFrame:
    return _added(monthly, KEYS["monthly"]).where("cnt > 0").select(*KEYS["monthly"], _center("lat"), _center("lng"), "cnt")


def phenology(spark: SparkSession, root: str) -> DataFrame:
    """As build_phenology over the observations of now."""
    return _seasons(parts(spark, root, "monthly"))


def regions(spark: SparkSession, root: str) -> DataFrame:
    """As build_regions over the observations of now."""
    rows = _added(parts(spark, root, "monthly"), ["region_id", "taxon_id"]).where("cnt > 0")
    return rows.groupBy("region_id").agg(_center("lat", F.sum), _center("lng", F.sum), F.sum("cnt").alias("n_obs"), F.count("taxon_id").alias("n_taxa"))


def daily(spark: SparkSession, root: str) -> DataFrame:
    """As build_daily over the observations of now."""
    rows = parts(spark, root, "daily").where("observed_on IS NOT NULL").groupBy("region_id", "taxon_id", "observed_on")
    return rows.agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def changed_groups(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """The phenology rows, as they are now, of the groups that a batch touched; a group without a row is gone. A table that
    is kept elsewhere takes these over instead of all."""
    rows = parts(spark, root, "monthly")
    touched = spark.read.parquet(f"{root}/monthly/batch={batch}").select(*[F.col(k).alias(f"of_{k}") for k in KEYS["monthly"]])
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in KEYS["monthly"]]
    return _seasons(rows.join(touched, same, "left_semi"))


def compact(spark: SparkSession, root: str) -> int:
    """Add up all batches into a new whole one; those before the whole one that was read so far are deleted. The next merge
    takes a number above the one that is returned."""
    read = _batches(spark, root)
    whole = read[-1] + 1
    _write(spark, root, whole, _added(parts(spark, root, "daily"), KEYS["daily"]), True)
    for r in spark.read.schema("whole boolean, batch long").parquet(f"{root}/batches").where(F.col("batch") < read[0]).select("batch").collect():
        for name in ("batches", *KEYS):
            delete_folder(spark, f"{root}/{name}/batch={r['batch']}")
    return whole

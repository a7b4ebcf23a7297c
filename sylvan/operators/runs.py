"""Ingest runs and re-checks. Each is one new version of the observations and the log together, so that a reader never sees
rows without their log row or a log row without its rows.

A root holds versions with the tables observations, ingest_log and batch (the rows that the run brought).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..schemas import INGEST_LOG, OBSERVATIONS
from ..sources.payloads import STORED, classified, ingest_counts
from ..sources.versions import current, make_current, new_version
from .coverage import latest_by_place, latest_date, stale
from .merge import coalesce_merge, delete, mark, record_ingest

MERGED = ["taxon_id", "lat", "lng", "observed_on", "month", "quality_grade", "positional_accuracy", "place_guess", "uri", "obscured"]
OVERLAP_DAYS = 7


def tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Observations and log of the current version; empty ones before the first."""
    found = current(spark, root)
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{found[0]}/{name}") if found else spark.createDataFrame([], schema)
    return read("observations", OBSERVATIONS), read("ingest_log", INGEST_LOG)


def commit(spark: SparkSession, folder: str, observations: DataFrame, log: DataFrame, note: str = "") -> str:
    """Write both tables into a version and make it the current one."""
    observations.select([c.split()[0] for c in OBSERVATIONS.split(", ")]).write.parquet(f"{folder}/observations")
    log.select([c.split()[0] for c in INGEST_LOG.split(", ")]).write.parquet(f"{folder}/ingest_log")
    return make_current(spark, folder, note)


@dataclass(frozen=True)
class Area:
    """A disk around home, or a place with its number."""

    lat: float | None = None
    lng: float | None = None
    radius_km: float | None = None
    place: int | None = None

    def key(self, start: dt.date, end: dt.date) -> str:
        where = f"place:{self.place}" if self.place is not None else f"{self.lat}:{self.lng}:{self.radius_km}"
        return f"obs:fungi:{where}:{start}:{end}"


def window_start(log: DataFrame, area: Area, floor: dt.date, countries: tuple[int, ...] = ()) -> dt.date:
    """A week before the end of what the log has of the area, but not before the floor. What is logged of a country counts for
    home only where it is the one country: with more of them, home may lie in another."""
    places = [area.place] if area.place is not None else list(countries) if len(countries) == 1 else []
    found = [r["latest"] for r in latest_by_place(log).where(F.col("place").isin([str(p) for p in places])).collect()] if places else []
    if area.place is None:
        found.append(latest_date(log, area.lat, area.lng, area.radius_km).first()["latest"])
    found = [dt.date.fromisoformat(d) for d in found if d]
    return max(floor, max(found) - dt.timedelta(days=OVERLAP_DAYS)) if found else floor


def known_genera(genera: DataFrame) -> DataFrame:
    """The catalogue; an empty one is an error, as a run against it would look whole and drop nearly all."""
    if genera.isEmpty():
        raise ValueError("the genus catalogue is empty")
    return genera


@dataclass(frozen=True)
class Run:
    folder: str
    start: dt.date
    counts: DataFrame


def ingest(spark: SparkSession, root: str, payloads: DataFrame, genera: DataFrame, area: Area, floor: dt.date, today: dt.date, at: str, countries: tuple[int, ...] = (), quality: str | None = None, complete: bool = True) -> Run:
    """One run: landed observations (a column `o`, and `seq` for their order) of the window from the log on are merged, and
    the run is logged, in one version. A run that was broken off (complete=False) keeps its rows, but has no log row, so that
    the next one reads its window again. counts: rows by genus, and rows left out by reason.
    """
    known_genera(genera)
    stored, log = tables(spark, root)
    start, folder = window_start(log, area, floor, countries), new_version(root)
    given = payloads if "seq" in payloads.columns else payloads.withColumn("seq", F.monotonically_increasing_id())
    rows = classified(given, genera)
    inside = F.col("observed_on").between(F.lit(start), F.lit(today))
    inside = inside if area.radius_km is None else inside & (haversine_km(area.lat, area.lng, "lat", "lng") <= area.radius_km)
    inside = inside & (F.col("quality_grade") == quality) if quality else inside
    # rows without a place or a day cannot be told to lie outside
    rows.where((F.col("fate") != STORED) | inside).write.parquet(f"{folder}/batch")
    batch = spark.read.parquet(f"{folder}/batch")
    kept = batch.where(F.col("fate") == STORED)
    if complete:
        own = {"lat": area.lat, "lng": area.lng, "radius_km": area.radius_km}
        run = kept.agg(F.count("*").alias("row_count")).select(F.lit(area.key(start, today)).alias("key"), "row_count", *[F.lit(v).cast("double").alias(k) for k, v in own.items()], F.lit(1).alias("seq"))
        log = record_ingest(log, run, at)
    commit(spark, folder, coalesce_merge(stored, kept, "id", "seq", MERGED), log)
    return Run(folder, start, ingest_counts(batch))


@dataclass(frozen=True)
class Checked:
    checked: int
    purged: int
    reassigned: int


def recheck_batch(spark: SparkSession, root: str, live: DataFrame, genera: DataFrame, ids: DataFrame, at: str, complete: bool = True) -> Checked:
    """True up the rows of ids with what the source says now (landed observations, a column `o`): rows that are gone, have no
    genus, or lack place or day are purged; the others take all that the source gives and are stamped. Where the reading was
    broken off, ids that were not seen are left alone."""
    known_genera(genera)
    stored, log = tables(spark, root)
    folder = new_version(root)
    ids.select("id").distinct().write.parquet(f"{folder}/asked")
    asked = spark.read.parquet(f"{folder}/asked")
    given = live.where(F.col("o.id").isNotNull()).join(asked.withColumnRenamed("id", "asked"), F.col("o.id") == F.col("asked"), "left_semi")
    given = given if "seq" in given.columns else given.withColumn("seq", F.monotonically_increasing_id())
    classified(given, genera).write.parquet(f"{folder}/batch")
    batch = spark.read.parquet(f"{folder}/batch")
    kept = batch.where(F.col("fate") == STORED)
    # an id that came twice is judged by its last row
    fate = batch.groupBy("id").agg(F.max_by(F.struct("fate", "taxon_id"), "seq").alias("last"))
    old = stored.select(F.col("id").alias("old_id"), F.col("taxon_id").alias("old_taxon"))
    judged = asked.join(fate, "id", "left").join(old, F.col("id") == F.col("old_id"), "left")
    seen, fine = F.col("last").isNotNull(), F.col("last.fate") == STORED
    purge = judged.where(seen & ~fine | (~seen if complete else F.lit(False)))
    moved = fine & ~F.col("last.taxon_id").eqNullSafe(F.col("old_taxon"))
    kept = kept.join(purge.select("id"), "id", "left_anti")
    merged = coalesce_merge(delete(stored, purge.select("id"), "id"), kept, "id", "seq", MERGED)
    commit(spark, folder, mark(merged, kept.select("id"), "id", "revalidated_at", at), log)
    total = judged.agg(F.count("*").alias("asked"), F.count_if(seen).alias("seen"), F.count_if(seen & ~fine).alias("bad"), F.count_if(moved).alias("moved")).first()
    return Checked(total["asked"] if complete else total["seen"], total["bad"] + (total["asked"] - total["seen"] if complete else 0), total["moved"])


def resync(spark: SparkSession, root: str, live: DataFrame, genera: DataFrame, size: int, at: str) -> Checked:
    """Re-check the batch that was checked longest ago, never checked rows first."""
    return recheck_batch(spark, root, live, genera, stale(tables(spark, root)[0], size), at)


def resync_until_done(spark: SparkSession, root: str, live: DataFrame, genera: DataFrame, size: int, at: str, most_batches: int | None = None) -> list[Checked]:
    """Batch after batch until one is short, or as many rows are checked as there were at the start, or most_batches."""
    whole, done = tables(spark, root)[0].count(), []
    while most_batches is None or len(done) < most_batches:
        done.append(resync(spark, root, live, genera, size, at))
        if done[-1].checked < size or sum(b.checked for b in done) >= whole:
            break
    return done


def revalidate(spark: SparkSession, root: str, live: DataFrame, genera: DataFrame, suspects: DataFrame, at: str) -> Checked:
    """Re-check all rows of suspect genera (taxon_id)."""
    rows = tables(spark, root)[0]
    return recheck_batch(spark, root, live, genera, rows.join(suspects.select("taxon_id").distinct(), "taxon_id", "left_semi"), at)

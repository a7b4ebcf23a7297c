"""Keyed merges as joins: each reads both sides once and shuffles them on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(batch: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each column's last value that is not null, in the order of the batch."""
    return batch.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def coalesce_merge(stored: DataFrame, batch: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """New values win where they are not null; columns that the batch does not carry stay."""
    new = fold(batch, key, order, columns).select(F.col(key).alias("k"), *[F.col(c).alias(f"new_{c}") for c in columns])
    both = stored.join(new, stored[key] == new["k"], "full_outer")
    rest = [F.col(c) for c in stored.columns if c not in (key, *columns)]
    return both.select(F.coalesce(key, "k").alias(key), *[F.coalesce(f"new_{c}", c).alias(c) for c in columns], *rest)


def overwrite_merge(stored: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The batch's last row of a key replaces the stored one whole, nulls included."""
    columns = [c for c in stored.columns if c != key]
    last = batch.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("row")).select(key, "row.*")
    return stored.join(last.select(key).hint("merge"), key, "left_anti").select(key, *columns).unionByName(last)


def record_ingest(log: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """The log with a row for each finished run (key, row_count, lat, lng, radius_km and seq, the last of a key counts),
    stamped as_of. A run that was broken off is not among `runs`, so that its window is read again."""
    stamped = runs.withColumn("fetched_at", F.lit(as_of).cast("timestamp"))
    return overwrite_merge(log, stamped, "key", "seq")


def first_wins_merge(stored: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    columns = [c for c in stored.columns if c != key]
    first = batch.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("row")).select(key, "row.*")
    return stored.unionByName(first.join(stored, key, "left_anti").select(*stored.columns))


def delete(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids, key, "left_anti")


def mark(stored: DataFrame, ids: DataFrame, key: str, column: str, at: str) -> DataFrame:
    hit = ids.select(F.col(key).alias("k")).distinct()
    return stored.join(hit, stored[key] == hit["k"], "left").withColumn(column, F.when(F.col("k").isNotNull(), F.lit(at).cast("timestamp")).otherwise(F.col(column))).drop("k")


def recheck(live: DataFrame, stored: DataFrame, asked: DataFrame) -> DataFrame:
    """What a re-read of `asked` ids means for each: purge (gone or without genus), reassign, or keep."""
    seen = live.select("id", F.col("taxon_id").alias("live_taxon"), F.lit(True).alias("seen"))
    rows = asked.join(stored.select("id", "taxon_id"), "id", "left").join(seen, "id", "left")
    action = F.when(F.col("seen").isNull() | F.col("live_taxon").isNull(), "purge").when(F.col("taxon_id").isNotNull() & (F.col("taxon_id") != F.col("live_taxon")), "reassign").otherwise("keep")
    return rows.select("id", "taxon_id", "live_taxon", action.alias("action"))

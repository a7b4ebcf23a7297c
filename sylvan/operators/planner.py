"""Trip plans: corridor candidates, sites for each, and the walk along the route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from .proximity import best_within


def stops(ranked: DataFrame, camps: DataFrame, trails: DataFrame, camp_km: float, trail_km: float, least_score: float, need_free: bool, most: int) -> DataFrame:
    """The best-scoring regions with the camp (free first, then near) and the trail of each, at most `most`."""
    points = ranked.where(F.col("score_norm") >= least_score).select(F.col("region_id").alias("key"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"), "score", "score_norm", "distance_km", *[c for c in ("n_species", "recent_count") if c in ranked.columns])
    sites = camps.select(F.col("id").alias("site"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"), F.when(F.coalesce("free", F.lit(False)), 0).otherwise(1).alias("paid"))
    heads = trails.select(F.col("id").alias("site"), F.col("center_lat").alias("s_lat"), F.col("center_lng").alias("s_lng"))
    camp = best_within(points, sites, camp_km, ["paid"]).select("key", F.col("site").alias("camp_id"), F.round("km", 1).alias("camp_km"), (F.col("paid") == 0).alias("camp_free"))
    trail = best_within(points, heads, trail_km, []).select("key", F.col("site").alias("trail_id"), F.round("km", 1).alias("trail_km"))
    rows = points.join(camp, "key", "left").join(trail, "key", "left")
    rows = rows.where(F.coalesce("camp_free", F.lit(False))) if need_free else rows
    return rows.orderBy(F.desc("score"), "key").limit(most)


#: What each stop of a plan carries.
CARRIED = {"score_norm": "double", "n_species": "long", "recent_count": "long", "camp_id": "string", "camp_free": "boolean", "camp_km": "double", "trail_id": "string", "trail_km": "double"}


def walk(chosen: DataFrame, start: tuple[float, float], max_drive_km: float) -> DataFrame:
    """Stops in order of rounded progress; a leg that is too long skips its stop. One fold over at most `most` stops."""
    more = [c for c in CARRIED if c in chosen.columns]
    one = chosen.agg(F.array_sort(F.collect_list(F.struct(F.col("distance_km").alias("progress"), (-F.col("score")).alias("worse"), "key", "lat", "lng", *more))).alias("stops"))
    kind = "array<struct<key:string,progress:double,leg:double,total:double" + "".join(f",{c}:{CARRIED[c]}" for c in more) + ">>"
    begin = F.struct(F.lit(start[0]).alias("lat"), F.lit(start[1]).alias("lng"), F.lit(0.0).alias("total"), F.lit(0).alias("skipped"), F.array().cast(kind).alias("out"))

    def step(a, s):
        leg = haversine_km(a["lat"], a["lng"], s["lat"], s["lng"])
        far = leg > max_drive_km
        stop = F.struct(s["key"].alias("key"), s["progress"].alias("progress"), leg.alias("leg"), (a["total"] + leg).alias("total"), *[s[c].alias(c) for c in more])
        return F.when(far, F.struct(a["lat"], a["lng"], a["total"], (a["skipped"] + 1).alias("skipped"), a["out"].alias("out"))).otherwise(F.struct(s["lat"].alias("lat"), s["lng"].alias("lng"), (a["total"] + leg).alias("total"), a["skipped"].alias("skipped"), F.concat(a["out"], F.array(stop).cast(kind)).alias("out")))

    rows = one.select(F.aggregate("stops", begin, step).alias("a"))
    rows = rows.select(F.col("a.skipped").alias("skipped"), F.posexplode_outer("a.out").alias("pos", "s"))
    return rows.select("pos", F.col("s.key").alias("region_id"), F.col("s.progress").alias("progress_km"), F.round("s.leg", 4).alias("leg_km"), F.round("s.total", 4).alias("total_km"), "skipped", *[F.col(f"s.{c}").alias(c) for c in more])


def destination(ranked: DataFrame, start: tuple[float, float], least_km: float) -> DataFrame:
    """The best region whose centre is far enough from the start, for plans without a destination."""
    return ranked.where(haversine_km(*start, "center_lat", "center_lng") >= least_km).orderBy(F.desc("score"), "region_id").limit(1)


def header(walked: DataFrame, start: tuple[float, float], goal: DataFrame, corridor_km: float, months: list[int]) -> DataFrame:
    """One row on a whole plan: where it goes, how many stops it keeps and skips, and how far it drives. Without a destination
    (goal: at most one region) it ends where it starts, and the destination has no name."""
    total = walked.agg(F.count("pos").alias("n_stops"), F.coalesce(F.round(F.max("total_km"), 1), F.lit(0.0)).alias("total_drive_km"), F.coalesce(F.max("skipped"), F.lit(0)).alias("skipped_unreachable"))
    end = goal.select(F.col("center_lat").alias("g_lat"), F.col("center_lng").alias("g_lng"), F.col("region_id").alias("destination_name")).limit(1)
    rows = total.join(end, how="left")  # one row, and one or none
    return rows.select(F.lit(start[0]).alias("start_lat"), F.lit(start[1]).alias("start_lng"), F.coalesce("g_lat", F.lit(start[0])).alias("destination_lat"), F.coalesce("g_lng", F.lit(start[1])).alias("destination_lng"), "destination_name", F.lit(corridor_km).alias("corridor_km"), F.array(*[F.lit(m) for m in months]).alias("months"), "n_stops", "total_drive_km", "skipped_unreachable")

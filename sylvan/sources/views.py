"""The engine's tables derived from the benchmark tables, in Spark and as SQL common table expressions.

Coordinates are multiples of powers of two, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spot(a: Column, b: Column, span: int, low: float) -> Column:
    return F.lit(low) + F.pmod(a + b, F.lit(span)) / F.lit(1024.0)


def line_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, day = table(spark, sf_dir, "lineitem"), F.to_date("l_shipdate")
    return t.select(
        (F.col("l_partkey") % 25).alias("taxon_id"), _spot(F.col("l_orderkey") * 7919, F.col("l_linenumber") * 31, 4096, 44.0).alias("lat"), _spot(F.col("l_orderkey") * 104729, F.col("l_linenumber") * 57, 6144, -124.0).alias("lng"),
        day.alias("observed_on"), F.month(day).alias("month"), F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "needs_id").otherwise("research").alias("quality_grade"),
        F.when(F.col("l_suppkey") % 5 == 0, True).when(F.col("l_suppkey") % 5 != 1, False).alias("obscured"),
    )


def order_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, day, k = table(spark, sf_dir, "orders"), F.to_date("o_orderdate"), F.col("o_orderkey")
    return t.select(
        k.alias("id"), (F.col("o_custkey") % 25).alias("taxon_id"), _spot(k * 7919, F.lit(0), 4096, 44.0).alias("lat"), _spot(k * 104729, F.lit(0), 6144, -124.0).alias("lng"), day.alias("observed_on"), F.month(day).alias("month"),
        F.when(F.col("o_orderstatus") == "P", "needs_id").otherwise("research").alias("quality_grade"), F.col("o_orderpriority").alias("place_guess"), F.when(k % 7 > 0, F.concat(F.lit("obs/"), k.cast("string"))).alias("uri"),
        F.when(F.col("o_orderpriority") == "1-URGENT", True).when(F.col("o_orderpriority") != "5-LOW", False).alias("obscured"), F.when(k % 9 > 0, F.date_sub(day, (k % 50).cast("int"))).alias("revalidated_at"),
        (k % 40000).cast("int").alias("positional_accuracy"),
    )


def genera(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where("n_nationkey <> 24").select(k.cast("long").alias("taxon_id"), F.when(k.isin(6, 7), "NATION_6").otherwise(F.col("n_name")).alias("name"), F.when(k % 3 > 0, F.concat(F.lit("Common "), (k % 4).cast("string"))).alias("common_name"), F.when(k % 5 > 0, k * 40).alias("observations_count"))


def camps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, True).alias("free"), _spot(k * 7919, F.lit(11), 4096, 44.0).alias("lat"), _spot(k * 104729, F.lit(13), 6144, -124.0).alias("lng"))


def trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size") / 1024.0
    lat, lng = _spot(k * 7919, F.lit(101), 4096, 44.0), _spot(k * 104729, F.lit(103), 6144, -124.0)
    return table(spark, sf_dir, "part").select(k.cast("string").alias("id"), F.col("p_name").alias("name"), F.when(k % 3 == 0, "trailhead").when(k % 3 == 1, "path").otherwise("route").alias("kind"), lat.alias("min_lat"), lng.alias("min_lng"), (lat + size).alias("max_lat"), (lng + size).alias("max_lng"), (lat + size / 2).alias("center_lat"), (lng + size / 2).alias("center_lng"), F.col("p_size").alias("steps"))


def vertices(trails: DataFrame) -> DataFrame:
    """Trails with one vertex for each 1/1024 degree along their diagonal."""
    return trails.withColumn("vertices", F.transform(F.sequence(F.lit(0), F.col("steps")), lambda i: F.struct((F.col("min_lat") + i / 1024.0).alias("lat"), (F.col("min_lng") + i / 1024.0).alias("lng"))))


def land(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lat, lng, size = _spot(k * 7919, F.lit(7), 4096, 44.0), _spot(k * 104729, F.lit(9), 6144, -124.0), (k % 512 + 64) / 1024.0
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), F.col("c_mktsegment").alias("agency"), F.col("c_name").alias("unit"), lat.alias("min_lat"), lng.alias("min_lng"), (lat + size).alias("max_lat"), (lng + size).alias("max_lng"))


def ingest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, day = F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")
    place = F.concat(F.lit("obs:fungi:place:"), (u % 40).cast("string"), F.lit(":2015-01-01:"), day)
    lat, lng, radius = _spot(u * 7919, F.lit(0), 4096, 44.0), _spot(u * 104729, F.lit(0), 6144, -124.0), (u % 200 + 50).cast("double")
    home = F.concat(F.lit("obs:fungi:"), u.cast("string"), F.lit(":x:"), (u % 200 + 50).cast("string"), F.lit(":2015-01-01:"), day)
    disk = F.col("event_type") == "view"
    return table(spark, sf_dir, "events").where("event_type IN ('view','click')").select(F.when(disk, home).otherwise(place).alias("key"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("row_count"), F.when(disk, lat).alias("lat"), F.when(disk, lng).alias("lng"), F.when(disk, radius).alias("radius_km"))


def _sql_spot(a: str, span: int, low: float) -> str:
    return f"({low}::DOUBLE + (({a}) % {span})::DOUBLE / 1024)"


SQL = {
    "lobs": f"""SELECT l_partkey % 25 AS taxon_id, {_sql_spot('l_orderkey*7919+l_linenumber*31', 4096, 44.0)} AS lat, {_sql_spot('l_orderkey*104729+l_linenumber*57', 6144, -124.0)} AS lng, l_shipdate::DATE AS observed_on, month(l_shipdate)::INT AS month,
CASE WHEN l_linestatus='O' AND l_returnflag='N' THEN 'needs_id' ELSE 'research' END AS quality_grade, CASE WHEN l_suppkey%5=0 THEN true WHEN l_suppkey%5<>1 THEN false END AS obscured FROM lineitem""",
    "oobs": f"""SELECT o_orderkey AS id, o_custkey % 25 AS taxon_id, {_sql_spot('o_orderkey*7919', 4096, 44.0)} AS lat, {_sql_spot('o_orderkey*104729', 6144, -124.0)} AS lng, o_orderdate::DATE AS observed_on, month(o_orderdate)::INT AS month,
CASE WHEN o_orderstatus='P' THEN 'needs_id' ELSE 'research' END AS quality_grade, o_orderpriority AS place_guess, CASE WHEN o_orderkey%7>0 THEN 'obs/'||o_orderkey END AS uri,
CASE WHEN o_orderpriority='1-URGENT' THEN true WHEN o_orderpriority<>'5-LOW' THEN false END AS obscured, CASE WHEN o_orderkey%9>0 THEN o_orderdate::DATE - (o_orderkey%50)::INT END AS revalidated_at, (o_orderkey%40000)::INT AS positional_accuracy FROM orders""",
    "genera": """SELECT n_nationkey::BIGINT AS taxon_id, CASE WHEN n_nationkey IN (6,7) THEN 'NATION_6' ELSE n_name END AS name, CASE WHEN n_nationkey%3>0 THEN 'Common '||(n_nationkey%4) END AS common_name, CASE WHEN n_nationkey%5>0 THEN (n_nationkey*40)::INT END AS observations_count FROM nation WHERE n_nationkey<>24""",
    "camps": f"""SELECT s_suppkey::VARCHAR AS id, s_name AS name, CASE WHEN s_suppkey%3=0 THEN true END AS free, {_sql_spot('s_suppkey*7919+11', 4096, 44.0)} AS lat, {_sql_spot('s_suppkey*104729+13', 6144, -124.0)} AS lng FROM supplier""",
    "trails": f"""SELECT *, min_lat + steps/1024.0::DOUBLE AS max_lat, min_lng + steps/1024.0::DOUBLE AS max_lng, min_lat + steps/2048.0::DOUBLE AS center_lat, min_lng + steps/2048.0::DOUBLE AS center_lng FROM
(SELECT p_partkey::VARCHAR AS id, p_name AS name, CASE p_partkey%3 WHEN 0 THEN 'trailhead' WHEN 1 THEN 'path' ELSE 'route' END AS kind, {_sql_spot('p_partkey*7919+101', 4096, 44.0)} AS min_lat, {_sql_spot('p_partkey*104729+103', 6144, -124.0)} AS min_lng, p_size AS steps FROM part)""",
    "land": f"""SELECT *, min_lat+size AS max_lat, min_lng+size AS max_lng FROM (SELECT c_custkey::VARCHAR AS id, c_mktsegment AS agency, c_name AS unit, {_sql_spot('c_custkey*7919+7', 4096, 44.0)} AS min_lat, {_sql_spot('c_custkey*104729+9', 6144, -124.0)} AS min_lng, (c_custkey%512+64)::DOUBLE/1024 AS size FROM customer)""",
    "log": f"""SELECT CASE WHEN event_type='view' THEN 'obs:fungi:'||user_id||':x:'||(user_id%200+50)||':2015-01-01:'||strftime(ts,'%Y-%m-%d') ELSE 'obs:fungi:place:'||(user_id%40)||':2015-01-01:'||strftime(ts,'%Y-%m-%d') END AS key, ts AS fetched_at, event_id AS row_count,
CASE WHEN event_type='view' THEN {_sql_spot('user_id*7919', 4096, 44.0)} END AS lat, CASE WHEN event_type='view' THEN {_sql_spot('user_id*104729', 6144, -124.0)} END AS lng, CASE WHEN event_type='view' THEN (user_id%200+50)::DOUBLE END AS radius_km FROM events WHERE event_type IN ('view','click')""",
}

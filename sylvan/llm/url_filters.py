"""URL filters as a sort-merge range join (DataFrame functions only).

A rule is a host and a path prefix. Its canonical key is the reversed host with the path, so that it covers an
interval of sorted keys. Sweeping a host's rule bounds in key order gives, after each bound, the innermost active
rule: a close falls back to the last rule that was opened at the depth that is left, which is the top of the stack.
A url looks up each suffix of its host that has rules. Bounds and urls are then swept together in sorted order.

A host that holds most urls is dealt over slices in proportion to its share; only its few rule bounds are repeated
in each slice. Urls travel as (page_id, host, path), never with their pages.

A null url, or one without ://, has an empty host and path and gets the default verdict. Repeated rows stay
repeated. Two rules with the same host and path: block wins. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii

#: The rules of the contract: fixed values.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
AFTER_ALL = "X'FF'"  # no UTF-8 text holds this byte, so prefix || FF closes the prefix's interval


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path, both empty where there is no ://."""
    host = lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """verdict, rule, host_key, prefix (binary), labels."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules])
    r = spark.range(1).select(F.inline(rows))
    r = r.groupBy("rule").agg(F.max("verdict").alias("verdict"))  # block is the larger string
    labels = F.split(lower_ascii(F.substring_index("rule", "/", 1)), r"\.")
    prefix = F.expr("substring(rule, locate('/', rule))")
    return r.select("verdict", "rule", reversed_host(labels).alias("host_key"), prefix.cast("binary").alias("prefix"), F.size(labels).alias("labels"))


def active_rules(rules: DataFrame) -> DataFrame:
    """The rules' own sweep: host_key, key and the innermost rule that is active from that key on (or null)."""
    opened = rules.select("host_key", F.col("prefix").alias("key"), F.lit(1).alias("delta"), F.struct("rule", "verdict").alias("own"))
    closed = rules.select("host_key", F.concat("prefix", F.expr(AFTER_ALL)).alias("key"), F.lit(-1).alias("delta"), F.lit(None).cast("struct<rule:string,verdict:string>").alias("own"))
    sweep = opened.unionByName(closed).withColumn("depth", F.sum("delta").over(Window.partitionBy("host_key").orderBy("key")))
    top = F.last("own", ignorenulls=True).over(Window.partitionBy("host_key", "depth").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    return sweep.select("host_key", "key", F.when(F.col("depth") > 0, top).alias("active"))


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (or null) and verdict of every row of pages."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = url_parts(F.col("url"))
    urls = scratch.table(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    table = rule_table(spark, rules)
    deepest = table.agg(F.max("labels")).first()[0] or 0
    bounds = scratch.table(active_rules(table), "bounds")
    labels = F.split("host", r"\.")
    probes = urls.distinct().select("page_id", "host", "path", F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, deepest))))).alias("k"), labels.alias("labels"))
    probes = probes.select("page_id", "host", "path", reversed_host(F.slice("labels", -F.col("k"), F.col("k"))).alias("host_key"))
    probes = scratch.table(probes.join(bounds.select("host_key").distinct(), "host_key", "left_semi"), "probes")
    # each host's share of the probes decides its number of slices: no slice exceeds a quarter of an even task
    width = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = max(1, probes.count())
    slices = probes.groupBy("host_key").agg(F.ceil(F.count("*") * width / total).cast("int").alias("slices"))
    key = F.col("path").cast("binary")
    left = probes.join(slices, "host_key").select("host_key", F.pmod(F.xxhash64("page_id", "host", "path"), F.col("slices")).cast("int").alias("slice"), key.alias("key"), F.lit(1).alias("probe"), F.lit(None).cast("struct<active:struct<rule:string,verdict:string>>").alias("bound"), "page_id", "host", "path")
    right = bounds.join(slices, "host_key").select("host_key", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "key", F.lit(0).alias("probe"), F.struct("active").alias("bound"), F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    order = Window.partitionBy("host_key", "slice").orderBy("key", "probe").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("hit", F.last("bound", ignorenulls=True).over(order)).where("probe = 1 AND hit.active IS NOT NULL")
    best = found.groupBy("page_id", "host", "path").agg(F.max(F.struct(F.length("hit.active.rule").alias("n"), F.col("hit.active.rule").alias("rule"), F.col("hit.active.verdict").alias("verdict"))).alias("best"))
    best = best.select(F.col("page_id").alias("b_id"), F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best")
    same = urls["page_id"].eqNullSafe(best["b_id"]) & (urls["host"] == best["b_host"]) & (urls["path"] == best["b_path"])
    out = urls.join(best, same, "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

"""Landed pages of paged sources: which of them a reader would have come to, and what they hold.

A reader asks for page after page and stops where a source's rule says so, or where a page cannot be read. Landed pages are
judged alike without an order of reading: each page tells by itself whether it is a last one, as all pages before the last
are full, and what counts is the least last page of a query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .payloads import CAMPGROUNDS, ELEMENTS, FEATURES, OBSERVATION, TAXA

_BAD = "_bad"


@dataclass(frozen=True)
class Source:
    """schema of a page, its array of items, items on a full page (0: one page holds all), and the sign of further pages."""

    schema: str
    items: str
    size: int
    more: Callable[[Column], Column] = lambda p: F.lit(True)


def _until_total(page: Column) -> Column:
    """Further pages come while those up to this one hold less than the total; without a total, while pages are full."""
    total = F.col("p.METADATA.RESULTS.TOTAL_COUNT")
    return total.isNull() | (page * 50 + F.size("p.RECDATA") < total)


#: Page sizes: fixed values.
SOURCES = {
    "observations": Source(f"results array<struct<{OBSERVATION}>>", "results", 200),
    "taxa": Source(f"results array<struct<{TAXA}>>", "results", 200),
    "campgrounds": Source(CAMPGROUNDS + ", METADATA struct<RESULTS struct<TOTAL_COUNT long>>", "RECDATA", 50, _until_total),
    "land": Source(FEATURES + ", exceededTransferLimit boolean", "features", 1000, lambda p: F.coalesce(F.col("p.exceededTransferLimit"), F.lit(False))),
    "elements": Source(ELEMENTS, "elements", 0),
}


def judged(pages: DataFrame, source: Source) -> DataFrame:
    """pages (query columns, page from 0 on, json) with the parsed page `p`, its number of items, whether it failed and whether
    it is a last one. No text, and what is not of the schema, is a failure."""
    read = F.from_json("json", f"{source.schema}, {_BAD} string", {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"})
    rows = pages.select(*[c for c in pages.columns if c != "json"], F.explode(F.array(read)).alias("p"))
    failed = F.col("p").isNull() | F.col(f"p.{_BAD}").isNotNull()
    items = F.when(failed, 0).otherwise(F.coalesce(F.size(f"p.{source.items}"), F.lit(0)))
    rows = rows.withColumns({"failed": failed, "items": F.greatest(items, F.lit(0))})
    last = F.lit(True) if not source.size else F.col("failed") | (F.col("items") < source.size) | ~source.more(F.col("page"))
    return rows.withColumn("last", last)


def ends(rows: DataFrame, query: list[str]) -> DataFrame:
    """For each query the page at which a reader stops, and why: complete, failed, or cut where the next page is not there."""
    slim = rows.select(*query, "page", "last", "failed")
    after = slim.select(*query, (F.col("page") - 1).alias("page"), F.lit(True).alias("next")).distinct()
    stop = slim.join(after, [*query, "page"], "left").where(F.col("last") | F.col("next").isNull())
    first = slim.groupBy(*query).agg(F.min("page").alias("first"))
    why = F.when(F.col("failed"), "failed").when(F.col("last"), "complete").otherwise("cut")
    found = stop.groupBy(*query).agg(F.min(F.struct("page", why.alias("state"))).alias("stop")).join(first, query)
    # without its first page a query was never read
    return found.select(*query, F.when(F.col("first") > 0, -1).otherwise(F.col("stop.page")).alias("end"), F.when(F.col("first") > 0, "failed").otherwise(F.col("stop.state")).alias("state"))


def paged(pages: DataFrame, source: Source, query: list[str]) -> DataFrame:
    """The pages that count, parsed, with their query and page: those up to the end of their query. A failed page keeps the ones
    before it and touches no other query."""
    rows = judged(pages, source)
    kept = rows.join(ends(rows, query), query).where((F.col("page") <= F.col("end")) & ~F.col("failed"))
    return kept.select(*query, "page", "p.*").drop(_BAD)


def report(pages: DataFrame, source: Source, query: list[str]) -> DataFrame:
    """Each query with its state and how many items it gave."""
    rows = judged(pages, source)
    stop = ends(rows, query)
    counted = rows.select(*query, "page", "items", "failed").join(stop, query).where((F.col("page") <= F.col("end")) & ~F.col("failed")).groupBy(*query).agg(F.count("*").alias("pages"), F.sum("items").alias("items"))
    return stop.join(counted, query, "left").select(*query, "state", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("items", F.lit(0)).alias("items"))

"""Text and payload fields as Column expressions."""

from __future__ import annotations

import html
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .geo import col

#: Phrases that mark a site as free; "$0" also occurs in "$0.50", which counts. Fixed values.
FREE_MARKERS = ("no fee", "no charge", "free of charge", "fee: none", "$0", "$0.00")
#: Address keys from the most to the least telling: fixed values.
PLACE_KEYS = ("national_park", "protected_area", "forest", "state_forest", "nature_reserve", "city", "town", "village", "hamlet", "county")


#: Texts of a batch that are Python's own strings at a time.
TEXTS_AT_ONCE = 64


@F.arrow_udf(StringType())
def _decoded(texts: pa.Array) -> pa.Array:
    """All character references of HTML decoded, and each run of white space of any kind as one blank. A batch may be large,
    so it is turned into strings and back in small parts."""
    clean = lambda t: None if t is None else " ".join(html.unescape(t).split())
    parts = (texts.slice(k, TEXTS_AT_ONCE) for k in range(0, len(texts), TEXTS_AT_ONCE))
    return pa.concat_arrays([pa.array(map(clean, p.to_pylist()), texts.type) for p in parts] or [texts])


def clean_html(text) -> Column:
    """Tags become blanks, then character references are decoded, white space collapses and an empty text is null."""
    return F.nullif(_decoded(F.regexp_replace(col(text), "<[^>]+>", " ")), F.lit(""))


def free_from_fee(fee) -> Column:
    """True if the text says so, else null."""
    low = F.lower(col(fee))
    return F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in FREE_MARKERS]), F.lit(True))


def fee_tag(tag) -> Column:
    """`no`, in any case and between blanks, is free; any other text is a fee; no text is unknown."""
    t = F.nullif(F.lower(F.regexp_replace(col(tag), r"(?U)^\s+|\s+$", "")), F.lit(""))
    return F.struct(F.when(t == "no", F.lit(True)).alias("free"), F.when(t != "no", F.lit("fee required")).alias("fee"))


def parse_coordinates(text) -> Column:
    """struct(lat, lng) of "lat, lng" or "lat lng" within range, else null."""
    pattern = r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*[, ]\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$"
    lat, lng = (F.regexp_extract(col(text), pattern, k).try_cast("double") for k in (1, 2))
    return F.when(lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("lat"), lng.alias("lng")))


def months_of(text: str | None, current: int) -> list[int]:
    """The months of a request: absent means the current one, empty all twelve; others than 1 to 12 are an error."""
    if text is None:
        return [current]
    months = [int(x) for x in text.split(",") if x.strip()]
    if not all(1 <= m <= 12 for m in months):
        raise ValueError("months must be 1-12")
    return months or list(range(1, 13))


def taxa_of(text: str | None, selected: list[int]) -> list[int]:
    """The taxa of a request: `all` or nothing means the device's selection; no taxon at all means no filter."""
    return list(selected) if not text or text == "all" else [int(x) for x in text.split(",") if x.strip()]


def or_default(value, default):
    """0 and nothing mean the default."""
    return value or default


def lenient_date(text) -> Column:
    """The day that the first ten characters write: YYYY-MM-DD, YYYYMMDD, or the ISO week as YYYY-Www-D, YYYYWwwD, YYYY-Www
    or YYYYWww; else null. A form of eight signs without dashes may have two more behind it, of a time."""
    day = F.substring(col(text), 1, 10)
    plain = F.when(F.rlike(day, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.try_to_date(day, "yyyy-MM-dd")).when(F.rlike(day, F.lit("^[0-9]{8}(..)?$")), F.try_to_date(F.substring(day, 1, 8), "yyyyMMdd"))
    packed = F.replace(day, F.lit("-"), F.lit(""))
    part = lambda at, n: F.substring(packed, at, n).try_cast("int")
    year, week, weekday = part(1, 4), part(6, 2), F.coalesce(part(8, 1), F.lit(1))
    # the fourth of January lies in the first week
    monday = F.date_add(F.trunc(F.try_to_date(F.concat(F.substring(packed, 1, 4), F.lit("-01-04")), "yyyy-MM-dd"), "week"), (week - 1) * 7)
    there = week.between(1, 52) | (week == 53) & (F.weekofyear(monday) == 53)
    of_week = F.when(F.rlike(day, F.lit("^([0-9]{4}-W[0-9]{2}(-[1-7])?|[0-9]{4}W[0-9]{2}([1-7](..)?)?)$")) & there & (year > 0), F.date_add(monday, weekday - 1))
    return F.coalesce(plain, of_week)


def first_text(*parts) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(p), F.lit("")) for p in parts])


def notable_place(address) -> Column:
    return first_text(*[F.try_element_at(col(address), F.lit(k)) for k in PLACE_KEYS])


def property_of(properties, name: str) -> Column:
    """A map's value by key, exactly or else without regard to case."""
    p = col(properties)
    lowered = F.map_filter(p, lambda k, v: F.lower(k) == name.lower())
    return F.coalesce(F.try_element_at(p, F.lit(name)), F.get(F.map_values(lowered), F.lit(0)))


def obscured_by_accuracy(accuracy, low: int, high: int) -> Column:
    return F.when(col(accuracy).between(low, high), F.lit(True))


def node_id(trailhead) -> Column:
    """The number in a trailhead's id; null for the id of anything else."""
    return F.nullif(F.regexp_extract(col(trailhead), "^osm:node/([0-9]+)$", 1), F.lit("")).try_cast("long")

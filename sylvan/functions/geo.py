"""Geometry on latitude and longitude as Column expressions, so that all of it stays in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EARTH_KM, KM_PER_DEGREE, LEAST_COS, MOST_CIRCLES


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def _half_sine_squared(a: Column, b: Column) -> Column:
    return F.pow(F.sin(F.radians(b - a) / 2), 2)


def _cosines(lat1: Column, lat2: Column) -> Column:
    return F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))


def _great_circle_km(h: Column) -> Column:
    return 2 * EARTH_KM * F.when(h < 1, F.asin(F.sqrt(h))).when(h >= 1, F.asin(F.lit(1.0)))  # null without a place


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    lat1, lng1, lat2, lng2 = map(col, (lat1, lng1, lat2, lng2))
    return _great_circle_km(_half_sine_squared(lat1, lat2) + _cosines(lat1, lat2) * _half_sine_squared(lng1, lng2))


def reach(lat, radius_km) -> tuple[Column, Column]:
    """Half the height and half the width in degrees of the box around a disk."""
    r = col(radius_km)
    return r / KM_PER_DEGREE, r / (KM_PER_DEGREE * F.greatest(F.abs(F.cos(F.radians(col(lat)))), F.lit(LEAST_COS)))


def in_box(lat, lng, at_lat, at_lng, radius_km) -> Column:
    dlat, dlng = reach(at_lat, radius_km)
    at_lat, at_lng = col(at_lat), col(at_lng)
    return col(lat).between(at_lat - dlat, at_lat + dlat) & col(lng).between(at_lng - dlng, at_lng + dlng)


def box_overlaps(at_lat, at_lng, radius_km) -> Column:
    """Whether the row's extent touches the box around a disk."""
    dlat, dlng = reach(at_lat, radius_km)
    at_lat, at_lng = col(at_lat), col(at_lng)
    return (F.col("min_lat") <= at_lat + dlat) & (F.col("max_lat") >= at_lat - dlat) & (F.col("min_lng") <= at_lng + dlng) & (F.col("max_lng") >= at_lng - dlng)


def planar(lat, lng, ref_lat: Column) -> tuple[Column, Column]:
    """Kilometres east and north on the tangent plane at ref_lat."""
    scale = KM_PER_DEGREE * F.greatest(F.abs(F.cos(F.radians(ref_lat))), F.lit(LEAST_COS))
    return col(lng) * scale, col(lat) * KM_PER_DEGREE


def along_segment(lat, lng, start: tuple, end: tuple) -> tuple[Column, Column]:
    """(progress, offset) in km of a point against a segment, on the plane that touches its start. Progress is a share of
    the great-circle length; for a segment without length it is the distance from the start."""
    ref, whole = col(start[0]), haversine_km(*start, *end)
    (ax, ay), (bx, by), (px, py) = planar(*start, ref), planar(*end, ref), planar(lat, lng, ref)
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((px - ax) * dx + (py - ay) * dy, square))))
    offset = F.hypot(px - (ax + t * dx), py - (ay + t * dy))
    return F.when(whole == 0, offset).otherwise(t * whole), offset


def cell_index(x, cell: float) -> Column:
    return F.floor(col(x) / cell).cast("int")


def region_id(lat, lng, cell: float) -> Column:
    return F.concat_ws("_", cell_index(lat, cell).cast("string"), cell_index(lng, cell).cast("string"))


def region_center(region, cell: float) -> tuple[Column, Column]:
    """Nominal centre of a cell; both null where the id is malformed."""
    part = lambda i: (F.split_part(col(region), F.lit("_"), F.lit(i)).try_cast("int") + 0.5) * cell
    ok = F.rlike(col(region), F.lit(r"^-?[0-9]+_-?[0-9]+$"))
    return F.when(ok, part(1)), F.when(ok, part(2))


def region_radius_km(cell: float) -> float:
    """Half the height of a cell."""
    return cell * KM_PER_DEGREE / 2


def envelope(lat, lng, radius_km) -> Column:
    dlat, dlng = reach(lat, radius_km)
    lat, lng = col(lat), col(lng)
    return F.struct((lat - dlat).alias("min_lat"), (lng - dlng).alias("min_lng"), (lat + dlat).alias("max_lat"), (lng + dlng).alias("max_lng"))


def tiles(min_lat, min_lng, max_lat, max_lng, tile: float) -> Column:
    """The boxes of at most `tile` degrees that cover a box, as an array of structs."""
    min_lat, min_lng, max_lat, max_lng = map(col, (min_lat, min_lng, max_lat, max_lng))
    steps = lambda a, b: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((b - a) / tile).cast("int") - 1))
    box = lambda i, j: F.struct(
        (min_lat + i * tile).alias("min_lat"), (min_lng + j * tile).alias("min_lng"),
        F.least(max_lat, min_lat + (i + 1) * tile).alias("max_lat"), F.least(max_lng, min_lng + (j + 1) * tile).alias("max_lng"),
    )
    return F.flatten(F.transform(steps(min_lat, max_lat), lambda i: F.transform(steps(min_lng, max_lng), lambda j: box(i, j))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def query_circles(lat, lng, radius_km, circle_km: float, most: int = MOST_CIRCLES) -> Column:
    """Centres of circles on a grid as wide as their radius that together cover a disk: those whose circle reaches the
    disk and, of these, the `most` nearest to its centre (in the grid's order where distances are equal).

    Sines and cosines hang on one side of the grid alone, so they are worked out for its sides and not for each circle."""
    lat, lng, r = col(lat), col(lng), col(radius_km)
    n = F.greatest(F.lit(1), F.ceil(r / circle_km).cast("int"))
    high = lambda at: F.struct(at.alias("lat"), _half_sine_squared(lat, at).alias("h"), _cosines(lat, at).alias("c"))
    wide = lambda at: F.struct(at.alias("lng"), _half_sine_squared(lng, at).alias("h"))
    side = lambda start, step, made: F.transform(F.transform(F.sequence(-n, n), lambda i: start + i * step), made)
    at = lambda x, y: F.struct(_great_circle_km(x["h"] + x["c"] * y["h"]).alias("km"), x["lat"].alias("lat"), y["lng"].alias("lng"))
    line = lambda x, ys: F.filter(F.transform(ys, lambda y: at(x, y)), lambda c: c["km"] <= r + circle_km)
    near = _once(F.array(*reach(lat, circle_km)), lambda d: _once(side(lng, d[1], wide), lambda ys: F.flatten(F.transform(side(lat, d[0], high), lambda x: line(x, ys)))))
    # in the grid's order both lat and lng rise
    kept = _once(near, lambda c: F.when(F.size(c) > most, F.slice(F.sort_array(c), 1, most)).otherwise(c))
    return F.transform(kept, lambda c: F.struct(c["lat"].alias("lat"), c["lng"].alias("lng")))


def thin(vertices, most: int = 60) -> Column:
    """At most `most` evenly spaced vertices, both ends among them; positions are rounded half to even."""
    v = col(vertices)
    at = lambda i: F.get(v, F.rint(i * (F.size(v) - 1) / (most - 1)).cast("int"))
    return F.when(F.size(v) <= most, v).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), at))

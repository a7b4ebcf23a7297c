"""External payloads to typed rows: every parser is a projection over declared JSON or CSV schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import OBSCURED_ACCURACY, OPEN_LICENCES, ROOT_TAXON

OBSERVATION = "id long, geojson struct<coordinates array<double>>, location string, observed_on string, quality_grade string, positional_accuracy int, place_guess string, uri string, obscured boolean, taxon struct<id long, rank string, ancestor_ids array<long>, iconic_taxon_id long>, photos array<struct<url string, license_code string, attribution string>>"
CAMPGROUNDS = "RECDATA array<struct<FacilityID string, FacilityName string, FacilityLatitude double, FacilityLongitude double, FacilityUseFeeDescription string>>"
ELEMENTS = "elements array<struct<type string, id long, lat double, lon double, center struct<lat double, lon double>, tags map<string,string>, nodes array<long>, geometry array<struct<lat double, lon double>>, members array<struct<type string, ref long, geometry array<struct<lat double, lon double>>>>>>"
FEATURES = "features array<struct<properties map<string,string>, geometry struct<type string, coordinates string>>>"
TAXA = "id long, name string, rank string, preferred_common_name string, observations_count int, ancestor_ids array<long>"
BULK_LINE = "inat_id long, genus string, taxon_id long, lat double, lng double, coordinate_uncertainty_m string, event_date string"
#: Places of the bulk archive's columns: fixed values.
BULK_COLUMNS = {"id": 0, "event_date": 16, "lat": 20, "lng": 21, "accuracy": 22, "country": 24, "taxon": 29, "genus": 37}


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows from a column of JSON texts, one each; null texts give no row, and what is no JSON a row of nulls.

    The parsed value is a generator's output, which the optimiser refers to, where it would copy a call of from_json into
    every field and filter.
    """
    return rows.select(F.explode(F.array(F.from_json(column, schema))).alias("parsed")).where("parsed IS NOT NULL").select("parsed.*")


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def coordinates(observation: str = "o") -> tuple[Column, Column]:
    """GeoJSON order first, then a "lat,lng" or "[lat,lng]" location."""
    c = lambda name: F.col(f"{observation}.{name}")
    point = F.when(F.size(c("geojson.coordinates")) == 2, c("geojson.coordinates"))
    part = lambda k: F.trim(F.split_part(F.regexp_replace(c("location"), r"[\[\]\s]", ""), F.lit(","), F.lit(k))).try_cast("double")
    return F.coalesce(F.get(point, F.lit(1)), part(1)), F.coalesce(F.get(point, F.lit(0)), part(2))


def resolve_genus(rows: DataFrame, genera: DataFrame) -> DataFrame:
    """Adds genus_id: a genus counts as itself, else the first ancestor that the catalogue knows; others are null.

    rows: taxon_id, rank, iconic_taxon_id, ancestor_ids and any others. They are read once: each meets the catalogue with
    its ancestors beside it, and is put together again by partial aggregation.
    """
    of_root = F.col("iconic_taxon_id") == ROOT_TAXON
    wanted = F.when(of_root & (F.coalesce("rank", F.lit("")) != "genus"), F.col("ancestor_ids"))
    steps = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.struct(*rows.columns).alias("_rest"), F.posexplode_outer(wanted).alias("_pos", "_ancestor"))
    known = steps.join(genera.select(F.col("taxon_id").alias("_known")).distinct(), F.col("_ancestor") == F.col("_known"), "left")
    out = known.groupBy("_row").agg(F.first("_rest").alias("_rest"), F.min_by("_known", F.when(F.col("_known").isNotNull(), F.col("_pos"))).alias("_found")).select("_rest.*", "_found")
    return out.withColumn("genus_id", F.when(of_root & (F.col("rank") == "genus"), F.col("taxon_id")).otherwise(F.col("_found"))).drop("_found")


#: What an observation becomes: fixed values.
STORED, NO_GENUS, INCOMPLETE = "stored", "no genus", "no place or day"


def classified(payloads: DataFrame, genera: DataFrame) -> DataFrame:
    """JSON observations (a column `o`) as rows with their fate: stored, without a genus, or without place or day. A column
    `seq` is carried along."""
    lat, lng = coordinates()
    p = payloads.select(
        F.col("o.id").alias("id"), lat.alias("lat"), lng.alias("lng"), tx.lenient_date("o.observed_on").alias("observed_on"), F.col("o.taxon.id").alias("taxon_id"), F.col("o.taxon.rank").alias("rank"), F.col("o.taxon.iconic_taxon_id").alias("iconic_taxon_id"),
        F.col("o.taxon.ancestor_ids").alias("ancestor_ids"), *[F.col(f"o.{c}").alias(c) for c in ("quality_grade", "positional_accuracy", "place_guess", "uri", "obscured")], *[c for c in payloads.columns if c == "seq"],
    )
    fate = F.when(F.col("genus_id").isNull(), NO_GENUS).when(F.col("lat").isNull() | F.col("lng").isNull() | F.col("observed_on").isNull(), INCOMPLETE).otherwise(STORED)
    rows = resolve_genus(p, genera).withColumn("fate", fate)
    return rows.select("id", F.col("genus_id").alias("taxon_id"), "lat", "lng", "observed_on", F.month("observed_on").cast("short").alias("month"), "quality_grade", "positional_accuracy", "place_guess", "uri", "obscured", "fate", *[c for c in payloads.columns if c == "seq"])


def observation_rows(payloads: DataFrame, genera: DataFrame) -> DataFrame:
    """Rows from JSON observations (a column `o`); those without place, date or genus are dropped."""
    return classified(payloads, genera).where(F.col("fate") == STORED).drop("fate")


def open_photos(payloads: DataFrame) -> DataFrame:
    """id and the photos whose licence allows display, for observations that have any photo."""
    photos = F.filter("o.photos", lambda p: F.lower(p["license_code"]).isin(*OPEN_LICENCES))
    return payloads.where(F.size("o.photos") > 0).select(F.col("o.id").alias("id"), photos.alias("photos"))


def campgrounds(pages: DataFrame) -> DataFrame:
    """Facilities with a place. Where pages have an area, a circle and a page, rows carry the area and their order `seq`."""
    own = {"area", "circle", "page"} <= set(pages.columns)
    f = pages.select(*(["area", "circle", "page"] if own else []), F.posexplode("RECDATA").alias("place", "f")).select(*(["area", F.struct("circle", "page", "place").alias("seq")] if own else []), "f.*")
    f = f.where("FacilityID <> '' AND FacilityLatitude IS NOT NULL AND FacilityLongitude IS NOT NULL AND NOT (FacilityLatitude = 0 AND FacilityLongitude = 0)")
    fee = tx.clean_html("FacilityUseFeeDescription")
    f = f.withColumn("fee", fee)
    return f.select(*(["area", "seq"] if own else []), F.concat(F.lit("ridb:"), "FacilityID").alias("id"), tx.first_text("FacilityName", F.concat(F.lit("Facility "), "FacilityID")).alias("name"), F.lit("campground").alias("kind"), "fee", tx.free_from_fee("fee").alias("free"), F.col("FacilityLatitude").alias("lat"), F.col("FacilityLongitude").alias("lng"), F.lit("ridb").alias("source"), F.concat(F.lit("https://www.recreation.gov/camping/campgrounds/"), "FacilityID").alias("url"))


def _elements(pages: DataFrame, by: list[str] = ()) -> DataFrame:
    """Elements with their place in the pages' order: that of a column `page`, else that in which the pages are read."""
    page = F.col("page") if "page" in pages.columns else F.monotonically_increasing_id()
    e = pages.select(*by, page.alias("page"), F.posexplode("elements").alias("nth", "e")).select(*by, F.struct("page", "nth").alias("seq"), "e.*").where(F.col("type").isin("node", "way", "relation") & F.col("id").isNotNull())
    path = F.concat("type", F.lit("/"), F.col("id").cast("string"))
    return e.withColumn("key", F.concat(F.lit("osm:"), path)).withColumn("url", F.concat(F.lit("https://www.openstreetmap.org/"), path))


def _tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def reported_sites(pages: DataFrame) -> DataFrame:
    """Names by tag where there is none: fixed values."""
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    place = F.when(own, F.struct("lat", "lon")).otherwise(F.struct(F.col("center.lat").alias("lat"), F.col("center.lon").alias("lon")))
    e = _elements(pages).select("key", "url", "tags", place.alias("p")).where("p.lat IS NOT NULL AND p.lon IS NOT NULL")
    fee = tx.fee_tag(_tag("fee"))
    unnamed = F.when(_tag("backcountry") == "yes", "Backcountry campsite (OSM)").when(_tag("tourism") == "camp_pitch", "Camp pitch (OSM)").otherwise("Campsite (OSM)")
    return e.select(F.col("key").alias("id"), tx.first_text(_tag("name"), unnamed).alias("name"), F.lit("reported").alias("kind"), fee["fee"].alias("fee"), fee["free"].alias("free"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lng"), F.lit("osm").alias("source"), "url")


def trail_rows(pages: DataFrame, most: int = 60, by: list[str] = ()) -> DataFrame:
    """Trailheads, ways and relations with thinned geometry, extent and middle vertex; the last row of an id stays,
    or of an id and the columns `by` of the pages. Names without a tag: fixed values."""
    from ..functions.geo import thin

    whole = lambda line: F.filter(line, lambda v: v["lat"].isNotNull() & v["lon"].isNotNull())
    ways = F.filter(F.transform(F.col("members"), lambda m: F.when(m["type"] == "way", whole(m["geometry"]))), lambda m: F.size(m) > 0)
    e = _elements(pages, by)
    point = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.array(F.array(F.struct("lat", "lon"))))
    lines = F.when(F.col("type") == "node", point).when(F.col("type") == "way", F.array(whole(F.col("geometry")))).otherwise(ways)
    e = e.withColumn("lines", F.transform(F.filter(lines, lambda x: F.size(x) > 0), lambda x: thin(x, most))).withColumn("flat", F.flatten("lines")).where(F.size("flat") > 0)
    lat, lng = F.transform("flat", lambda v: v["lat"]), F.transform("flat", lambda v: v["lon"])
    middle = F.get("flat", F.floor(F.size("flat") / 2).cast("int"))
    pair = lambda v: F.array(v["lon"], v["lat"])
    shape = (
        F.when(F.size("flat") == 1, F.to_json(F.struct(F.lit("Point").alias("type"), pair(F.get("flat", F.lit(0))).alias("coordinates"))))
        .when(F.size("lines") == 1, F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform("flat", pair).alias("coordinates"))))
        .otherwise(F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.transform("lines", lambda x: F.transform(x, pair)).alias("coordinates"))))
    )
    kind = F.when(F.col("type") == "node", "trailhead").when(F.col("type") == "way", "path").otherwise("route")
    unnamed = F.when(F.col("type") == "node", "Trailhead (OSM)").when(F.col("type") == "way", "Trail (OSM)").otherwise("Hiking route (OSM)")
    ref = F.when(F.col("type") != "node", _tag("ref"))
    rows = e.select("seq", *by, F.col("key").alias("id"), tx.first_text(_tag("name"), ref, unnamed).alias("name"), kind.alias("kind"), F.array_min(lat).alias("min_lat"), F.array_min(lng).alias("min_lng"), F.array_max(lat).alias("max_lat"), F.array_max(lng).alias("max_lng"), middle["lat"].alias("center_lat"), middle["lon"].alias("center_lng"), shape.alias("geojson"), F.lit("osm").alias("source"), "url")
    if not by:
        return dedupe_last(rows, "id", "seq")
    rest = [c for c in rows.columns if c not in ("seq", "id", *by)]  # pages that are dealt by these columns stay where they are
    return rows.groupBy("id", *by).agg(F.max_by(F.struct(*rest), "seq").alias("row")).select("id", *by, "row.*")


#: Sources of land units: agency, property with the id, property with the name, name where there is none, address. Fixed values.
LAND_SOURCES = {
    "blm": ("BLM", "OBJECTID", "ADMIN_UNIT_NAME", "BLM land", "https://gis.blm.gov/arcgis/rest/services/lands/BLM_Natl_SMA_LimitedScale/MapServer/1"),
    "usfs": ("USFS", "OBJECTID", "FORESTNAME", "National Forest", "https://apps.fs.usda.gov/arcx/rest/services/EDW/EDW_ForestSystemBoundaries_01/MapServer/0"),
    "tribal": ("Tribal", "OBJECTID", "NAME", "Tribal land", "https://tigerweb.geo.census.gov/arcgis/rest/services/TIGERweb/AIANNHA/MapServer/2"),
}
_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
#: An array that begins with two numbers is a position, however deep it stands.
_POSITION = r"\[\s*" + _NUMBER + r"\s*,\s*" + _NUMBER + r"\s*[,\]]"


def bounds(coordinates: Column) -> Column:
    """struct of the extent of coordinates in JSON, of any nesting, ragged or not, whatever their type is said to be;
    null without a position."""
    axis = lambda k: F.transform(F.regexp_extract_all(coordinates, F.lit(_POSITION), F.lit(k)), lambda x: x.cast("double"))
    lng, lat = axis(1), axis(2)
    return F.when(F.size(lng) > 0, F.struct(F.array_min(lat).alias("min_lat"), F.array_min(lng).alias("min_lng"), F.array_max(lat).alias("max_lat"), F.array_max(lng).alias("max_lng")))


def land_rows(pages: DataFrame, source: str) -> DataFrame:
    """Units with the bounds of their positions; without an id or a position there is no unit, and the last row of an id
    stays. The geometry is kept as GeoJSON."""
    agency, id_property, unit_property, unnamed, url = LAND_SOURCES[source]
    page = F.col("page") if "page" in pages.columns else F.monotonically_increasing_id()
    f = pages.select(page.alias("page"), F.posexplode("features").alias("place", "f")).select(F.struct("page", "place").alias("seq"), "f.properties", "f.geometry")
    f = f.withColumn("key", tx.property_of("properties", id_property)).where(F.coalesce("key", F.lit("")) != "")
    f = f.select("*", F.explode(F.array(bounds(F.col("geometry.coordinates")))).alias("b")).where("b IS NOT NULL")
    given = tx.property_of("properties", unit_property)
    unit = F.when(F.coalesce(given, F.lit("")) != "", F.regexp_replace(given, r"(?U)^\s+|\s+$", "")).otherwise(unnamed)
    shape = F.concat(F.lit('{"type":"'), "geometry.type", F.lit('","coordinates":'), "geometry.coordinates", F.lit("}"))
    rows = f.select("seq", F.concat(F.lit(f"{source}:"), "key").alias("id"), F.lit(agency).alias("agency"), unit.alias("unit"), "b.*", shape.alias("geojson"), F.lit(source).alias("source"), F.lit(url).alias("url"))
    return dedupe_last(rows, "id", "seq")


def vertices_of(geojson) -> Column:
    """All positions of GeoJSON text in order, as structs of lat and lng; a point is one vertex."""
    axis = lambda k: F.transform(F.regexp_extract_all(F.col(geojson), F.lit(_POSITION), F.lit(k)), lambda x: x.cast("double"))
    return F.zip_with(axis(2), axis(1), lambda lat, lng: F.struct(lat.alias("lat"), lng.alias("lng")))


def geometry(geojson) -> Column:
    """GeoJSON text as a VARIANT, whose parts are read by path whatever their nesting; null where it is no JSON."""
    return F.try_parse_json(geojson)


def union_bbox(regions: DataFrame, *group: str) -> DataFrame:
    """The box around all boxes of each group (of all rows without one); a null box counts for none, and no box at all
    gives nulls."""
    return regions.groupBy(*group).agg(F.min("min_lat").alias("min_lat"), F.min("min_lng").alias("min_lng"), F.max("max_lat").alias("max_lat"), F.max("max_lng").alias("max_lng"))


def genus_catalogue(taxa: DataFrame) -> DataFrame:
    """Genera of the catalogue from taxa in JSON (TAXA): the genus rank under the root, the last row of an id."""
    t = taxa.where((F.col("rank") == "genus") & F.exists(F.coalesce("ancestor_ids", F.array().cast("array<long>")), lambda a: a == ROOT_TAXON))
    return t.select(F.col("id").alias("taxon_id"), "name", F.col("preferred_common_name").alias("common_name"), "observations_count")


def bulk_scan(spark: SparkSession, path: str, width: int) -> DataFrame:
    """The archive's CSV member; rows of another width are dropped, which needs every column to be parsed."""
    names = {at: name for name, at in BULK_COLUMNS.items()}
    schema = ", ".join(f"{names.get(k, f'c{k}')} string" for k in range(width))
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").option("columnPruning", False).csv(path)


def bulk_lines(lines: DataFrame, column: str, width: int) -> DataFrame:
    """As bulk_scan, from a column of CSV lines; lines of another width are dropped."""
    names = {at: name for name, at in BULK_COLUMNS.items()}
    schema = ", ".join(f"{names.get(k, f'c{k}')} string" for k in range(width)) + ", bad string"
    read = F.from_csv(column, schema, {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"})
    rows = lines.select(F.explode(F.array(read)).alias("r")).select("r.*")  # parsed once, as in parsed()
    return rows.where("bad IS NULL").drop("bad")


def bulk_rows(scan: DataFrame, genera: DataFrame, country: str = "US") -> DataFrame:
    """Rows of a country with a place and a genus of the catalogue."""
    known = genera.groupBy(F.col("name").alias("genus")).agg(F.min("taxon_id").alias("taxon_id"))
    rows = scan.where((F.col("country") == country) & (F.coalesce("lat", F.lit("")) != "") & (F.coalesce("lng", F.lit("")) != "")).join(known, "genus")
    accuracy = F.col("accuracy").try_cast("int")
    return rows.select(F.col("id").try_cast("long").alias("id"), "taxon_id", F.col("lat").try_cast("double").alias("lat"), F.col("lng").try_cast("double").alias("lng"), tx.lenient_date("event_date").alias("observed_on"), accuracy.alias("positional_accuracy"), tx.obscured_by_accuracy(accuracy, *OBSCURED_ACCURACY).alias("obscured"))


def load_bulk(lines: DataFrame, url: str) -> DataFrame:
    """Observations from the lines that the bulk scan left (BULK_LINE); lines without a day are dropped. url: what stands
    before the id in a link."""
    accuracy = F.col("coordinate_uncertainty_m").try_cast("double").cast("int")
    day = tx.lenient_date("event_date")
    rows = lines.withColumn("observed_on", day).where("observed_on IS NOT NULL").withColumn("positional_accuracy", accuracy)
    return rows.select(
        F.col("inat_id").alias("id"), "taxon_id", "lat", "lng", "observed_on", F.month("observed_on").cast("short").alias("month"), F.lit("research").alias("quality_grade"), "positional_accuracy", F.lit(None).cast("string").alias("place_guess"),
        F.concat(F.lit(url), F.col("inat_id").cast("string")).alias("uri"), tx.obscured_by_accuracy("positional_accuracy", *OBSCURED_ACCURACY).alias("obscured"),
    )


def bulk_tallies(rows: DataFrame) -> DataFrame:
    """How many observations of each taxon were loaded, its last day, and the last day of all, to which the place counts
    as read."""
    own = rows.groupBy("taxon_id").agg(F.count("*").alias("loaded"), F.max("observed_on").alias("last_day"))
    return own.withColumn("end_date", F.max("last_day").over(Window.partitionBy()))  # a row for each genus


def ingest_tallies(rows: DataFrame) -> DataFrame:
    """One row: how many classified observations were scanned, how many are stored, and of how many genera."""
    kept = F.col("fate") == STORED
    by = rows.groupBy("fate", "taxon_id").agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("stored"), F.count_if(kept).alias("genera"))


def ingest_counts(rows: DataFrame) -> DataFrame:
    """How many classified observations of each genus are stored, and how many are left out for each reason."""
    return rows.groupBy("fate", F.when(F.col("fate") != NO_GENUS, F.col("taxon_id")).alias("taxon_id")).agg(F.count("*").alias("n"))


def dedupe_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by order: a struct maximum, combined on the map side."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")

"""Schemas of the stored tables and fixed settings."""

from __future__ import annotations

OBSERVATIONS = "id long, taxon_id long, lat double, lng double, observed_on date, month short, quality_grade string, positional_accuracy int, place_guess string, uri string, obscured boolean, revalidated_at timestamp"
INGEST_LOG = "key string, fetched_at timestamp, row_count long, lat double, lng double, radius_km double"
CAMPSITES = "id string, name string, kind string, fee string, free boolean, lat double, lng double, source string, url string"
PUBLIC_LAND = "id string, agency string, unit string, min_lat double, min_lng double, max_lat double, max_lng double, geojson string, source string, url string"
TRAILS = "id string, name string, kind string, min_lat double, min_lng double, max_lat double, max_lng double, center_lat double, center_lng double, geojson string, source string, url string"
GENERA = "taxon_id long, name string, common_name string, observations_count int"
LOCATIONS = "device_id string, name string, lat double, lng double, radius_km double"
PLACES = "region_id string, place_name string"
SELECTED = "device_id string, taxon_id long"

#: Fixed values.
EARTH_KM, KM_PER_DEGREE, LEAST_COS = 6371.0, 111.0, 0.01
ROOT_TAXON = 47170
OBSCURED_ACCURACY = (26000, 31000)
OPEN_LICENCES = ("cc0", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nc-sa")
HOME = (47.6062, -122.3321, 150.0)
CELL_DEGREES, RECENT_WEEKS = 0.25, 4
MOST_CIRCLES = 200

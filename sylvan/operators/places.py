"""Names to places and places to names, for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import col
from ..functions.text import parse_coordinates


def tokens(text) -> Column:
    """The distinct words of a text, lower-case, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def index(places: DataFrame) -> DataFrame:
    """The inverted index of places (place, name, weight and any others): a row for each of a name's words, with the whole row."""
    rows = places.withColumn("tokens", tokens("name"))
    return rows.select(F.explode("tokens").alias("token"), F.struct("place", "name", "weight", "tokens", *[c for c in places.columns if c not in ("place", "name", "weight")]).alias("row"))


def lookup(asked: DataFrame, indexed: DataFrame) -> DataFrame:
    """For each question (question, text) the place whose name holds all its words: that with the fewest other words, then the
    greatest weight, then the least id. No row where a word is in no name, or there is no word.

    Questions of the same words are one, and so are names, of which the first in that order stands for all. Such a question
    meets the names with its rarest word alone, so that neither copies nor frequent words are joined.
    """
    once = indexed.where(F.col("token") == F.get("row.tokens", F.lit(0))).select("row", F.array_sort("row.tokens").alias("words"), (-F.col("row.weight")).alias("light"))
    names = once.groupBy("words").agg(F.min_by("row", F.struct("light", F.col("row.place").alias("place"))).alias("row"))
    spread = names.select(F.explode("words").alias("token"), "words", "row")
    frequency = names.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("places"))
    asks = asked.select("question", F.array_sort(tokens("text")).alias("wanted"))
    words = asks.select("wanted").distinct().select("wanted", F.explode("wanted").alias("token")).join(frequency.hint("merge"), "token", "left")
    rare = words.groupBy("wanted").agg(F.bool_and(F.col("places").isNotNull()).alias("known"), F.min_by("token", F.struct("places", "token")).alias("token")).where("known")
    hits = rare.join(spread.hint("merge"), "token").where(F.size(F.array_except("wanted", "words")) == 0)
    order = F.struct(F.size("words").alias("words"), (-F.col("row.weight")).alias("light"), F.col("row.place").alias("place"))
    best = hits.groupBy("wanted").agg(F.min_by("row", order).alias("row"))
    return asks.join(best.hint("merge"), "wanted").select("question", "row.*").drop("tokens")


def resolve(asked: DataFrame, indexed: DataFrame) -> DataFrame:
    """question, name, lat, lng: of coordinates themselves, else of the place that the text names (places: lat, lng)."""
    at = asked.select("question", "text", F.explode(F.array(parse_coordinates("text"))).alias("at"))
    own = at.where("at IS NOT NULL").select("question", F.format_string("%.4f, %.4f", "at.lat", "at.lng").alias("name"), "at.lat", "at.lng")
    return own.unionByName(lookup(at.where("at IS NULL").select("question", "text"), indexed).select("question", "name", "lat", "lng"))

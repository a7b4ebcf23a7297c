"""Quality rules with thresholds learned from the corpus (DataFrame functions only).

Each document's word statistics are computed in one pass inside its own row, with no shuffle of text. KLL
sketches of the statistics are built for each (language, source), partly on the map side, so a source that holds
a third of the rows costs no more than any other. Sketches merge, and small groups borrow their language's.
The thresholds then join the statistics back, by size-checked broadcast or by a sort-merge join that splits skew.

A sketch of up to about 200 values is exact. A larger one errs by about 1 % of a group's ranks, by random bits of
the library, so that a document within that of a bound may get another verdict in another run.

Null text has no words and fails the base rule; very long texts are read whole. Equal values of a statistic are
judged alike. A null language or source is a group of its own. Each input row
gives one output row; repeated rows repeat. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, without_rows

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8


@dataclass(frozen=True)
class QualityRules:
    """min_rows: smaller groups use their language's sketch. outer: the share of a group below its lower and above its
    upper quantile. spread: tolerated distances between the middle quartiles beyond those. slack: least tolerance of
    each statistic, for the noise of short texts in groups whose quantiles coincide."""

    min_rows: int = 200
    outer: float = 0.1
    spread: float = 4.0
    slack: tuple[tuple[str, float], ...] = (("mean_word", 1.5), ("symbol_share", 0.02), ("dup_line_share", 0.05), ("repeat_share", 0.05), ("bare_share", 0.05), ("upper_share", 0.05))


def word_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    span = lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(WINDOW)])
    d = d.withColumn("windows", F.when(F.size("hashes") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), span)).otherwise(F.array().cast("array<bigint>")))
    d = d.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size(F.filter("words", lambda w: F.length(w) <= 1)).cast("long").alias("n_bare"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"),
    )
    same = lambda x, i: (F.get(F.col("sorted"), i - 1)["h"] == x["h"]) | (F.get(F.col("sorted"), i + 1)["h"] == x["h"])
    d = d.withColumn("starts", F.sort_array(F.transform(F.filter("sorted", same), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("n"))
    covered = F.when(F.col("starts").isNotNull(), F.aggregate("starts", start, step, lambda a: a["n"])).otherwise(0)
    return d.withColumn("n_repeat_words", covered.cast("long")).drop("sorted", "starts")


def _shares(stats: DataFrame) -> DataFrame:
    """The statistics that have bounds. One repeated line, and one window that occurs twice, are no evidence by themselves."""
    share = lambda a, b, free=0: F.when(F.col(b) > 0, F.greatest(F.lit(0), F.col(a) - free) / F.col(b)).otherwise(0.0)
    return stats.withColumns({
        "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines", 1),
        "repeat_share": share("n_repeat_words", "n_words", 2 * WINDOW), "bare_share": share("n_bare", "n_words"), "upper_share": share("n_upper", "word_chars"),
    })


def thresholds(stats: DataFrame, rules: QualityRules) -> DataFrame:
    """lang, source and the bounds of each statistic, from KLL sketches of the documents that pass the base rule."""
    names = [n for n, _ in rules.slack]
    groups = stats.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(n).alias(n) for n in names])
    langs = groups.groupBy("lang").agg(*[F.kll_merge_agg_double(n).alias(f"lang_{n}") for n in names]).withColumnRenamed("lang", "of")
    both = groups.join(langs, F.col("lang").eqNullSafe(F.col("of")))
    bounds = []
    for name, slack in rules.slack:
        sketch = F.when(F.col("n") >= rules.min_rows, F.col(name)).otherwise(F.col(f"lang_{name}"))
        low, q1, q3, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (rules.outer, 0.25, 0.75, 1 - rules.outer))
        reach = F.greatest(F.lit(slack), rules.spread * (q3 - q1))
        bounds += [(low - reach).alias(f"{name}_low"), (high + reach).alias(f"{name}_high")]
    return both.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *bounds)


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Counts, base_failed, the verdict `kept` and the statistics that broke a bound, one row per input row."""
    scratch = Scratch(docs.sparkSession, "quality")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = scratch.table(_shares(word_statistics(docs)).withColumn("base_failed", failed), "statistics")
    bounds = scratch.table(thresholds(stats, rules), "thresholds")
    joined = stats.join(bounds, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    broken = [F.when((F.col(n) < F.col(f"{n}_low")) | (F.col(n) > F.col(f"{n}_high")), F.lit(n)) for n, _ in rules.slack]
    joined = joined.withColumn("broken_rules", F.array_compact(F.array(*broken)))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("broken_rules") == 0)).alias("kept"), "broken_rules",
    )


def apply_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    return without_rows(docs, Scratch(docs.sparkSession, "bad"), lambda d: quality_rules(d, rules).where("NOT kept").select("doc_id"))

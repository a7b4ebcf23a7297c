"""Benchmark decontamination by a broadcast hash set of test n-grams (DataFrame functions only).

One scan hashes every window of a document's words, of all lengths that the items need, and probes the set inside
one stage; only one row per document and the windows that hit leave it. Those join the items' windows, where their
words are compared in full. The set is broadcast as 64-bit hashes alone while their count is within max_broadcast;
beyond that only (row, place, hash) are shuffled to it, and the words of the few hits are read again.

Each input row gives one output row, whatever its doc_id: null and repeated ids stay apart. Null text or no words:
n_words 0, no hit. Items without words are ignored. Windows shared by several items count for each. Empty tables
give no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, without_rows

N = 10
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD), "")


def _window_hash(hashes: Column, at: Column, size: Column, n: int) -> Column:
    """The hash of a window: of its length and its words' hashes."""
    return F.xxhash64(size, *[F.when(size > k, F.get(hashes, at + k)) for k in range(n)])


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """size, gram, item_id, hash: the distinct windows of each item."""
    b = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    b = b.withColumn("size", F.least(F.size("words"), F.lit(n))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    b = b.select("item_id", "size", "words", "hashes", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("at"))
    gram = F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ")
    return b.select("item_id", "size", gram.alias("gram"), _window_hash(F.col("hashes"), F.col("at"), F.col("size"), n).alias("hash")).distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, max_broadcast: int = 5_000_000) -> DataFrame:
    """doc_id, n_words, hits (array of start, end; null without any) and items (array) for every row of docs."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    grams = scratch.table(item_windows(benchmark, n), "grams")
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # n values at most
    known = grams.select("hash").distinct()
    few = known.count() <= max_broadcast  # 8 bytes each
    d = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("row", F.monotonically_increasing_id())
    if not few:
        d = scratch.table(d, "words")  # it is read twice, by the same row numbers
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # a window is its place times base plus its length; -1 stands for the document itself
    base, count = n + 1, F.size("words").cast("long")
    places = [F.when(count >= k, F.sequence(F.lit(k).cast("long"), base * (count - k) + k, F.lit(base).cast("long"))).otherwise(F.array().cast("array<long>")) for k in sizes]
    w = d.select("row", "doc_id", "words", "hashes", F.explode(F.concat(F.array(F.lit(-1).cast("long")), *places)).alias("code"))
    w = w.withColumn("at", F.floor(F.col("code") / base).cast("int")).withColumn("size", F.when(F.col("code") >= 0, (F.col("code") % base).cast("int")))
    w = w.withColumn("hash", F.when(F.col("code") >= 0, _window_hash(F.col("hashes"), F.col("at"), F.col("size"), n)))
    gram = F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ")
    if few:
        found = w.join(F.broadcast(known.withColumn("known", F.lit(True))), "hash", "left").where("code < 0 OR known")
        whole = F.when(F.col("code") < 0, F.size("words")).cast("long").alias("n_words")
        rows = scratch.table(found.select("row", "doc_id", whole, "at", "size", "hash", F.when(F.col("code") >= 0, gram).alias("gram")), "rows")
        all_docs, hits = rows.where("n_words IS NOT NULL").select("row", "doc_id", "n_words"), rows.where("n_words IS NULL").select("row", "at", "size", "hash", "gram")
    else:
        hits = scratch.table(w.where("code >= 0").select("row", "at", "size", "hash").join(known, "hash", "left_semi"), "hits")
        places = hits.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("at", "size", "hash")).alias("places"))
        hits = d.join(places, F.col("row") == F.col("of")).select("row", "words", F.inline("places")).select("row", "at", "size", "hash", gram.alias("gram"))
        all_docs = d.select("row", "doc_id", count.alias("n_words"))
    same = hits.join(grams.select("hash", "item_id", F.col("gram").alias("own"), F.col("size").alias("long")), "hash").where("gram = own AND size = long")
    span = F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"))
    same = same.groupBy(F.col("row").alias("of")).agg(F.collect_set(span).alias("hits"), F.collect_set("item_id").alias("items"))
    same = scratch.table(same, "found")
    return all_docs.join(same, F.col("row") == F.col("of"), "left").select("doc_id", "n_words", F.sort_array("hits").alias("hits"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, max_broadcast: int = 5_000_000) -> DataFrame:
    """Per row of docs: n_words, n_hit, the hit items and `contaminated`."""
    hits = find_hits(docs, benchmark, n, max_broadcast)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, h: F.struct(F.greatest(a["end"], h["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(a["end"], h["start"]))).alias("n"))
    hits = hits.withColumn("n_hit", F.coalesce(F.aggregate("hits", start, step, lambda a: a["n"]), F.lit(0)).cast("long"))
    hits = hits.withColumn("items", F.coalesce(F.array_sort(F.transform("items", lambda i: i.cast("string"))), F.array().cast("array<string>")))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """docs without the rows that hold any benchmark window; clean rows stay untouched."""
    return without_rows(docs, Scratch(docs.sparkSession, "contaminated"), lambda d: decontaminate(d, benchmark, n).where("contaminated").select("doc_id"))

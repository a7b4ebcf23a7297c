"""Near-duplicate documents: MinHash signatures in an LSH forest, exact verification, connected components.

1. A scan turns each whole text into its set of 5-word shingles and keeps a fingerprint, the set's size and a
   MinHash signature. Texts with equal sets meet by fingerprint in an aggregate with map-side combine, so thousands
   of copies become one representative.
2. LSH forest: each tree orders representatives by its own permutation of the signature. A range partition and sort
   lays out each order; neighbours that share `depth` leading values are candidates. Small regions give all their
   pairs. In a crowded region the depth adapts: it is divided by further values until the parts are small, and
   parts are linked through their first members and sorted neighbours, which joins most of it cheaply. All rows of
   a crowded region, and of one that reaches a task's first or last row, also take the exact way of step 4.
3. Candidates are verified on full shingle sets: first every document against its smallest candidate, then all
   pairs that this leaves in different components. Sets are read only for documents with candidates.
4. Documents of crowded regions are compared by a prefix-filter join, which loses no pair: each set is ordered from
   rare to common shingles, and two similar sets share one of their first. A shared shingle's places in both orders
   bound what the sets can share in all, and a pair is made only where that reaches the threshold. Only pairs of
   different components are made; a shingle whose documents are all in one component makes none, and a common one
   is spread over tasks.
5. Components follow from minimum labels with pointer jumping, one written table for each step. Later links are
   followed between the components that are there already, so a round costs what it joins.

Sets are compared as 64-bit shingle hashes. A pair at exactly the threshold, outside crowded regions, shares no
tree's first values with a chance of about 2e-5.

Null, empty or blank texts have no shingles and stay alone. Texts of fewer than 5 words are one shingle. Repeated
rows of a doc_id give one row each. A null doc_id stays alone, with a null component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, Scratch, batches_of_words, byte_table, mix, shingle_hashes, sliced, utf8, without_rows

HASHES, TREES, DEPTH, DEEPEST, CROWD = 64, 24, 3, 8, 8
PERCENT = 75
#: Two-bit samples of two signatures that agree in fewer places cannot come from a similar pair (5 standard deviations).
AGREE = 36
#: A list of ids up to this length is broadcast to pick the texts that need sets: 8 bytes each.
BROADCAST_IDS = 4_000_000
#: Rows of one region that a task holds at a time.
HELD = 20_000
#: Counters that tell rare shingles from common ones, 8 MB in all. Shingles that share a counter only make the join less sharp.
COUNTERS = 1 << 21
#: Rows of one shingle that a task of the prefix join compares with all others of that shingle.
SLICE = 2000
#: Pairs of one document that a task verifies: a document with more has its set copied to several tasks.
HUB = 500
#: Pairs for each document, on average, up to which all are verified at once: that moves no more sets than a first round may.
FEW = 1

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)
_ORDERS = np.stack([_rng.permutation(HASHES)[:DEEPEST] for _ in range(TREES)])
_TABLE = byte_table(WHITESPACE)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets: len(sets) x HASHES, 32 bits each."""
    joined = np.concatenate(sets)
    begin = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((joined * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[list, list[np.ndarray]]]:
    for keys, words in batches_of_words(batch.column(0).to_pylist(), utf8(batch.column(1)), _TABLE):
        yield keys, [np.unique(shingle_hashes(w)) for w in words]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        for keys, sets in _sets(batch):
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full)) if full else iter(())
            found = [(len(s), int(s.sum().astype(np.int64)), int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7)).astype(np.int64)), next(rows).tobytes()) if len(s) else (0, 0, 0, None) for s in sets]
            cols = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "signature"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """24 rows for each representative: its key in each order, and what the cheap tests need."""
    for batch in batches:
        ids, sizes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for at in range(0, len(ids), 2000):
            sig = np.frombuffer(b"".join(batch.column(2).slice(at, 2000).to_pylist()), np.uint32).reshape(-1, HASHES)
            two = (sig & 3).astype(np.uint8).reshape(-1, HASHES // 4, 4)
            sample = (two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6).astype(np.uint8)
            samples = [r.tobytes() for r in sample]
            for t in range(TREES):
                # a minimum over n shingles is near 2**32 / n: its leading bits say nothing about a long text
                keys = (mix(sig[:, _ORDERS[t]].astype(np.uint64)) >> np.uint64(48)).astype(">u2")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(ids[at : at + 2000]), pa.array(sizes[at : at + 2000].astype(np.int32)), pa.array(samples, pa.binary())], ["tree", "key", "doc_id", "n", "sample"])


def _region_pairs(ids: np.ndarray, lcp: np.ndarray, lo: int, hi: int, depth: int, out: list) -> int:
    """Append the pairs (row, row) of the sorted rows lo..hi, which share `depth` values; returns the pivot's row."""
    pivot = lo + int(np.argmin(ids[lo:hi]))
    if hi - lo <= CROWD:
        out += [(a, b) for b in range(lo + 1, hi) for a in range(lo, b)]
    elif depth < DEEPEST:
        cuts = [lo, *(np.flatnonzero(lcp[lo + 1 : hi] <= depth) + lo + 1).tolist(), hi]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = _region_pairs(ids, lcp, a, b, depth + 1, out)
            if own != pivot:
                out.append((pivot, own))
            if a > lo:
                out.append((a - 1, a))
    else:
        out += [(pivot, k) for k in range(lo, hi) if k != pivot]
        out += [(k, k + 1) for k in range(lo, hi - 1)]
    return pivot


def _alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, sample: np.ndarray) -> np.ndarray:
    near = 100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b])
    x = sample[a] ^ sample[b]
    differ = np.bitwise_count((x | x >> 1) & np.uint8(0x55)).sum(axis=1)
    return near & (HASHES - differ >= AGREE)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of rows sorted by (tree, key, doc_id), region by region; a region may cross batches.

    A pair (x, x) marks a row whose region is crowded or perhaps not whole here: its pairs are not all given.
    """
    held, first = None, True  # first: the held rows may go on a region whose begin is gone

    def pairs(rows, first, last=False):
        tree, key, ids, n, sample = rows
        lcp = np.zeros(len(ids), np.int64)
        same = key[1:] == key[:-1]
        lcp[1:] = np.where(tree[1:] == tree[:-1], np.where(same.all(axis=1), DEEPEST, np.argmin(same, axis=1)), 0)
        begin = np.append(np.flatnonzero(lcp < DEPTH), len(ids))
        out: list = []
        for k in np.flatnonzero(np.diff(begin) > 1):
            _region_pairs(ids, lcp, int(begin[k]), int(begin[k + 1]), DEPTH, out)
        open_ended = np.diff(begin) > CROWD
        open_ended[0] |= first
        open_ended[-1] |= last
        marked = ids[np.repeat(open_ended, np.diff(begin))]
        if not out and not len(marked):
            return None
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        ok = _alike(a, b, n, sample) & (ids[a] != ids[b])
        x, y = np.append(ids[a[ok]], marked), np.append(ids[b[ok]], marked)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [
            batch.column(0).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, DEEPEST),
            batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, HASHES // 4),
        ]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        # the last region may go on in the next batch
        tree, key = rows[0], rows[1]
        last = np.flatnonzero((tree != tree[-1]) | (key[:, :DEPTH] != key[-1, :DEPTH]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if len(tree) - cut > HELD:  # a region that is too large to hold: go on from its last row and its pivot
            if (found := pairs(rows, first)) is not None:
                yield found
            first = True
            keep = np.unique([cut + int(np.argmin(rows[2][cut:])), len(tree) - 1])
            held = [x[keep] for x in rows]
            continue
        if cut:
            if (found := pairs([x[:cut] for x in rows], first)) is not None:
                yield found
            first = False
        held = [x[cut:] for x in rows]
    if held is not None and (found := pairs(held, first, True)) is not None:
        yield found


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8")


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        for keys, sets in _sets(batch):
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = _unpacked(x), _unpacked(y)
            both = np.concatenate([p, q])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            linked.append(100 * common >= PERCENT * (len(p) + len(q) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets hold the shingles of each counter."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in sliced(batches):
        for packed in batch.column(0).to_pylist():
            np.add.at(counts, (_unpacked(packed) % COUNTERS).astype(np.int64), 1)
    used = np.flatnonzero(counts)
    for at in range(0, len(used), 1 << 16):
        k = used[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(counts[k])], ["counter", "sets"])


def prefixes(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The rarest shingles of a set, their places, and up to which place they do for pairs in which it is the smaller set.

    Similar sets x and y, y not the larger, share at least t|x| and at least 2t/(1+t) |y| shingles. So one of x's
    first |x| - t|x| + 1 is one of y's first |y| - 2t/(1+t) |y| + 1, in any order that is the same for all sets.
    """
    n = len(s)
    common = counts[(s % COUNTERS).astype(np.int64)]
    order = np.lexsort((s, common))[: n - -(-PERCENT * n // 100) + 1]
    shared = common[order] > 1
    return s[order][shared], np.flatnonzero(shared), n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1


def _prefix_rows(shared_counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared_counts.value
        for batch in sliced(batches):
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                sets = [_unpacked(b) for b in some.column(2).to_pylist()]
                found = [prefixes(s, counts) for s in sets]
                many = [len(p) for p, _, _ in found]
                spread = lambda x: np.repeat(np.asarray(x, np.int64), many)  # noqa: B023, E731
                place = np.concatenate([at for _, at, _ in found])
                cols = [np.concatenate([p for p, _, _ in found]).astype(np.int64), spread(some.column(0).to_pylist()), spread(some.column(1).to_pylist()), spread([len(s) for s in sets]), place]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], pa.array(place < spread([k for _, _, k in found]))], ["shingle", "doc_id", "label", "n", "place", "smaller"])

    return run


def prefix_pairs(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: every pair of similar sets with different labels, and a few others. sets: doc_id, label, shingles."""
    found = sets.select("shingles").mapInArrow(_counted, "counter int, sets long").groupBy("counter").agg(F.sum("sets").alias("sets")).toArrow()
    counts = np.zeros(COUNTERS, np.int32)
    counts[found.column(0).to_numpy()] = np.minimum(found.column(1).to_numpy(), 2**31 - 1)
    counts = sets.sparkSession.sparkContext.broadcast(counts)
    rows = scratch.table(sets.select("doc_id", "label", "shingles").mapInArrow(_prefix_rows(counts), "shingle long, doc_id long, label long, n long, place long, smaller boolean"), "prefixes")
    groups = rows.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("smaller").alias("any"), F.count("*").alias("rows"))
    groups = groups.where("lo <> hi AND any").select("shingle", F.ceil(F.col("rows") / SLICE).cast("int").alias("slices"))
    mixed = scratch.table(rows.join(groups, "shingle"), "mixed")
    one = mixed.where("smaller").select("shingle", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("doc_id").alias("y"), F.col("label").alias("q"), F.col("n").alias("m"), F.col("place").alias("o"))
    two = mixed.select("shingle", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int").alias("slice"), F.col("doc_id").alias("x"), F.col("label").alias("p"), "n", "place")
    size = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("x") > F.col("y")))
    # at their first common shingle, sets that share enough have enough left in both orders
    left = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("o"))
    enough = (100 + PERCENT) * left >= PERCENT * (F.col("n") + F.col("m"))
    both = one.join(two, ["shingle", "slice"]).where((F.col("p") != F.col("q")) & size & enough)
    out = scratch.table(both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("shared")).select("a", "b"), "pairs")
    scratch.drop(rows, mixed)
    return out


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, component: the least doc_id reachable over links (a, b), for the documents that have any."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc_id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["doc_id"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["doc_id"] == near["a"]).select("doc_id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("doc_id").alias("to"), F.col("component").alias("further"))
        step = step.join(jump, F.col("component") == F.col("to"), "left").select("doc_id", "was", F.least("component", F.coalesce("further", "component")).alias("component"))
        now = scratch.table(step, "labels")
        moved = now.where("was <> component").count()
        scratch.drop(labels)
        labels = now
        if not moved:
            out = labels.select("doc_id", "component")
            out.sylvan_path = labels.sylvan_path
            return out


def merged(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The labels of components after further links (a, b). Only components that a link joins are gone through again."""
    if labels is None:
        return components(links, scratch)
    one = labels.select(F.col("doc_id").alias("i"), F.col("component").alias("p"))
    two = labels.select(F.col("doc_id").alias("j"), F.col("component").alias("q"))
    ends = links.join(one, F.col("a") == F.col("i"), "left").join(two, F.col("b") == F.col("j"), "left")
    ends = scratch.table(ends.select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b")).where("a <> b"), "joined")
    if ends.isEmpty():
        scratch.drop(ends)
        return labels
    moved = components(ends, scratch)
    to = moved.select(F.col("doc_id").alias("of"), F.col("component").alias("now"))
    kept = labels.join(to, F.col("component") == F.col("of"), "left").select("doc_id", F.coalesce("now", "component").alias("component"))
    added = moved.join(labels.select(F.col("doc_id").alias("i")), F.col("doc_id") == F.col("i"), "left_anti").select("doc_id", "component")
    out = scratch.table(kept.unionByName(added), "labels")
    scratch.drop(ends, moved)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs. doc_id is an integer."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = scratch.table(texts.mapInArrow(_sketch, "doc_id long, n_shingles long, f1 long, f2 long, signature binary"), "sketches")
    full = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = scratch.table(full.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature")), "representatives")
    rows = reps.select("rep", "n_shingles", "signature").mapInArrow(_trees, "tree int, key binary, doc_id long, n int, sample binary")
    order = rows.repartitionByRange("tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
    found = order.mapInArrow(_neighbours, "a long, b long")
    seen = scratch.table(found.groupBy("a", "b").agg(F.count("*").alias("trees")).select("a", "b"), "candidates")
    left, crowded = seen.where("a <> b"), seen.where("a = b").select(F.col("a").alias("in_crowd"))
    ids = scratch.table(seen.select("a").union(seen.select("b")).distinct().withColumnRenamed("a", "want"), "wanted")
    many = ids.count()
    need = F.broadcast(ids) if many <= BROADCAST_IDS else ids
    wanted = texts.join(need, texts["doc_id"] == need["want"], "left_semi")
    sets = scratch.table(wanted.mapInArrow(_shingle_sets, "doc_id long, shingles binary"), "sets")
    labels, tried, spent = None, [], [seen, ids, sets]
    for stage in ("forest", "crowds"):
        if stage == "crowds":
            own = sets.join(crowded, sets["doc_id"] == crowded["in_crowd"], "left_semi")
            if labels is not None:
                of = labels.select(F.col("doc_id").alias("i"), "component")
                own = own.join(of, own["doc_id"] == of["i"], "left").select("doc_id", "shingles", F.coalesce("component", "doc_id").alias("label"))
            else:
                own = own.withColumn("label", F.col("doc_id"))
            spent.append(left := prefix_pairs(own, scratch))
            for t in tried:
                left = left.join(t.select("a", "b"), ["a", "b"], "left_anti")
        pairs, most = _counts(left)
        for last in (False, True) if pairs > FEW * many else (True,):
            if not pairs:
                break
            take = left if last else left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
            checked = scratch.table(_with_sets(take, sets, most > HUB).mapInArrow(_verify, "a long, b long, linked boolean"), "verified")
            tried.append(checked)
            new = checked.where("linked").select("a", "b")
            was, labels = labels, merged(labels, new, scratch)
            if was is not None and was is not labels:
                spent.append(was)
            if not last:
                spent.append(left := scratch.table(_apart(left.join(checked, ["a", "b"], "left_anti"), labels), "apart"))
                pairs, most = _counts(left)
    scratch.drop(*spent, *tried)
    whole = reps.select("n_shingles", "f1", "f2", "rep", "copies")
    if labels is not None:
        whole = whole.join(labels, whole["rep"] == labels["doc_id"], "left").select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("component"), "copies", F.col("component").isNotNull().alias("linked"))
    else:
        whole = whole.select("n_shingles", "f1", "f2", F.col("rep").alias("component"), "copies", F.lit(False).alias("linked"))
    whole = whole.where("copies > 1 OR linked").select(F.col("n_shingles").alias("k0"), F.col("f1").alias("k1"), F.col("f2").alias("k2"), "component")
    out = sketches.select("doc_id", "n_shingles", "f1", "f2").join(whole, F.col("doc_id").isNotNull() & (F.col("n_shingles") == F.col("k0")) & (F.col("f1") == F.col("k1")) & (F.col("f2") == F.col("k2")), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _counts(pairs: DataFrame) -> tuple[int, int]:
    """How many pairs there are, and how many the document a with most of them has."""
    total, most = pairs.groupBy("a").count().agg(F.sum("count"), F.max("count")).first()
    return total or 0, most or 0


def _with_sets(pairs: DataFrame, sets: DataFrame, hubs_possible: bool) -> DataFrame:
    """a, b and both sets. b's set travels with the pair to a; a document with very many pairs is copied over tasks."""
    one = sets.select(F.col("doc_id").alias("i"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("j"), F.col("shingles").alias("y"))
    if hubs_possible:
        hubs = pairs.groupBy("a").count().where(F.col("count") > HUB).select(F.col("a").alias("hub"), F.ceil(F.col("count") / HUB).cast("int").alias("slices"))
        slices = F.coalesce("slices", F.lit(1))
        pairs = pairs.join(hubs, F.col("a") == F.col("hub"), "left").select("a", "b", F.pmod(F.xxhash64("b"), slices).cast("int").alias("s"))
        one = one.join(hubs, F.col("i") == F.col("hub"), "left").select("i", "x", F.explode(F.sequence(F.lit(0), slices - 1)).alias("k"))
        return pairs.join(two, F.col("b") == F.col("j")).join(one, (F.col("a") == F.col("i")) & (F.col("s") == F.col("k"))).select("a", "b", "x", "y")
    return pairs.join(two, F.col("b") == F.col("j")).join(one, F.col("a") == F.col("i")).select("a", "b", "x", "y")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    one = labels.select(F.col("doc_id").alias("i"), F.col("component").alias("p"))
    two = labels.select(F.col("doc_id").alias("j"), F.col("component").alias("q"))
    both = pairs.join(one, F.col("a") == F.col("i"), "left").join(two, F.col("b") == F.col("j"), "left")
    return both.where(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near duplicates, that with the least doc_id.

    In a table with null or repeated ids, every row counts as a document of its own and the first row of a group
    stays, so repeated rows and copies without an id go as well. Texts without words all stay.
    """
    return without_rows(docs, Scratch(docs.sparkSession, "kept"), lambda d: near_duplicates(d).where("NOT kept").select("doc_id"))

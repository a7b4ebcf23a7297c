"""Repair of conversation structure by dynamic programming over grammar-compressed role and fault sequences.

A conversation is a sequence of symbols (role initial, fault). Each symbol is a min-plus transfer matrix between the
states of the pattern `(s?(ua)+)?`, whose entries hold the least cost and, as a rope, the ASCII-least cheapest edits.
A task replaces frequent pairs of the sequences it holds by rules (Re-Pair), multiplies one matrix for each rule from
the bottom up, and shares them, and whole sequences that occur again, among its conversations.

Conversations of at most long_rows rows and long_bytes of text come whole to a task. A longer one is sorted over many
tasks, cut into chunks whose matrices are computed apart, chained chunk by chunk, and rendered apart; only its hash, which
SHA-256 defines in order, streams through one task as ready chunks.

Nulls of any column count as one space, but a null turn comes first. Rows with equal turns are ordered by role and text.
Repeated rows are duplicates of each other. A conversation without rows after the damage has zeros, an empty audit and
the hash of nothing. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WS = " \t\n\x0b\x0c\r"
CLASSES, OK, BLANK, DUPLICATE, TRUNCATED = "sua?", 0, 1, 2, 3
#: States of the output: nothing yet, after system, after user, after assistant; the first and the last may end it.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NEXT_ROLE = ("user", "user", "assistant", "user")
SAME = {k: (0, "") for k in range(4)}
LEAF = 48
BLOCK_ROWS, BLOCK_BYTES, KEPT = 20_000, 8 << 20, 1 << 16
SCHEMA = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
MATRIX = "matrix array<struct<enter int, leave int, cost long, audit string>>"
CHUNK = "conv_id {id}, part long, seq long, symbols string, roles array<string>, texts array<string>, " + MATRIX

# ---------------------------------------------------------------- ropes and matrices
Rope = str | tuple  # a short text, or (left, right)


def join(a: Rope, b: Rope) -> Rope:
    if not a:
        return b
    if not b:
        return a
    return a + b if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= LEAF else (a, b)


def leaves(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += (top[1], top[0])


def less(a: Rope, b: Rope) -> bool:
    """a before b in ASCII order; shared parts are skipped, and unlike parts are opened only as far as they agree."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if not isinstance(x, str):
            left += (x[1], x[0])
            right.append(y)
        elif not isinstance(y, str):
            right += (y[1], y[0])
            left.append(x)
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x < y
            if x[n:]:
                left.append(x[n:])
            if y[n:]:
                right.append(y[n:])
    return not left and bool(right)


Matrix = dict[tuple[int, int], tuple[int, Rope]]


def _put(m: dict, key, cost: int, rope: Rope) -> None:
    old = m.get(key)
    if old is None or cost < old[0] or cost == old[0] and rope is not old[1] and less(rope, old[1]):
        m[key] = (cost, rope)


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost, rope) in a.items():
        for j in range(4):
            if more := b.get((k, j)):
                _put(out, (i, j), cost + more[0], join(rope, more[1]))
    return out


def advance(vector: dict[int, tuple[int, Rope]], m: Matrix) -> dict[int, tuple[int, Rope]]:
    out: dict = {}
    for (i, j), (cost, rope) in m.items():
        if i in vector:
            _put(out, j, vector[i][0] + cost, join(vector[i][1], rope))
    return out


def _inserts() -> Matrix:
    """Any number of inserted turns: the walk from one state to another by users and assistants in turn."""
    out = {}
    for start in range(4):
        state, n = start, 0
        while (start, state) not in out:
            out[start, state] = (2 * n, "I" * n)
            state, n = STEP[state, NEXT_ROLE[state][0]], n + 1
    return out


INSERTS = _inserts()


def symbol_matrix(symbol: int) -> Matrix:
    """Inserted turns, and then the edits of one row."""
    kind, fault = CLASSES[symbol // 4], symbol % 4
    row: Matrix = {(k, k): (3, "D") for k in range(4)}
    if fault in (OK, TRUNCATED):
        more = int(fault == TRUNCATED)
        for (state, initial), to in STEP.items():
            if initial == kind:
                _put(row, (state, to), more, "K")
            if initial != "s":
                _put(row, (state, to), 2 + more, "R")
    return product(INSERTS, row)


SYMBOLS = [symbol_matrix(k) for k in range(16)]


def close(vector: dict[int, tuple[int, Rope]]) -> tuple[int, int, int]:
    """(cost, state before, inserted turns) of the best end."""
    best: dict = {}
    for state in vector:
        for end in (0, 3):
            if more := INSERTS.get((state, end)):
                key = (vector[state][0] + more[0], join(vector[state][1], more[1]))
                if not best or key[0] < best["key"][0] or key[0] == best["key"][0] and less(key[1], best["key"][1]):
                    best = {"key": key, "state": state, "tail": len(more[1])}
    return best["key"][0], best["state"], best["tail"]


# ---------------------------------------------------------------- Re-Pair
def re_pair(sequences: list[str]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(rules, sequences in symbols and rules): the most frequent pair of neighbours becomes rule 16 + k, again and again.

    It ends where no pair occurs twice, or so rarely that counting anew costs more than the products that it spares.
    """
    lengths = [len(s) for s in sequences]
    data = np.full(sum(lengths) + len(sequences), -1, np.int64)
    data[np.repeat(np.arange(len(sequences)), lengths) + np.arange(sum(lengths))] = np.frombuffer("".join(sequences).encode(), np.uint8).astype(np.int64) - 65
    least, rules = max(2, len(data) // 1000), []
    while len(data) > 1:
        base = 16 + len(rules)
        both = (data[:-1] >= 0) & (data[1:] >= 0)
        keys, counts = np.unique(data[:-1][both] * base + data[1:][both], return_counts=True)
        if not len(keys) or counts.max() < least:
            break
        a, b = divmod(int(keys[counts.argmax()]), base)
        at = np.flatnonzero((data[:-1] == a) & (data[1:] == b))
        if a == b:  # in a run, every second place
            begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
            at = at[(at - at[begin]) % 2 == 0]
            if len(at) < least:
                break
        data[at] = base
        data = np.delete(data, at + 1)
        rules.append((a, b))
    ends = np.flatnonzero(data < 0)
    return rules, [part[part >= 0].tolist() for part in np.split(data, ends[:-1] + 1)]


def rule_matrices(rules: list[tuple[int, int]]) -> list[Matrix]:
    out = list(SYMBOLS)
    for a, b in rules:
        out.append(product(out[a], out[b]))
    return out


def cheapest(sequences: list[str]) -> dict[str, tuple[int, str]]:
    """(cost, audit) of each sequence of symbols."""
    found, (rules, short) = {}, re_pair(sequences)
    of = rule_matrices(rules)
    for sequence, symbols in zip(sequences, short, strict=True):
        vector = {0: SAME[0]}
        for s in symbols:
            vector = advance(vector, of[s])
        cost, state, tail = close(vector)
        found[sequence] = (cost, "".join(leaves(vector[state][1])) + "I" * tail)
    return found


def edited(roles: Iterable[str], texts: Iterable[str], audit: str, state: int = 0) -> Iterator[str]:
    """role:text of the repaired turns."""
    rows = iter(zip(roles, texts, strict=True))
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit != "D":
            if edit != "K":
                role = NEXT_ROLE[state]
            state = STEP[state, role[0]]
            yield f"{role}:{text}"


def _faults(symbols: str) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated, illegal."""
    codes = np.frombuffer(symbols.encode(), np.uint8).astype(np.int64) - 65
    by = np.bincount(codes % 4, minlength=4)
    kinds = codes // 4
    fine = ((kinds[:-1] == 0) | (kinds[:-1] == 2)) & (kinds[1:] == 1) | (kinds[:-1] == 1) & (kinds[1:] == 2)
    return int(by[BLANK]), int(by[DUPLICATE]), int(by[TRUNCATED]), int((~fine).sum()) if len(kinds) > 1 else 0


def symbol(role: str, fault: int) -> str:
    at = CLASSES.find(role[:1])
    return chr(65 + 4 * (at if 0 <= at < 3 and role else 3) + fault)


# ---------------------------------------------------------------- rows
def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, fault (blank, truncated or none) of the rows after damage; dropped rows stay as gone."""
    d = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % 20
    text = F.when(d < 2, "").when(d == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text"))
    rows = conversations.select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(_text("role")).alias("role"), text.alias("text"), (d == 0).alias("gone"),
        F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    end = F.right(F.rtrim("text", F.lit(WS)), F.lit(1))
    return rows.drop("copy").withColumn("fault", F.when(end == "", BLANK).when(end.isin(".", "!", "?"), OK).otherwise(TRUNCATED))


def _order() -> list[Column]:
    return [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, turn, role and text -> one row for each conversation."""
    known: dict[str, tuple[int, str]] = {}

    def out(block: list[tuple]) -> pa.RecordBatch:
        new = list({symbols for *_, symbols in block if symbols not in known})
        if len(known) + len(new) > KEPT:
            known.clear()
            new = list({symbols for *_, symbols in block})
        known.update(cheapest(new))
        rows = []
        for key, turns, roles, texts, symbols in block:
            (cost, audit), n = known[symbols], len(turns)
            gaps = int(turns.max() - turns.min()) + 1 - len(np.unique(turns)) if n else 0
            rows.append((key, gaps, *_faults(symbols), cost, audit, hashlib.sha256("\n".join(edited(roles, texts, audit)).encode()).hexdigest()))
        keys = pa.concat_arrays([r[0] for r in rows])
        return pa.RecordBatch.from_arrays([keys, *[pa.array(list(c)) for c in list(zip(*rows, strict=True))[1:]]], NAMES)

    block, held_rows, held_bytes = [], 0, 0
    for key, table in _runs(batches):
        table = table.filter(pc.invert(table["gone"]))
        roles, texts, seen, symbols = table["role"].to_pylist(), table["text"].to_pylist(), set(), []
        for role, text, fault in zip(roles, texts, table["fault"].to_pylist(), strict=True):
            again = (role, text) in seen
            seen.add((role, text))
            symbols.append(symbol(role, DUPLICATE if again and fault != BLANK else fault))
        turns = table["turn"].drop_null().to_numpy()
        block.append((key, turns, roles, texts, "".join(symbols)))
        held_rows += len(roles) + 1
        held_bytes += sum(map(len, texts))
        if held_rows >= BLOCK_ROWS or held_bytes >= BLOCK_BYTES:
            yield out(block)
            block, held_rows, held_bytes = [], 0, 0
    if block:
        yield out(block)


def _cuts(batch: pa.RecordBatch) -> np.ndarray:
    """Where column 0 changes, with both ends."""
    c = batch.column(0)
    if len(c) < 2:
        return np.array([0, len(c)])
    same = pc.fill_null(pc.equal(c[1:], c[:-1]), False)
    none = pc.and_(c[1:].is_null(), c[:-1].is_null())
    return np.concatenate([[0], np.flatnonzero(~pc.or_(same, none).to_numpy(zero_copy_only=False)) + 1, [len(c)]])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(begins a run of equal first columns, rows of that run), never across batches."""
    last = None
    for batch in batches:
        if batch.num_rows:
            cuts = _cuts(batch)
            for a, b in zip(cuts, cuts[1:], strict=False):
                piece = batch.slice(a, b - a)
                key = piece.column(0)[0].as_py()
                yield last is None or key != last[0], piece
                last = (key,)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Table]]:
    run: list[pa.RecordBatch] = []
    for begins, piece in _pieces(batches):
        if begins and run:
            yield run[0].column(0)[:1], pa.Table.from_batches(run)
            run = []
        run.append(piece)
    if run:
        yield run[0].column(0)[:1], pa.Table.from_batches(run)


# ---------------------------------------------------------------- long conversations
def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _chunks(schema: pa.Schema, chunk_rows: int, chunk_bytes: int):
    """Sorted rows with `again` and `n` equal copies -> chunks with their matrices. Rows that must go keep no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, key, symbols, roles, texts, held = TaskContext.get().partitionId(), 0, None, [], [], [], 0

        def out() -> pa.RecordBatch:
            text = "".join(symbols)
            rules, (short,) = re_pair([text])
            of = rule_matrices(rules)
            m = {(k, k): SAME[k] for k in range(4)}
            for s in short:
                m = product(m, of[s])
            matrix = [{"enter": i, "leave": j, "cost": cost, "audit": "".join(leaves(rope))} for (i, j), (cost, rope) in m.items()]
            return _batch([(key, part, seq, text, roles, texts, matrix)], schema)

        for begins, piece in _pieces(batches):
            if begins:
                if symbols:
                    yield out()
                    seq, symbols, roles, texts, held = seq + 1, [], [], [], 0
                key = piece.column(0)[0].as_py()
            for role, text, fault, again, n in zip(*[piece.column(c).to_pylist() for c in ("role", "text", "fault", "again", "n")], strict=True):
                for copy in range(n):
                    gone = fault == BLANK or again or copy > 0
                    symbols.append(symbol(role, BLANK if fault == BLANK else DUPLICATE if gone else fault))
                    roles.append("" if gone else role)
                    texts.append("" if gone else text)
                    held += len(texts[-1])
                    if len(symbols) >= chunk_rows or held >= chunk_bytes:
                        yield out()
                        seq, symbols, roles, texts, held = seq + 1, [], [], [], 0
        if symbols:
            yield out()

    return run


def _chain(schema: pa.Schema):
    """Chunk matrices in order -> the states in which each chunk begins and ends, and the turns inserted at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, back, places = {0: SAME[0]}, [], []

        def out() -> pa.RecordBatch:
            _, state, tail = close(vector)
            rows = []
            for (part, seq), came in zip(reversed(places), reversed(back), strict=True):
                rows.append((part, seq, came[state], state, tail))
                state, tail = came[state], 0
            return _batch(rows, schema)

        for begins, piece in _pieces(batches):
            if begins and places:
                yield out()
                vector, back, places = {0: SAME[0]}, [], []
            for part, seq, matrix in zip(*[piece.column(c).to_pylist() for c in ("part", "seq", "matrix")], strict=True):
                came, after = {}, {}
                for e in matrix:
                    if (i := e["enter"]) in vector:
                        was = after.get(e["leave"])
                        _put(after, e["leave"], vector[i][0] + e["cost"], join(vector[i][1], e["audit"]))
                        if after[e["leave"]] is not was:
                            came[e["leave"]] = i
                vector = after
                back.append(came)
                places.append((part, seq))
        if places:
            yield out()

    return run


def _render(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                best = next(e for e in r["matrix"] if (e["enter"], e["leave"]) == (r["enter"], r["leave"]))
                audit = best["audit"] + "I" * r["tail"]
                turns = list(edited(r["roles"], r["texts"], audit, r["enter"]))
                yield _batch([(r["conv_id"], r["part"], r["seq"], r["symbols"], best["cost"] + 2 * r["tail"], audit, len(turns), "\n".join(turns))], schema)

    return run


def _gather(schema: pa.Schema):
    """Rendered chunks in order -> one row for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, turns, faults, cost, audits, last, key = hashlib.sha256(), 0, np.zeros(4, np.int64), 0, [], "", None
        for begins, piece in _pieces(batches):
            if begins:
                if audits:
                    yield _batch([(key, *faults.tolist(), cost, "".join(audits), digest.hexdigest())], schema)
                digest, turns, faults, cost, audits, last, key = hashlib.sha256(), 0, np.zeros(4, np.int64), 0, [], "", piece.column(0)[0].as_py()
            for r in piece.to_pylist():
                faults += _faults(r["symbols"])
                faults[3] += _faults(last + r["symbols"][0])[3] if last else 0
                if r["turns"]:
                    digest.update((("\n" if turns else "") + r["body"]).encode())
                turns, cost, last = turns + r["turns"], cost + r["cost"], r["symbols"][-1]
                audits.append(r["audit"])
        if audits:
            yield _batch([(key, *faults.tolist(), cost, "".join(audits), digest.hexdigest())], schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _long(rows: DataFrame, ids: DataFrame, scratch: Scratch, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """The same result for conversations of any length; rows: damaged ones of the conversations in ids."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    lines = scratch.table(rows.where("NOT gone").groupBy("conv_id", "turn", "role", "text", "fault").agg(F.count("*").alias("n")), "lines")
    same = lines.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.count("*").alias("k"), F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("null_first")).where("k > 1").drop("k")
    known = lines.join(same, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")), "left")
    again = F.col("r").isNotNull() & ~F.when(F.col("null_first"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first"))
    schema = CHUNK.format(id=kind)
    parts = max(8, rows.sparkSession.sparkContext.defaultParallelism)
    ordered = known.select("conv_id", "turn", "role", "text", "fault", "n", again.alias("again")).repartitionByRange(parts, *_order()).sortWithinPartitions(*_order())
    chunks = scratch.table(ordered.mapInArrow(_chunks(_arrow(schema), chunk_rows, chunk_bytes), schema), "chunks")
    in_order = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    ways = "part long, seq long, enter int, leave int, tail int"
    states = in_order(chunks.select("conv_id", "part", "seq", "matrix")).mapInArrow(_chain(_arrow(ways)), ways)
    body = f"conv_id {kind}, part long, seq long, symbols string, cost long, audit string, turns long, body string"
    done = chunks.join(states, ["part", "seq"]).mapInArrow(_render(_arrow(body)), body)
    whole = f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    ends = in_order(done).mapInArrow(_gather(_arrow(whole)), whole)
    # distinct turns by partial rows, so that no task gathers the turns of a conversation
    turns = lines.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("c")).agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = ids.join(ends.withColumnRenamed("conv_id", "e"), F.col("long_id").eqNullSafe(F.col("e")), "left").join(turns, F.col("long_id").eqNullSafe(F.col("c")), "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return out.select(F.col("long_id").alias("conv_id"), *[zero(c) for c in NAMES[1:7]], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


def repair_conversations(conversations: DataFrame, long_rows: int = 20_000, long_bytes: int = 64 << 20, chunk_rows: int = 4096, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row for each conv_id of the table: faults, least cost, edits and hash of the repaired turns."""
    scratch, rows = Scratch(conversations.sparkSession, "conversations"), damaged(conversations)
    sizes = conversations.groupBy(F.col("conv_id").alias("long_id")).agg(F.count("*").alias("n"), F.sum(F.octet_length(_text("text"))).alias("size"))
    ids = scratch.table(sizes.where((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select("long_id"), "long")
    apart, on = not ids.isEmpty(), F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = rows.join(ids, on, "left_anti") if apart else rows
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = short.repartition("conv_id").sortWithinPartitions(*_order()).mapInArrow(_mend, SCHEMA.format(id=kind))
    return out.unionByName(_long(rows.join(ids, on, "left_semi"), ids, scratch, chunk_rows, chunk_bytes)) if apart else out

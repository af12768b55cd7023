"""Repair the turn structure of conversations at the least cost.

A repaired conversation has role initials ``(s?(ua)+)?``. Every row is kept (0), given the role
user or assistant (1) or deleted (2, the only choice for blank and repeated rows); an empty
user or assistant turn may be inserted anywhere (5); a truncated row that is not deleted
costs 5 more. An audit is the string of edits K, R, D, I in order; of the cheapest ones the
ASCII-least counts.

The turns are aligned (Wagner-Fischer) to the grammar's string of each feasible length. The
best alignment so far is the incumbent: lengths whose least possible cost is above it are
left out, and Ukkonen's band keeps only the diagonals a path of that cost can reach. The
tables hold costs of suffixes, so the ASCII-least audit of a length is traced from the front;
the audits of all lengths are then compared.

A conversation of more than PIECE_ROWS rows is aligned in pieces. Where a piece begins and
ends in the grammar is one of four states; each piece is aligned for all of them, and the
pieces are put together JOIN_PIECES at a time. Equally cheap audits of one piece have equally
many edits of each row, so the least audit is made of the pieces' least ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm import workers
from tabulon.session import materialise

PIECE_ROWS = 32
JOIN_PIECES = 32
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States of the grammar: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
_PATHS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("system", pa.bool_())]))
_PATHS_SQL = "array<struct<entry:int,exit:int,cost:bigint,audit:string,system:boolean>>"


# --- one piece ----------------------------------------------------------------------------


def _alignment(rows: str, faults: str, target: str, limit: int) -> tuple[int, str] | None:
    """Least cost and ASCII-least audit of aligning rows to one target, if at most ``limit``.

    ``rows`` are role initials; ``faults`` say per row b or d (delete it), t (truncated) or k.
    """
    n, size = len(rows), len(target)
    inserts = (limit - DELETE * (n - size)) // (DELETE + INSERT)
    deletes = inserts + n - size
    if inserts < 0 or deletes < 0:
        return None
    infinite = limit + 1
    # cost[i][j - i + deletes]: rows from i on against the target from j on, j - i in the band
    width = inserts + deletes + 1
    cost = [[infinite] * (width + 2) for _ in range(n + 2)]

    def turn(i, j):
        """Cost of keeping or renaming row i for place j; more than the limit if impossible."""
        if faults[i] in "bd":
            return infinite
        more = TRUNCATED if faults[i] == "t" else 0
        if rows[i] == target[j]:
            return more
        return infinite if target[j] == "s" else more + RETYPE

    for i in range(n, -1, -1):
        line, below = cost[i], cost[i + 1]
        for j in range(min(size, i + inserts), max(0, i - deletes) - 1, -1):
            d = j - i + deletes
            if i == n and j == size:
                line[d] = 0
                continue
            best = infinite
            if i < n:
                if d:
                    best = below[d - 1] + DELETE
                if j < size:
                    best = min(best, below[d] + turn(i, j))
            if j < size and target[j] != "s" and d + 1 < width:
                best = min(best, line[d + 1] + INSERT)
            line[d] = min(best, infinite)
    if cost[0][deletes] > limit:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < size:
        d = j - i + deletes
        left = cost[i][d]
        if i < n and d and cost[i + 1][d - 1] + DELETE == left:
            audit.append("D")
            i += 1
        elif j < size and target[j] != "s" and d + 1 < width and cost[i][d + 1] + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if rows[i] == target[j] else "R")
            i, j = i + 1, j + 1
    return cost[0][deletes], "".join(audit)


def _target(first: str, size: int) -> str:
    """The grammar's string of a length that begins with a turn of this kind."""
    body = "ua" * (size // 2 + 1)
    return ("s" + body if first == "s" else body if first == "u" else body[1:])[:size]


def _best(rows: str, faults: str, families: list[tuple[str, int, int]]) -> tuple[int, str, bool] | None:
    """Cheapest over the targets: (first turn, least size, step to the next size or 0 for none)."""
    families = [f for f in families if f[0] != "s" or "s" in rows]
    if not families:
        return None
    n, doomed = len(rows), sum(f in "bd" for f in faults)
    usable = n - doomed

    def least(size):
        return DELETE * doomed + (DELETE * (usable - size) if size <= usable else INSERT * (size - usable))

    # Deleting all rows and inserting a target is possible, but for a system turn that is kept.
    limit = DELETE * n + INSERT * (min(f[1] for f in families) + 1)
    top = usable + (limit - DELETE * doomed) // INSERT
    sizes = [(least(size), size, kind) for kind, low, step in families for size in (range(low, top + 1, step) if step else [low])]
    best = None
    for bound, size, kind in sorted(sizes):
        incumbent = limit if best is None else best[0]
        if bound > incumbent:
            break
        found = _alignment(rows, faults, _target(kind, size), incumbent)
        if found is not None and (best is None or found < best[:2]):
            best = (*found, kind == "s")
    return best


#: From a state to a state: the targets in between.
_BETWEEN = {
    (START, START): [("u", 0, 0)],
    (START, SYSTEM): [("s", 1, 0)],
    (START, USER): [("u", 1, 2), ("s", 2, 2)],
    (START, ASSISTANT): [("u", 2, 2), ("s", 3, 2)],
    (SYSTEM, SYSTEM): [("u", 0, 0)],
    (SYSTEM, USER): [("u", 1, 2)],
    (SYSTEM, ASSISTANT): [("u", 2, 2)],
    (USER, USER): [("a", 0, 2)],
    (USER, ASSISTANT): [("a", 1, 2)],
    (ASSISTANT, USER): [("u", 1, 2)],
    (ASSISTANT, ASSISTANT): [("u", 0, 2)],
}
_WHOLE = [("u", 0, 2), ("s", 3, 2)]


@lru_cache(maxsize=50_000)
def align_piece(rows: str, faults: str, first: bool, last: bool) -> tuple[tuple[int, int, int, str, bool], ...]:
    """(entry, exit, cost, audit, begins with a system turn) of the best alignment per pair of states.

    A whole conversation, first and last piece in one, has one, said to end in ASSISTANT.
    """
    if first and last:
        return ((START, ASSISTANT, *_best(rows, faults, _WHOLE)),)
    paths = []
    for (entry, leave), families in _BETWEEN.items():
        if (first and entry != START) or (last and leave not in (START, ASSISTANT)):
            continue
        found = _best(rows, faults, families)
        if found is not None:
            paths.append((entry, leave, *found))
    return tuple(paths)


def _illegal(rows: str) -> int:
    return sum(rows[i : i + 2] not in ("su", "ua", "au") for i in range(len(rows) - 1))


def _align_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c, piece, rows, faults, first, last = (batch.column(k).to_pylist() for k in range(6))
        paths = [
            [dict(zip(("entry", "exit", "cost", "audit", "system"), p, strict=True)) for p in align_piece(*args)]
            for args in zip(rows, faults, first, last, strict=True)
        ]
        yield pa.RecordBatch.from_arrays([
            pa.array(c, pa.int64()), pa.array(piece, pa.int64()), pa.array([_illegal(r) for r in rows], pa.int64()),
            pa.array([r[0] for r in rows], pa.string()), pa.array([r[-1] for r in rows], pa.string()), pa.array(paths, _PATHS),
        ], names=["c", "piece", "illegal", "head", "tail", "paths"])


def _join(left: list[dict], right: list[dict]) -> list[dict]:
    """Best paths through two adjacent stretches, per pair of states."""
    best: dict[tuple[int, int], tuple] = {}
    for a in left:
        for b in right:
            if a["exit"] != b["entry"]:
                continue
            key, cost = (a["entry"], b["exit"]), a["cost"] + b["cost"]
            held = best.get(key)
            if held is None or cost <= held[0]:
                path = (cost, a["audit"] + b["audit"], a["system"] or b["system"])
                if held is None or path < held:
                    best[key] = path
    return [{"entry": e, "exit": x, "cost": k, "audit": t, "system": s} for (e, x), (k, t, s) in best.items()]


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {name: [] for name in ("c", "piece", "illegal", "head", "tail", "paths")}
        for row in batch.to_pylist():
            held = None
            for part in row["parts"]:
                if held is None:
                    held = part
                    continue
                held = {
                    "illegal": held["illegal"] + part["illegal"] + _illegal(held["tail"] + part["head"]),
                    "head": held["head"], "tail": part["tail"], "paths": _join(held["paths"], part["paths"]),
                }
            out["c"].append(row["c"])
            out["piece"].append(row["piece"])
            for name in ("illegal", "head", "tail", "paths"):
                out[name].append(held[name])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), _PATHS]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


_PIECES_SQL = f"c long, piece long, illegal long, head string, tail string, paths {_PATHS_SQL}"


# --- tables -------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations``, some damaged, by crc32 of ``conv_id:turn`` modulo 20 (null: one space).

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role
    user. A null role or text is one space.
    """
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(True), copies)).alias("__copy"),
    ).drop("__copy")


def _narrow(rows: DataFrame) -> DataFrame:
    """What the repair must know of a row; the text itself stays behind."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    initial = F.substring(role, 1, 1)
    seen = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(seen == "", "b").when(F.substring(seen, -1, 1).isin(".", "!", "?"), "k").otherwise("t")
    return rows.select(
        "conv_id", F.col("turn"), role.alias("role"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        fault.alias("fault"), *_digest(text),
    )


def _digest(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.octet_length(text), text).alias("h2")]


def _placed(rows: DataFrame) -> DataFrame:
    """(c, pos, size, fault, ...) per row: its conversation's number, its place there and the rows in all.

    Rows are sorted in ranges, so a long conversation lies in several; the number of a row
    then follows from its place in the range and the sizes of the ranges before.
    """
    ordered = materialise(
        _narrow(rows).repartitionByRange("conv_id", "turn", "role", "h1", "h2").sortWithinPartitions("conv_id", "turn", "role", "h1", "h2")
        .withColumn("g", F.monotonically_increasing_id()).withColumn("part", F.shiftright("g", 33))
    )
    # One row per conversation and range; a window per conversation sees at most one per range.
    runs = ordered.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("start"))
    all_runs = Window.partitionBy("conv_id")
    earlier = all_runs.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("conv_id").alias("__conv"), F.col("part").alias("__part"), "start", F.min("start").over(all_runs).alias("c"),
        F.sum("n").over(all_runs).alias("size"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
    )
    first = ordered.groupBy("conv_id", "role", "h1", "h2").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("part") == F.col("__part"))
    repeated = F.col("first").isNull() & (F.col("fault") != "b")
    return materialise(
        ordered.join(runs, same).join(first, "g", "left").select(
            "c", (F.col("g") - F.col("start") + F.col("offset")).alias("pos"), "size", "conv_id", "turn", "role", "initial",
            F.when(repeated, "d").otherwise(F.col("fault")).alias("fault"), "h1", "h2",
        )
    )


def _audits(placed: DataFrame) -> DataFrame:
    """(c, illegal, cost, audit, system) per conversation."""
    number = F.floor(F.col("pos") / PIECE_ROWS)
    row = F.struct("pos", "initial", "fault")
    pieces = placed.groupBy("c", number.alias("piece"), "size").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    strings = pieces.select(
        "c", "piece", F.array_join("rows.initial", "").alias("initials"), F.array_join("rows.fault", "").alias("faults"),
        (F.col("piece") == 0).alias("first"), (F.col("piece") == F.floor((F.col("size") - 1) / PIECE_ROWS)).alias("last"),
    )
    made = materialise(strings.mapInArrow(_align_batches, _PIECES_SQL))
    most = made.agg(F.max("piece")).first()[0] or 0
    while most:  # each round joins up to JOIN_PIECES neighbours
        parts = F.sort_array(F.collect_list(F.struct("piece", "illegal", "head", "tail", "paths")))
        grouped = made.groupBy("c", F.floor(F.col("piece") / JOIN_PIECES).alias("__piece")).agg(parts.alias("parts"))
        made = materialise(grouped.select("c", F.col("__piece").alias("piece"), "parts").mapInArrow(_join_batches, _PIECES_SQL))
        most //= JOIN_PIECES
    ends = F.filter("paths", lambda p: (p["entry"] == START) & p["exit"].isin(START, ASSISTANT))
    best = F.array_min(F.transform(ends, lambda p: F.struct(p["cost"], p["audit"], p["system"])))
    return made.select("c", "illegal", best.alias("best")).select("c", "illegal", "best.cost", "best.audit", "best.system")


def _edit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that audits leave: (c, place, pos or null if inserted, new role or null if kept)."""
    names = ["c", "place", "pos", "role"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    out: list[list] = [[], [], [], []]

    def flush():
        made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)
        for v in out:
            v.clear()
        return made

    for batch in batches:
        for row in batch.to_pylist():
            pos, place = -1, 0
            for edit in row["audit"]:
                pos += edit != "I"
                if edit == "D":
                    continue
                role = "user" if place % 2 == row["system"] else "assistant"
                for v, x in zip(out, (row["c"], place, None if edit == "I" else pos, None if edit == "K" else role), strict=True):
                    v.append(x)
                place += 1
                if place % 10_000 == 0:
                    yield flush()
            if len(out[0]) >= 10_000:
                yield flush()
    yield flush()


@dataclass(frozen=True)
class Repair:
    """``audits``: one row per conversation that has rows: conv_id, c (a number of it), gaps, blank,
    duplicate, truncated, illegal, cost, audit. ``turns``: the repaired conversations: c, place,
    role, text."""

    audits: DataFrame
    turns: DataFrame


def repair_conversations(rows: DataFrame) -> Repair:
    """Count the faults of each conversation and repair it at the least cost; see the module's text.

    ``rows`` has conv_id and turn (any types that can be sorted; turn whole numbers), role and text; a null
    role or text counts as one space; other columns are not looked at. Within a conversation
    rows are taken by turn, nulls first; rows of one turn by role, then by a hash of the text.
    A null conv_id is a conversation. The first fault of a row counts: blank, duplicate (role
    and text seen earlier), truncated (the last character that is no blank is none of
    ``.!?``). An empty table gives empty results.
    """
    workers.prepare(rows.sparkSession)
    placed = _placed(rows.select("conv_id", "turn", "role", "text"))
    audits = materialise(_audits(placed))

    def counted(letter):
        return F.sum((F.col("fault") == letter).cast("long"))

    # Turns collapse first, so that no conversation's distinct turns meet unaggregated.
    per_turn = placed.groupBy("c", "conv_id", "turn").agg(counted("b").alias("b"), counted("d").alias("d"), counted("t").alias("t"))
    missing = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = per_turn.groupBy("c", "conv_id").agg(
        F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"), F.sum("b").alias("blank"), F.sum("d").alias("duplicate"),
        F.sum("t").alias("truncated"),
    )
    edits = audits.select("c", "audit", F.col("system").cast("int").alias("system")).mapInArrow(
        _edit_batches, "c long, place long, pos long, role string"
    )
    known = placed.select("c", "pos", "conv_id", F.col("role").alias("old"), "h1", "h2")
    kept = edits.where("pos IS NOT NULL").join(known, ["c", "pos"])
    # A kept row is the only one of its conversation with this role and text, so one text each will do.
    text = F.coalesce(F.col("text"), F.lit(" "))
    texts = rows.select(
        F.col("conv_id").alias("__conv"), F.coalesce(F.col("role"), F.lit(" ")).alias("__role"), *_digest(text), text.alias("text")
    ).groupBy("__conv", "__role", "h1", "h2").agg(F.first("text").alias("text"))
    same = (
        kept["conv_id"].eqNullSafe(texts["__conv"]) & (kept["old"] == texts["__role"])
        & (kept["h1"] == texts["h1"]) & (kept["h2"] == texts["h2"])
    )
    turns = kept.join(texts, same).select("c", "place", F.coalesce("role", "old").alias("role"), "text").unionByName(
        edits.where("pos IS NULL").select("c", "place", "role", F.lit("").alias("text"))
    )
    return Repair(counts.join(audits.drop("system"), "c").select("conv_id", "c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), turns)


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order; only the running hash is held."""
    current, running = None, None
    for batch in batches:
        done_c, done = [], []
        for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if c != current:
                if running is not None:
                    done_c.append(current)
                    done.append(running.hexdigest())
                current, running = c, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(done_c, pa.int64()), pa.array(done, pa.string())], names=["c", "sha"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([running.hexdigest()], pa.string())], names=["c", "sha"])


def repair_digests(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: fault counts, cost, audit and the repaired text's hash.

    A conversation without rows has zeros, an empty audit and the hash of the empty string.
    The hash of one conversation takes its lines one after the other, as SHA-256 must; they
    stream through a task that holds none of them.
    """
    made = repair_conversations(rows)
    lines = made.turns.select("c", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    hashed = lines.repartition("c").sortWithinPartitions("c", "place").select("c", "line").mapInArrow(_hash_batches, "c long, sha string")
    found = made.audits.withColumnRenamed("conv_id", "__conv").join(hashed, "c", "left")
    every = conversations.select("conv_id").distinct()
    zero = F.lit(0).cast("long")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").select(
        "conv_id", *[F.coalesce(name, zero).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )

"""Conversation repair against a state machine that knows no target lengths."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tabulon.llm import conversation_repair as cr
from tabulon.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = (("user", "u"), ("assistant", "a"))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        repeated = (role, text) in seen
        seen.add((role, text))
        out.append("b" if not shown else "d" if repeated else "k" if shown[-1] in ".!?" else "t")
    return "".join(out)


def initials(rows):
    return "".join(r[2][:1] if r[2][:1] in tuple("sua") else "x" for r in rows)


def cheapest(rows):
    """(cost, audit, lines) over all paths through the grammar's states."""
    def put(states, state, path):
        if state not in states or path[:2] < states[state][:2]:
            states[state] = path

    def with_inserts(states):
        for _ in range(4):
            for state, (cost, audit, lines) in list(states.items()):
                for role, letter in ROLES:
                    if (state, letter) in NEXT:
                        put(states, NEXT[state, letter], (cost + 5, audit + "I", [*lines, f"{role}:"]))
        return states

    states = with_inserts({0: (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults(rows)):
        after = {}
        for state, (cost, audit, lines) in states.items():
            put(after, state, (cost + 2, audit + "D", lines))
            if fault in "bd":
                continue
            more = 5 if fault == "t" else 0
            if (state, role[:1]) in NEXT:
                put(after, NEXT[state, role[:1]], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for new, letter in ROLES:
                if (state, letter) in NEXT and letter != role[:1]:
                    put(after, NEXT[state, letter], (cost + more + 1, audit + "R", [*lines, f"{new}:{text}"]))
        states = with_inserts(after)
    return min((states[s] for s in (0, 3) if s in states), key=lambda path: path[:2])


def damaged(rows):
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def expected(rows):
    """The query's result by conversation; rows of one turn must have one role and text."""
    groups = defaultdict(list)
    for row in damaged(rows):
        groups[row[0]].append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        held = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1], r[2]))
        turns, letters, found = {r[1] for r in held} - {None}, initials(held), faults(held)
        illegal = sum(letters[i : i + 2] not in ("su", "ua", "au") for i in range(len(letters) - 1))
        cost, audit, lines = cheapest(held)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("b"), found.count("d"), found.count("t"),
            illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def conversation(rng, conv, n):
    texts = ["one.", "two!", "three", "", " \t", "four?", "é…"]
    return [
        (conv, k * rng.choice([1, 1, 2]) + 100 * k, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]),
         rng.choice([*texts, f"own {k}.", f"own {k}", f"said {k}!"])) for k in range(n)
    ]


def result(df):
    return {
        r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
        for r in df.collect()
    }


def test_alignment_and_pieces_equal_the_state_machine():
    rng = random.Random(5)
    names = ("entry", "exit", "cost", "audit", "system")
    for _ in range(400):
        rows = conversation(rng, 1, rng.randint(1, 14))
        letters, found, want = initials(rows), faults(rows), cheapest(rows)[:2]
        assert cr.align_piece(letters, found, True, True)[0][2:4] == want
        cut, held = rng.randint(1, 5), None
        for i in range(0, len(rows), cut):
            paths = cr.align_piece(letters[i : i + cut], found[i : i + cut], i == 0, i + cut >= len(rows))
            made = [dict(zip(names, p)) for p in paths]
            held = made if held is None else cr._join(held, made)
        assert min((p["cost"], p["audit"]) for p in held if p["entry"] == 0 and p["exit"] in (0, 3)) == want


def test_band_keeps_the_best_path():
    rng = random.Random(6)
    for _ in range(200):
        letters = "".join(rng.choice("suax") for _ in range(rng.randint(0, 9)))
        found = "".join(rng.choice("kkktbd") for _ in letters)
        target = cr._target(rng.choice("sua"), rng.randint(0, 9))
        wide = cr._alignment(letters, found, target, 500)
        if wide is not None:
            assert cr._alignment(letters, found, target, wide[0]) == wide
            assert cr._alignment(letters, found, target, wide[0] - 1) is None


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_repair_query(spark, monkeypatch, partitions):
    rng = random.Random(int(partitions))
    rows = [r for conv in range(30) for r in conversation(rng, conv, rng.randint(1, 9))]
    rows += conversation(rng, 77, 150)  # several pieces, in several ranges of the sort
    rows += [(None, None, "user", "a."), (None, 3, None, None), (None, 4, "assistant", "b."), (91, None, "user", None), (92, 1, None, "x" * 100_000)]
    rows += [(93, 5, "user", "same."), (93, 5, "user", "same."), (93, 6, "assistant", "y.")] * 3
    rng.shuffle(rows)
    monkeypatch.setattr(cr, "JOIN_PIECES", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, 0, "z") for r in rows], SCHEMA + ", pos int, c string")
        got = result(cr.repair_digests(cr.damage(df), df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == expected(rows)


def test_repaired_turns_are_whole_texts(spark):
    rows = [(1, 0, "user", "Hi there."), (1, 1, "user", "And you?"), (1, 2, "system", "Late.")]
    made = cr.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    turns = [(r["role"], r["text"]) for r in made.turns.orderBy("place").collect()]
    cost, audit, lines = cheapest([(1, 0, "user", "Hi there."), (1, 1, "user", "And you?"), (1, 2, "system", "Late.")])
    assert [f"{role}:{text}" for role, text in turns] == lines
    assert [(r["cost"], r["audit"]) for r in made.audits.collect()] == [(cost, audit)]


def test_rows_of_one_turn_have_one_order(spark):
    rows = [(1, 2, "user", f"text {k}.") for k in range(6)]
    one = result(cr.repair_digests(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA)))
    other = result(cr.repair_digests(spark.createDataFrame(rows[::-1], SCHEMA), spark.createDataFrame(rows, SCHEMA)))
    assert one == other


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair_digests(cr.damage(empty), empty).collect() == []
    alone = spark.createDataFrame([(5, 1, "user", "a.")], SCHEMA)
    nothing = hashlib.sha256(b"").hexdigest()
    assert result(cr.repair_digests(empty, alone)) == {5: (0, 0, 0, 0, 0, 0, "", nothing)}


def test_repair_query_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op11_conversation_repair(spark, folder)) == expected(rows)

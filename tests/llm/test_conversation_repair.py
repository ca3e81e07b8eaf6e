import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest

from finquarry.llm import queries
from finquarry.llm.conversation_repair import damage, repair_query, repair_report, repaired_turns

ROWS = "conv_id long, turn long, role string, text string, k string, code int"
LEGAL = re.compile(r"\A(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\f\r"


def best(rows):
    """Cheapest, then ASCII-least edits of one conversation, by trying all of them with at most one insert before a row and two at the end."""
    seen, faults = set(), []
    for role, text in rows:
        blank = not text.strip(SPACE)
        faults.append("b" if blank else "d" if (role, text) in seen else "t" if text.rstrip(SPACE)[-1] not in ".!?" else "")
        seen.add((role, text))
    options = []
    for (role, text), f in zip(rows, faults):
        one = [(2, "D", [])]
        if f not in ("b", "d"):
            extra = 5 * (f == "t")
            one += [(extra, "K", [(role, text)]), (1 + extra, "R", [("user", text)]), (1 + extra, "R", [("assistant", text)])]
        options.append(one)
    inserts = [[(5 * n, "I" * n, [(r, "") for r in who]) for n in range(most + 1) for who in itertools.product(("user", "assistant"), repeat=n)] for most in (1, 2)]
    found = []
    for parts in itertools.product(*itertools.chain.from_iterable((inserts[0], o) for o in options), inserts[1]):
        made = [x for p in parts for x in p[2]]
        if LEGAL.match("".join(r[:1] for r, _ in made)) and all(r for r, _ in made):
            found.append((sum(p[0] for p in parts), "".join(p[1] for p in parts), made))
    cost, audit, made = min(found)
    return faults, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(), made


def test_small_conversations_against_all_edits(spark):
    rng = random.Random(5)
    convs = {c: [(t, rng.choice(["user", "assistant", "system", "tool", "", "user"]), rng.choice(["Yes.", "No", " \t", "", "So? ", "é!", "Well"])) for t in range(rng.randint(1, 3))] for c in range(150)}
    df = spark.createDataFrame([(c, t, r, x, "clash", 1) for c, rows in convs.items() for t, r, x in rows], ROWS)
    got = {r.conv_id: r for r in repair_report(df).collect()}
    turns = {c: [] for c in convs}
    for r in repaired_turns(df).orderBy("conv_id", "place").collect():
        assert r.place == len(turns[r.conv_id])
        turns[r.conv_id].append((r.role, r.text))
    for c, rows in convs.items():
        faults, cost, audit, sha, made = best([(r, x) for _, r, x in rows])
        have = got[c]
        assert (have.blank, have.duplicate, have.truncated) == tuple(faults.count(f) for f in "bdt")
        assert (have.cost, have.audit, have.repaired_sha256) == (cost, audit, sha), (rows, have)
        assert turns[c] == made


def odd_rows():
    big = 2**53 + 1
    rng = random.Random(3)
    rows = [(None, t, "user", f"Null {t}.") for t in range(4)] + [(big, 0, "user", "Hi."), (big, 1, "assistant", "Ho."), (big + 2, None, None, None), (big + 2, 5, "user", "A.")]
    rows += [(9, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}" + "." * (t % 3 > 0)) for t in range(900)]  # a giant one
    rows += [(c, t, rng.choice(["user", "assistant", "system", "Tool"]), rng.choice(["One.", "Two", "", "Three!  ", "x" * 3000 + "."])) for c in range(100, 260) for t in range(rng.randint(1, 9))]
    rows += [(300 + c, 0, "user", "Only.") for c in range(300)]  # some lose their only row
    rows += [(9, 3, "assistant", "Turn 3")] * 2  # repeated rows
    return rows


def test_damaged_odd_conversations_equal_their_twin(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], ROWS)
    got = repair_query(df)
    duck = duckdb.connect()
    conversations = pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "role": pa.array([r[2] for r in rows], pa.string()), "text": pa.array([r[3] for r in rows], pa.string())})
    duck.register("conversations", conversations)
    twin = duck.sql(queries.OP12_SQL)
    have = sorted(map(tuple, got.select(*twin.columns).collect()), key=str)
    assert have == sorted(twin.fetchall(), key=str)
    lost = [r for r in got.collect() if r.audit == "" and r.conv_id and 300 <= r.conv_id < 600]
    assert lost and all(r.repaired_sha256 == hashlib.sha256(b"").hexdigest() and r.cost == 0 for r in lost)


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. b!") for c in range(30) for t in range(10)]
    got = {}
    for r in damage(spark.createDataFrame([(*r, "x", 0) for r in rows], ROWS)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        d = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = {0: [], 1: [(role, "")], 2: [(role, "A b")], 3: [(role, text)] * 2, 4: [("user", text)]}.get(d, [(role, text)])
        assert got.get((c, t), []) == want


@pytest.mark.parametrize("schema", [ROWS, "conv_id string, turn int, role string, text string"])
def test_empty_tables(spark, schema):
    assert repair_query(spark.createDataFrame([], schema)).collect() == []
    assert repaired_turns(spark.createDataFrame([], schema)).collect() == []

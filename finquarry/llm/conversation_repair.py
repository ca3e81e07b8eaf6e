"""Repair of conversations at least cost: a dynamic programme over turns, streamed through sorted partitions.

A repaired conversation's roles read system at most once and first, then user and assistant by turns, ending with an
assistant; the empty conversation is one too. Both passes carry a state of constant size across Arrow batches. The
first reads a conversation from its last turn and gives each row a compact code, the best edit from each state; the codes
leave through Spark's shuffle, which spills them, so a giant conversation takes no memory. The second replays them.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finquarry.llm.common import fresh

#: White space and sentence ends of the contract; costs of edits; faults in the order they are looked for.
SPACE, ENDS = " \t\n\x0b\f\r", ".!?"
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after system, after user, after assistant. From each, the state that user or assistant leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT, ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
#: Inserts that end a conversation well, by state.
CLOSING = (0, 2, 1, 0)
#: Edits of one row: inserts before it (none or one), then its letter. More inserts lead back to a state or cost more.
EDITS = tuple("I" * k + c for k in (0, 1) for c in "DKR")
#: Neighbours that may follow each other.
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_FAR = 1 << 60


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults planted by crc32("conv:turn") % 20 (nulls written as one space): 0 drops the row, 1 empties its
    text, 2 takes out its sentence ends, 3 repeats it, 4 makes it the user's. Null roles and texts become one space."""
    blank = F.lit(" ")
    part = fresh(rows.columns, "_part")
    d = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank)).cast("binary")) % 20
    out = rows.withColumn(part, d).filter(F.col(part) != 0)
    said = F.coalesce(F.col(text), blank)
    said = F.when(F.col(part) == 1, "").when(F.col(part) == 2, F.translate(said, ENDS, "")).otherwise(said)
    out = out.withColumns({text: said, role: F.when(F.col(part) == 4, "user").otherwise(F.coalesce(F.col(role), blank))})
    twice = F.when(F.col(part) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn(part, F.explode(twice)).drop(part)


def best_edits(ahead: tuple[int, int, int, int], initial: str, fault: int) -> tuple[tuple[int, int, int, int], int]:
    """Costs to go before a row, from those after it, and the row's code: three bits a state, an index into EDITS.

    Of equal costs the ASCII-least edits hold. From one state no edit's letters begin another's, so these decide.
    """
    costs, code = [], 0
    for state in range(4):
        found = []
        for k, edit in enumerate(EDITS):
            at, cost = (NEXT[state], INSERT) if len(edit) == 2 else (state, 0)
            if edit[-1] == "D":
                found.append((cost + DELETE + ahead[at], edit, k))
            elif fault not in (BLANK, DUPLICATE):
                to = step(at, initial) if edit[-1] == "K" else NEXT[at]
                if to is not None:
                    found.append((cost + (edit[-1] == "R") * REROLE + (fault == TRUNCATED) * CUT_OFF + ahead[to], edit, k))
        cost, _, k = min(found)
        costs.append(min(cost, _FAR))
        code |= k << (3 * state)
    return tuple(costs), code


def step(state: int, initial: str) -> int | None:
    """The state after a kept role's initial; None if it may not come here."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial and initial == ROLE[state][0] else None


class Codes:
    """Codes of rows read from the last to the first. Costs matter by their differences alone, and these take few values,
    so each step is a look-up in a table that fills as it goes."""

    END = tuple(n * INSERT for n in CLOSING)

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    def batches(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, ahead = None, self.END
        for pdf in frames:
            codes = []
            for k, initial, fault in zip(pdf["k"], pdf["initial"], pdf["fault"], strict=True):
                if k != conv:
                    conv, ahead = k, self.END
                found = self.known.get((ahead, initial, fault))
                if found is None:
                    costs, code = best_edits(ahead, initial, fault)
                    found = self.known[ahead, initial, fault] = tuple(c - min(costs) for c in costs), code
                ahead, code = found
                codes.append(code)
            yield pdf.drop(columns="initial").assign(code=codes)


class Conversation:
    """Replays codes over one conversation's rows in order; keeps counts, the edits and a running hash."""

    def __init__(self):
        self.state, self.place, self.cost, self.letters = START, 0, 0, []
        self.faults, self.illegal, self.before = [0] * 4, 0, None
        self.first = self.last = None
        self.turns = 0
        self.sha = hashlib.sha256()

    def emit(self, role: str, text: str) -> tuple[int, str, str]:
        self.sha.update(("\n" * (self.place > 0) + f"{role}:{text}").encode())
        self.place += 1
        return self.place - 1, role, text

    def insert(self) -> tuple[int, str, str]:
        role = ROLE[self.state]
        self.state, self.cost = NEXT[self.state], self.cost + INSERT
        self.letters.append("I")
        return self.emit(role, "")

    def row(self, turn: int | None, role: str, text: str, fault: int, code: int) -> list[tuple[int, str, str]]:
        """What the repaired conversation gets for a row."""
        if self.before is not None and (self.before, role[:1]) not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        self.faults[fault] += 1
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        edit, out = EDITS[code >> (3 * self.state) & 7], []
        if len(edit) == 2:
            out.append(self.insert())
        self.letters.append(edit[-1])
        if edit[-1] == "D":
            self.cost += DELETE
            return out
        self.cost += (fault == TRUNCATED) * CUT_OFF
        if edit[-1] == "R":
            self.cost, role = self.cost + REROLE, ROLE[self.state]
        self.state = step(self.state, role[:1])
        return [*out, self.emit(role, text)]

    def close(self) -> list[tuple[int, str, str]]:
        return [self.insert() for _ in range(CLOSING[self.state])]

    def report(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.letters), self.sha.hexdigest()


def _replay(frames: Iterator[pd.DataFrame], turns: bool) -> Iterator[pd.DataFrame]:
    """Repaired turns, or one report a conversation. Rows of a conversation follow each other, its marker first, and of
    rows that are alike their codes before themselves."""
    conv, now, codes = None, None, deque()
    columns = ["k", "place", "role", "text"] if turns else ["k", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def closed() -> list[tuple]:
        last = [(conv, *x) for x in now.close()]
        return last if turns else [(conv, *now.report())]

    for pdf in frames:
        out = []
        for k, kind, known, turn, role, text, fault, code in zip(*(pdf[c] for c in ("k", "kind", "known", "turn", "role", "text", "fault", "code")), strict=True):
            if kind == 0:
                if now is not None:
                    out += closed()
                conv, now = k, Conversation()
            elif kind == 1:
                codes.append((fault, code))
            else:
                made = now.row(turn if known else None, role, text, *codes.popleft())
                if turns:
                    out += [(conv, *x) for x in made]
        if out:
            yield pd.DataFrame(out, columns=columns)
    if now is not None:
        yield pd.DataFrame(closed(), columns=columns)


_TURNS = "k string, place long, role string, text string"
_REPORT = "k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _streamed(rows: DataFrame, ids: DataFrame, conv: str, turn: str, role: str, text: str, turns: bool) -> DataFrame:
    """Faults natively, codes from the last turn back, then the replay. Only the replay's shuffle carries texts."""
    name = lambda df: F.coalesce(F.concat(F.lit("="), df[conv].cast("string")), F.lit(""))
    said, who, t = F.coalesce(rows[text], F.lit(" ")), F.coalesce(rows[role], F.lit(" ")), rows[turn].cast("long")
    alike = F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256))
    full = rows.select(name(rows).alias("k"), t.isNotNull().alias("known"), F.coalesce(t, F.lit(0)).alias("turn"), alike.alias("alike"), who.alias("role"), said.alias("text"))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.coalesce(F.regexp_extract("role", "^[sua]", 0), F.lit(""))  # all others are alike: they can't be kept
    slim = full.select("k", "known", "turn", "alike", initial.alias("initial"), (trimmed == "").alias("blank"), F.right(trimmed, F.lit(1)).isin(*ENDS).alias("ended"))
    again = F.row_number().over(Window.partitionBy("k", "alike").orderBy("known", "turn"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("n") > 1, DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(SOUND)
    slim = slim.withColumn("n", again).withColumn("fault", fault).select("k", "known", "turn", "alike", "n", "initial", "fault")
    down = slim.repartition("k").sortWithinPartitions("k", F.desc("known"), F.desc("turn"), F.desc("alike"), F.desc("n"))
    codes = down.mapInPandas(lambda frames: Codes().batches(frames), "k string, known boolean, turn long, alike binary, n int, fault int, code int")

    marks = ids.select(name(ids).alias("k")).distinct().select("k", F.lit(0).alias("kind"), F.lit(False).alias("known"), F.lit(0).cast("long").alias("turn"))
    both = marks.unionByName(codes.withColumn("kind", F.lit(1)), True).unionByName(full.withColumn("kind", F.lit(2)), True)
    none = {"n": F.coalesce("n", F.lit(0)), "fault": F.coalesce("fault", F.lit(0)), "code": F.coalesce("code", F.lit(0))}  # no nulls: ints stay ints
    up = both.withColumns(none).withColumn("mark", F.col("kind") > 0).repartition("k").sortWithinPartitions("k", "mark", "known", "turn", "alike", "kind", "n")
    up = up.select("k", "kind", "known", "turn", "role", "text", "fault", "code")
    out = up.mapInPandas(lambda frames: _replay(frames, turns), _TURNS if turns else _REPORT)
    back = F.when(F.col("k") != "", F.substr("k", F.lit(2))).cast(ids.schema[conv].dataType).alias(conv)
    return out.select(back, *out.columns[1:])


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn of every repaired conversation: conv, place long (gapless from 0), role, text; empty if inserted.

    Rows are taken by turn, nulls first; those of one turn by a hash of role and text. Null roles and texts are one
    space, so null texts are blank. Null ids are one conversation. A row's first fault counts: blank, duplicate (role and
    text seen earlier in the conversation), truncated (no sentence end last). Kept rows cost 0, new roles 1, deletions 2,
    inserted turns 5, truncated rows left in 5 more; blank rows and duplicates go. Of equal costs the ASCII-least audit
    (letters K, R, D, I in order) holds. Conversations of which nothing is left have no turns. Roles with other initials
    than s, u and a can't be kept as they are. Other columns are ignored, whatever their names.
    """
    return _streamed(rows, rows, conv, turn, role, text, True)


def repair_report(rows: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation of ids (of rows by default; with rows or without): gaps (missing turns between the first
    and the last), blank, duplicate, truncated, illegal (neighbours that may not follow each other), cost, audit and
    repaired_sha256, the hash of what repaired_turns returns as role:text lines."""
    return _streamed(rows, rows if ids is None else ids, conv, turn, role, text, False)


def repair_query(rows: DataFrame) -> DataFrame:
    """Contract columns: damaged conversations repaired, one row for every original id."""
    return repair_report(damage(rows), rows)

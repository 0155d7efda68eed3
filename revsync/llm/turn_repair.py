"""Conversation structure repair: the cheapest edits that make the roles alternate.

A good conversation's role initials read `(s?(ua)+)?`. Its turns are aligned to each length
that this grammar has, by Wagner and Fischer's table: row i, column j hold the least cost of
turning the first i turns into the first j roles. Targets without a system turn are prefixes
of one endless string, those with one of another, so two tables hold all lengths. A table is
filled within Ukkonen's band, the diagonals that the cost of the cheapest repair known so
far leaves open, and every length that ends at the least cost is traced back to its
ASCII-least audit, the least of which is taken. A conversation whose band is too wide to
hold, as one of very many turns may be, has the table's columns folded by parity, on which
all later costs depend alone; that is one pass and gives the same audit.

Faults are found in all rows by windows; what is together while a conversation is aligned is
one byte a turn. Repaired turns are made by joins on conversation and place, whichever way
the rows are distributed.
"""

from __future__ import annotations

from array import array
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revsync.llm.common import batched, digest_runs, runs, stage, workspace

REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Cells of a table beyond which its columns are folded.
CELLS = 1_000_000
#: Conversations of at most so many turns have their audits kept, so many at a time.
SHORT, KEPT = 24, 100_000
FAR = 2**40
SPACE = " \t\n\x0b\x0c\r"


# --- one conversation --------------------------------------------------------------------
# It is a string of a character per turn: x for one that has to go, else its role's initial
# (o for roles of other initials), in upper case if its text is cut off.


class Audit(NamedTuple):
    cost: int
    audit: str
    #: Whether the repaired conversation begins with a system turn.
    system: bool


def role_at(system: bool, j: int) -> str:
    """The role that a target has at place j."""
    return "s" if system and j == 0 else "ua"[(j - system) % 2]


def passing(turn: str, role: str) -> int | None:
    """What it costs to leave `turn` as `role`; None if that can't be."""
    if turn == "x" or (role == "s" and turn not in "sS"):
        return None
    return (0 if turn.lower() == role else REROLE) + CUT_OFF * turn.isupper()


def at_most(turns: str) -> int:
    """The cost of a repair that never looks ahead."""
    cost, last = 0, "a"
    for t in turns:
        if t in "xsSoO":
            cost += DELETE
            continue
        cost += (INSERT if t.lower() == last else 0) + CUT_OFF * t.isupper()
        last = t.lower()
    return cost + (INSERT if last == "u" else 0)


def fill(turns: str, system: bool, reach: int) -> list[dict[int, int]]:
    """The table's rows, each from column to cost, within `reach` of the diagonal.

    The diagonal stands still at turns that have to go.
    """
    rows, middle = [], 0
    for i in range(len(turns) + 1):
        before, row = rows[-1] if rows else {}, {}
        turn = turns[i - 1] if i else "x"
        middle += turn != "x"
        for j in range(max(0, middle - reach), middle + reach + 1):
            cost = 0 if i == j == 0 else FAR
            if j in before:
                cost = before[j] + DELETE
            if j:
                role = role_at(system, j - 1)
                if j - 1 in before and (c := passing(turn, role)) is not None:
                    cost = min(cost, before[j - 1] + c)
                if role != "s" and j - 1 in row:
                    cost = min(cost, row[j - 1] + INSERT)
            if cost < FAR:
                row[j] = cost
        rows.append(row)
    return rows


def trace(turns: str, system: bool, rows: list[dict[int, int]], length: int) -> str:
    """The ASCII-least audit of those that reach `length` at the table's cost."""
    on = [set() for _ in rows]  # the columns of each row that a cheapest way passes
    on[-1].add(length)
    for i in range(len(turns), -1, -1):
        row = rows[i]
        for j in sorted(on[i], reverse=True):
            while j and row.get(j - 1, FAR) + INSERT == row[j] and role_at(system, j - 1) != "s" and j - 1 not in on[i]:
                j -= 1
                on[i].add(j)
        if i:
            before, turn = rows[i - 1], turns[i - 1]
            for j in on[i]:
                if before.get(j, FAR) + DELETE == row[j]:
                    on[i - 1].add(j)
                if j and j - 1 in before and (c := passing(turn, role_at(system, j - 1))) is not None:
                    if before[j - 1] + c == row[j]:
                        on[i - 1].add(j - 1)
    out, i, j = [], 0, 0
    while (i, j) != (len(turns), length):
        now = rows[i][j]
        if i < len(turns) and j in on[i + 1] and rows[i + 1][j] == now + DELETE:
            out.append("D")
            i += 1
        elif j + 1 in on[i] and rows[i][j + 1] == now + INSERT and role_at(system, j) != "s":
            out.append("I")
            j += 1
        else:
            out.append("K" if turns[i].lower() == role_at(system, j) else "R")
            i, j = i + 1, j + 1
    return "".join(out)


def align(turns: str) -> Audit:
    """The cheapest audit, the ASCII-least of those."""
    bound, needed = at_most(turns), 0
    for t in turns:
        needed += DELETE if t == "x" else CUT_OFF * t.isupper()
    best = None
    for system in (False, True):
        if system and "s" not in turns.lower():
            continue
        # leaving the diagonal costs at least 2 a step: an insertion, or a deletion less what its turn costs anyway
        reach = (bound - needed) // min(INSERT, DELETE - CUT_OFF)
        if (2 * reach + 1) * (len(turns) + 1) > CELLS:
            return fold(turns)
        rows = fill(turns, system, reach)
        for length, cost in rows[-1].items():
            whole = length % 2 == 0 if not system else length % 2 == 1 and length > 1
            if whole and cost <= bound:
                found = Audit(cost, trace(turns, system, rows, length), system)
                best, bound = min(filter(None, (best, found))), cost
    return best


#: Columns of a folded table: nothing yet, system, last role user, last role assistant.
START, SYSTEM, USER, ASSISTANT = range(4)


def fold(turns: str) -> Audit:
    """As `align`, with columns folded by parity: costs from each place to the end, then one way forward."""
    to = [array("q", [FAR]) * (len(turns) + 1) for _ in range(4)]

    def ways(i: int, column: int):
        """Letter, cost, next place and column; in ASCII order."""
        if i < len(turns):
            yield "D", DELETE, i + 1, column
        then = ASSISTANT if column == USER else USER
        yield "I", INSERT, i, then
        if i < len(turns):
            for role, there in (("s", SYSTEM),) * (column == START) + (("a" if column == USER else "u", then),):
                if (c := passing(turns[i], role)) is not None:
                    yield "K" if turns[i].lower() == role else "R", c, i + 1, there

    for i in range(len(turns), -1, -1):
        if i == len(turns):
            to[START][i] = to[ASSISTANT][i] = 0
        for column in (USER, ASSISTANT, USER, SYSTEM, START):  # an insertion leads from one to another
            to[column][i] = min([to[column][i], *(c + to[there][at] for _, c, at, there in ways(i, column))])
    out, i, column, system = [], 0, START, False
    cost = to[START][0]
    while i < len(turns) or to[column][i]:
        letter, _, i_next, there = next(
            w for w in ways(i, column) if w[1] + to[w[3]][w[2]] == to[column][i]
        )
        system |= there == SYSTEM
        out.append(letter)
        i, column = i_next, there
    return Audit(cost, "".join(out), system)


# --- all conversations -------------------------------------------------------------------


def faults(rows: DataFrame) -> DataFrame:
    """`conv, turn, role, text` with each row's place in its conversation and its first fault.

    Rows stand by turn, nulls first; at one turn by role, then text. `code` is what `align`
    reads; `opens` tells a turn number's first row, `illegal` that the row may not follow the
    one before it.
    """
    of = Window.partitionBy("conv")
    order = of.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    placed = rows.select(
        "conv", "turn", "role", "text",
        (F.row_number().over(order) - 1).cast("long").alias("place"),
        F.lag("turn").over(order).alias("last_turn"),
        F.lag(initial).over(order).alias("last_initial"),
    )
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("place")) > 1
    fault = (
        F.when(bare == "", "blank").when(seen, "duplicate")
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    )
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return placed.select(
        "conv", "place", "turn", "role", "text", fault.alias("fault"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))).alias("opens"),
        (F.col("last_initial").isNotNull() & ~F.concat("last_initial", initial).isin("su", "ua", "au")).alias("illegal"),
    ).withColumn(
        "code",
        F.when(F.col("fault").isin("blank", "duplicate"), "x")
        .when(F.col("fault") == "truncated", F.upper(known)).otherwise(known),
    )


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of `faults`: `conv, cost, audit, system`."""
    fields = [
        rows.schema["conv"], T.StructField("cost", T.LongType()),
        T.StructField("audit", T.StringType()), T.StructField("system", T.BooleanType()),
    ]
    schema = to_arrow_schema(T.StructType(fields))

    def aligned(batches):
        known = {}
        for conv, codes in runs(batches):
            turns = "".join(c for c, in codes)
            if len(turns) > SHORT:
                yield conv, *align(turns)
                continue
            if turns not in known:
                if len(known) >= KEPT:
                    known.clear()
                known[turns] = align(turns)
            yield conv, *known[turns]

    def run(batches):
        yield from batched(aligned(batches), schema)

    codes = rows.select("conv", "place", "code").repartition("conv").sortWithinPartitions("conv", "place")
    return codes.select("conv", "code").mapInArrow(run, T.StructType(fields))


def edits(done: DataFrame) -> DataFrame:
    """Audits as rows: `conv, out, edit, place, new_role`.

    `out` is the place among the repaired turns, null for a deletion; `place` that among the
    old ones, null for an insertion; `new_role` is set where the edit gives a role.
    """
    fields = [
        done.schema["conv"], T.StructField("out", T.LongType()), T.StructField("edit", T.StringType()),
        T.StructField("place", T.LongType()), T.StructField("new_role", T.StringType()),
    ]
    schema = to_arrow_schema(T.StructType(fields))
    names = {"u": "user", "a": "assistant"}

    def listed(batches):
        for conv, some in runs(batches):
            for audit, system in some:
                out = place = 0
                for e in audit:
                    gives = names[role_at(system, out)] if e in "IR" else None
                    yield conv, None if e == "D" else out, e, None if e == "I" else place, gives
                    out, place = out + (e != "D"), place + (e != "I")

    def run(batches):
        yield from batched(listed(batches), schema)

    return done.select("conv", "audit", "system").mapInArrow(run, T.StructType(fields))


def repaired(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The repaired turns, `conv, out, edit, place, turn, role, text`, from `faults` and `audits`.

    An inserted turn has an empty text and no turn number. Deleted ones do not come out.
    """
    left = edits(done).where("edit <> 'D'").alias("e")
    right = rows.select("conv", "place", "turn", "role", "text").alias("r")
    on = F.col("e.conv").eqNullSafe(F.col("r.conv")) & (F.col("e.place") == F.col("r.place"))
    return left.join(right, on, "left").select(
        "e.conv", "out", "edit", "e.place", "turn",
        F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )


def rows_of(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The columns that the functions above take; a null role or text is one space."""
    filled = [F.coalesce(F.col(c), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))]
    return conversations.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), *filled)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32(`conv:turn`) mod 20, a null in it being one space.

    0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats it,
    4 makes its role user.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    kind = (F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20).alias("kind")
    copies = F.explode(F.expr("case kind when 0 then array() when 3 then array(1, 2) else array(1) end"))
    return (
        rows.select("*", kind).withColumn("copy", copies)
        .select(
            "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")).alias("text"),
        )
    )


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Per conversation: its faults, the cost and audit of its repair, and the repaired turns' digest.

    `rows` are its rows as `rows_of` gives them, damaged or not. A conversation without rows
    has zeros, an empty audit and the digest of nothing; a null id is a conversation too.
    Rows that repeat count each. `conversations` has one column, `conv`.
    """
    with workspace(conversations.sparkSession) as put:
        told = put(faults(rows), "faults")
        done = put(audits(told), "audits")
        turns = repaired(told, done).select(
            "conv", "out", F.concat("role", F.lit(":"), "text").alias("line")
        )
        digests = digest_runs(turns, "conv", "out", "line", "\n").select("conv", "sha256")
        of_kind = [F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
        counts = told.groupBy("conv").agg(
            (F.max("turn") - F.min("turn") + 1 - F.count_if("opens")).alias("gaps"),
            *of_kind, F.count_if("illegal").alias("illegal"),
        )
        zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        out = conversations.select("conv").distinct()
        for more in (counts, done.drop("system"), digests):
            more = more.withColumnRenamed("conv", "of")
            out = out.join(more, F.col("conv").eqNullSafe(F.col("of")), "left").drop("of")
        return stage(
            out.select(
                "conv", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
            ),
            "repairs",
        )

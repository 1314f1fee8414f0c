"""Conversation structure repair: the cheapest edits that make the roles of a conversation read ``(s?(ua)+)?``.

A conversation's rows are read in order. Every row is kept (K, 0), given the role user or assistant (R, 3) or
deleted (D, 4; blank and duplicate rows must be), an undeleted truncated row costs 3 more, and user or assistant
rows with empty text may be inserted anywhere (I, 3). Four states say what has been written so far: nothing,
a system row, a user row last, an assistant row last. In a state a letter of the audit has one meaning, so the
audit alone gives the repaired conversation; of the cheapest audits the ASCII-least is taken.

Hirschberg's divide-and-conquer: a forward vector (cost of each state, and the order of the states' least audits)
and a backward vector (cost to the end) meet in the middle; of the cheapest crossings the one with the least
audit is taken, and both halves are solved alike, in linear space. Audits that end with a row's own letter
are never prefixes of one another, so the order of the crossings' first halves decides.

In Spark: rows are dealt by ranges of (conversation, turn, role, start of the text) and sorted, so a long
conversation spreads over tasks. Runs of at most ``CHUNK`` rows are reduced to a 4 x 4 table of costs and orders;
the runs of a conversation meet as such tables only, where the same procedure chooses the state between runs, and
then all runs are solved apart from each other. Texts never gather by conversation: the digest reads the sorted
repaired turns as a stream. Duplicates are found by a pre-aggregated minimum, not by a window.

Defined cases: nulls (conv_id and turn in the damage key, role and text) are one space; rows of a null conv_id
form one conversation. Rows of one turn follow by (role, text), null turns first; repeated rows are rows of
their own, and later ones duplicates. Roles are told apart by their initials s, u, a; any other role, the empty
one included, can't be kept. Whole texts count, whatever their length. A conversation without rows after damage has zeros, the
empty audit and the digest of the empty string. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quiver.session import materialize, ship_package

CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS
WHITE = " \t\n\x0b\x0c\r"
FAR = 1 << 40
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # fixed costs
AFTER_INSERT = (2, 2, 3, 2)  # state after writing a user or assistant row, from each state
AFTER_KEEP = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}}  # initial -> state -> state
TAIL = ("", "II", "I", "")  # what ends a conversation from each state


class Step(NamedTuple):
    """What a row or a run does to the four states: cost[from][to], order[from][to] among the audits from one state."""

    cost: tuple
    order: tuple


def _ordered(audits: list[list]) -> tuple:
    return tuple(tuple(sorted(a for a in row if a is not None).index(a) if a is not None else 0 for a in row) for row in audits)


@cache
def row_step(code: int) -> tuple[Step, tuple]:
    """(step, audits[from][to]) of one row; code = 4 * initial (3: any other) + fault (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    initial, fault = divmod(code, 4)
    extra = TRUNCATED if fault == 3 else 0
    cost, audits = [[FAR] * 4 for _ in range(4)], [[None] * 4 for _ in range(4)]
    for start in range(4):
        state = start
        for inserts in range(4):
            options = [("D", state, DELETE)]
            if fault in (0, 3):
                options.append(("R", AFTER_INSERT[state], REROLE + extra))
                if state in AFTER_KEEP.get(initial, ()):
                    options.append(("K", AFTER_KEEP[initial][state], KEEP + extra))
            for letter, end, price in options:
                found = (INSERT * inserts + price, "I" * inserts + letter)
                if audits[start][end] is None or found < (cost[start][end], audits[start][end]):
                    cost[start][end], audits[start][end] = found
            state = AFTER_INSERT[state]
    return Step(tuple(map(tuple, cost)), _ordered(audits)), tuple(map(tuple, audits))


def forward(steps, start: int) -> tuple[list, list]:
    """(cost, order) of every state after the steps, from one state."""
    cost, order = [FAR] * 4, [0] * 4
    cost[start] = 0
    for step in steps:
        found = [None] * 4
        for p in range(4):
            if cost[p] < FAR:
                own, ranks, base, rank = step.cost[p], step.order[p], cost[p], order[p]
                for q in range(4):
                    if own[q] < FAR:
                        option = (base + own[q], rank, ranks[q])
                        if found[q] is None or option < found[q]:
                            found[q] = option
        cost = [FAR if f is None else f[0] for f in found]
        ranks = sorted(f[1:] for f in found if f is not None)
        order = [0 if f is None else ranks.index(f[1:]) for f in found]
    return cost, order


def backward(steps, end) -> list:
    """Cost from every state to the end; ``end`` is a state, or None for the conversation's end."""
    cost = [INSERT * len(t) for t in TAIL] if end is None else [0 if q == end else FAR for q in range(4)]
    for step in reversed(steps):
        cost = [min(min(step.cost[p][q] + cost[q] for q in range(4)), FAR) for p in range(4)]
    return cost


def crossings(steps: list, start: int, end=None) -> list[int]:
    """The state before the first step and after each of them, on the cheapest, then audit-least way."""
    out = [start] + [0] * len(steps)

    def cross(lo: int, hi: int, begin: int, finish) -> None:
        if hi - lo == 1 and finish is not None:
            out[hi] = finish
            return
        mid = max((lo + hi) // 2, lo + 1)
        cost, order = forward(steps[lo:mid], begin)
        rest = backward(steps[mid:hi], finish)
        _, _, state = min((cost[q] + rest[q], order[q], q) for q in range(4) if cost[q] < FAR)
        if mid - lo == 1:
            out[mid] = state
        else:
            cross(lo, mid, begin, state)
        if hi > mid:
            cross(mid, hi, state, finish)

    if steps:
        cross(0, len(steps), start, end)
    return out


def summary(codes: bytes) -> Step:
    """A run of rows as one step."""
    steps = [row_step(c)[0] for c in codes]
    found = [forward(steps, q) for q in range(4)]
    return Step(tuple(tuple(c) for c, _ in found), tuple(tuple(o) for _, o in found))


def edits(codes: bytes, start: int, end) -> tuple[list[str], list[str], str]:
    """(audit of every row of a run, what every row writes, audit after the last row); ``end`` is None for the last run.

    A row writes u or a for an inserted row of that role, U or A for itself under that role, k for itself as it is.
    """
    states = crossings([row_step(c)[0] for c in codes], start, end)
    audits = [row_step(c)[1][p][q] for c, p, q in zip(codes, states, states[1:])]
    tail = TAIL[states[-1]] if end is None else ""
    writes = []
    for k, audit in enumerate(audits):
        state, line = states[k], ""
        for letter in audit + (tail if k == len(audits) - 1 else ""):
            if letter == "K":
                line, state = line + "k", states[k + 1]
            elif letter != "D":
                state = AFTER_INSERT[state]
                line += ("a" if state == 3 else "u") if letter == "I" else ("A" if state == 3 else "U")
        writes.append(line)
    return audits, writes, tail


# ---- Spark ----------------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults: crc32(``conv_id:turn``) % 20 of 0 drops a row, 1 empties its
    text, 2 removes its ``[.!?]``, 3 repeats it and 4 makes its role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("_kind") == 3, 1).otherwise(0)))
    return rows.where("_kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def ordered_rows(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, place, code): ``conv`` is conv_id as text (null: empty), ``place`` grows in reading order."""
    filled = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    plain = filled.select("*", (bare == "").alias("blank"), (~F.substr(bare, F.lit(-1)).isin(".", "!", "?")).alias("truncated"), digest.alias("same"), F.monotonically_increasing_id().alias("row"))
    plain = materialize(plain)
    moment = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "row")
    first = plain.where("NOT blank").groupBy("conv", "same").agg(F.min(moment)["row"].alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = F.coalesce(F.col("row") != F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), 1).when(later, 2).when(F.col("truncated"), 3).otherwise(0)
    initial = F.substr("role", F.lit(1), F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    coded = plain.join(first, ["conv", "same"], "left").select("conv", "turn", "role", "text", "row", (4 * kind + fault).cast("int").alias("code"))
    # a range may end inside a conversation, and rows that share the range's key stay together
    dealt = coded.repartitionByRange("conv", F.asc_nulls_first("turn"), "role", F.substr("text", F.lit(1), F.lit(32)))
    sorted_rows = dealt.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", "row")
    return materialize(sorted_rows.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("place"), "code"))


def _spread(runs: DataFrame) -> DataFrame:
    """Runs are few bytes and much work: they are dealt by number, not by size."""
    return runs.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv", "run")


def _runs(rows: DataFrame) -> DataFrame:
    """(conv, run, first place, codes, cost, order) of runs of at most ``CHUNK`` rows."""
    listed = F.sort_array(F.collect_list(F.struct("place", "code")))
    runs = rows.groupBy("conv", F.shiftright("place", CHUNK_BITS).alias("run")).agg(listed.alias("listed"))
    runs = runs.select("conv", "run", F.col("listed")[0]["place"].alias("first"), F.transform("listed", lambda x: x["code"]).alias("codes"))

    def reduce_run(batches):
        for batch in batches:
            found = [summary(bytes(c)) for c in batch.column(3).to_pylist()]
            flat = lambda k: pa.array([[v for row in s[k] for v in row] for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(3).cast(pa.list_(pa.int32())), flat(0), flat(1)], ["conv", "run", "first", "codes", "cost", "ranks"])

    return materialize(_spread(runs).mapInArrow(reduce_run, "conv string, run long, first long, codes array<int>, cost array<long>, ranks array<long>"))


def _meet(batches):
    """The states between the runs of every conversation, and its cost."""
    square = lambda v: tuple(tuple(v[4 * i : 4 * i + 4]) for i in range(4))
    for batch in batches:
        states, costs = [], []
        for runs in batch.column(1).to_pylist():
            steps = [Step(square(r["cost"]), square(r["ranks"])) for r in runs]
            at, last = crossings(steps, 0), len(runs) - 1
            costs.append(backward(steps, None)[0])
            states.append([{"run": r["run"], "begin": p, "finish": None if k == last else q} for k, (r, p, q) in enumerate(zip(runs, at, at[1:]))])
        kind = pa.list_(pa.struct([("run", pa.int64()), ("begin", pa.int32()), ("finish", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(states, kind)], ["conv", "cost", "states"])


def _solve(batches):
    for batch in batches:
        found = [edits(bytes(c), p, q) for c, p, q in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())]
        audits = pa.array(["".join(f[0]) + f[2] for f in found], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], audits, pa.array([f[1] for f in found], pa.list_(pa.string()))], ["conv", "run", "first", "audit", "writes"])


class Repaired(NamedTuple):
    """``turns``: (conv, place, part, role, text) of the repaired conversations, in order of (place, part).
    ``report``: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of conversations with rows."""

    turns: DataFrame
    report: DataFrame


def repair(rows: DataFrame) -> Repaired:
    """Repair every conversation of ``rows`` (conv_id, turn, role, text)."""
    ship_package(rows.sparkSession)
    ordered = ordered_rows(rows)
    runs = _runs(ordered)
    gathered = runs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("run", "cost", "ranks"))).alias("runs"))
    met = gathered.mapInArrow(_meet, "conv string, cost long, states array<struct<run: long, begin: int, finish: int>>")
    met = materialize(met)
    solved = runs.join(met.select("conv", F.inline("states")), ["conv", "run"]).select("conv", "run", "first", "codes", "begin", "finish")
    solved = materialize(_spread(solved).mapInArrow(_solve, "conv string, run long, first long, audit string, writes array<string>"))
    each = solved.select("first", F.posexplode("writes").alias("k", "writes")).where("writes <> ''")
    each = each.select((F.col("first") + F.col("k")).alias("place"), F.posexplode(F.split("writes", "")).alias("part", "mark"))
    mark = F.col("mark")
    role = F.when(F.lower(mark) == "u", "user").when(F.lower(mark) == "a", "assistant").otherwise(F.col("role"))
    text = F.when(mark.isin("u", "a"), "").otherwise(F.col("text"))
    turns = ordered.join(each, "place").select("conv", "place", "part", role.alias("role"), text.alias("text"))
    return Repaired(turns, _report(ordered, runs, met, solved))


def _report(ordered: DataFrame, runs: DataFrame, met: DataFrame, solved: DataFrame) -> DataFrame:
    fault = F.col("code") % 4
    faults = ordered.groupBy("conv").agg(*[F.count_if(fault == k).alias(n) for k, n in ((1, "blank"), (2, "duplicate"), (3, "truncated"))],
                                         (F.max("turn") - F.min("turn") + 1).alias("span"), F.count_distinct("turn").alias("turns"))
    faults = faults.withColumn("gaps", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)))
    legal = F.array(*[F.lit(x) for x in (1, 12, 21)])  # su, ua, au as ten times the first initial plus the second
    pairs = F.transform(F.sequence(F.lit(1), F.size("codes")), lambda k: F.when(k < F.size("codes"), F.floor(F.get("codes", k - 1) / 4) * 10 + F.floor(F.get("codes", k) / 4)))
    wrong = F.size(F.filter(pairs, lambda p: p.isNotNull() & ~F.array_contains(legal, p.cast("int"))))
    ends = F.struct("run", F.floor(F.get("codes", F.lit(0)) / 4).cast("int").alias("head"), F.floor(F.element_at("codes", -1) / 4).cast("int").alias("foot"))
    pieces = F.sort_array(F.collect_list(F.struct("run", "audit", "wrong", "head", "foot")))
    per_run = runs.select("conv", ends.alias("e"), wrong.alias("wrong")).select("conv", "e.*", "wrong").join(solved.select("conv", "run", "audit"), ["conv", "run"])
    joined = per_run.groupBy("conv").agg(pieces.alias("p"))
    seams = F.filter(F.sequence(F.lit(1), F.size("p")), lambda k: (k < F.size("p")) & ~F.array_contains(legal, F.get("p", k - 1)["foot"] * 10 + F.get("p", k)["head"]))
    joined = joined.select("conv", F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"),
                           (F.aggregate(F.transform("p", lambda x: x["wrong"]), F.lit(0), lambda a, x: a + x) + F.size(seams)).cast("long").alias("illegal"))
    return faults.join(joined, "conv").join(met.select("conv", "cost"), "conv").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): digest of the ``role:text`` lines of every conversation, read as a sorted stream."""
    import hashlib

    def run(batches):
        conv, state = None, None
        for batch in batches:
            done = []
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                    state.update(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], ["conv", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], ["conv", "repaired_sha256"])

    lines = turns.repartition("conv").sortWithinPartitions("conv", "place", "part").select("conv", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.mapInArrow(run, "conv string, repaired_sha256 string")


def op13_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    done = repair(damage(conversations))
    everyone = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = everyone.join(done.report, "conv", "left").join(digests(done.turns), "conv", "left")
    return out.select("conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

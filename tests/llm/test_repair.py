"""Conversation structure repair against a shortest-path search over whole audits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quiver.llm import repair as R
from quiver.llm.registry import QUERIES

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired lines) of rows (role, text) in order."""
    faults, seen = [], set()
    for role, text in rows:
        said = BLANK.findall(text)
        faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, written, lines = heapq.heappop(heap)
        state = written[-1:]
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", written):
            return *[faults.count(x) for x in "bdt"], illegal, cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        turn = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[turn]
        heapq.heappush(heap, (cost + 3, audit + "I", i, written + turn, (*lines, name + ":")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, written, lines))
            if faults[i] in ("", "t"):
                more = 3 if faults[i] else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, written + turn, (*lines, f"{name}:{text}")))
                if role[:1] == turn or (role[:1] == "s" and not written):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, written + role[:1], (*lines, f"{role}:{text}")))


def damaged(rows):
    """Brute-force damage of (conv_id, turn, role, text) rows: {conv_id: [(turn, role, text)]} in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def expected(rows):
    out = []
    for conv, own in damaged(rows).items():
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        *counts, audit, lines = brute([(r, t) for _, r, t in own])
        out.append((conv, gaps, *counts, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def answered(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def codes_of(rows):
    kind = {"s": 0, "u": 1, "a": 2}
    seen, out = set(), []
    for role, text in rows:
        said = BLANK.findall(text)
        out.append(4 * kind.get(role[:1], 3) + (1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0))
        seen.add((role, text))
    return bytes(out)


def test_edits_equal_the_shortest_path():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", " ", "c!", "d?", f"{k}."])) for k in range(rng.randrange(1, 10))]
        codes = codes_of(rows)
        audits, writes, tail = R.edits(codes, 0, None)
        *_, cost, audit, lines = brute(rows)
        assert "".join(audits) + tail == audit
        assert R.backward([R.row_step(c)[0] for c in codes], None)[0] == cost
        name = {"u": "user:", "a": "assistant:"}
        written = [name[m] if m in "ua" else name[m.lower()] + text if m in "UA" else f"{role}:{text}" for (role, text), w in zip(rows, writes) for m in w]
        assert written == list(lines)


def test_runs_meet_like_one_run():
    rng = random.Random(6)
    for _ in range(300):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(2, 40)))
        whole = R.edits(codes, 0, None)
        cut = sorted({0, len(codes), *(rng.randrange(len(codes)) for _ in range(4))})
        runs = [codes[a:b] for a, b in zip(cut, cut[1:])]
        at = R.crossings([R.summary(r) for r in runs], 0)
        parts = [R.edits(r, p, None if k == len(runs) - 1 else q) for k, (r, p, q) in enumerate(zip(runs, at, at[1:]))]
        assert sum((p[0] for p in parts), []) == whole[0] and parts[-1][2] == whole[2]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answered(QUERIES["op13_hirschberg_repair"](spark, SF001)) == expected(rows)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(7)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "no", "", " \n\t", None, "same.", "same.", "ends  ", "ends. \x0b\x0c", "x" * 60_000 + "!"]
    rows = [(c, rng.choice([*range(6), None]), rng.choice(roles), rng.choice(texts)) for c in [1, 2, 3, None, 5, 8] for _ in range(rng.randrange(1, 14))]
    return [*rows, (77, 3, "user", "alone."), *[(9, t, "user" if t % 2 == 0 else "assistant", f"t{t}." if t % 7 else "again.") for t in range(300)], *[(1, 2, "user", "same.")] * 3]


def test_edge_cases(spark, odd_rows, tmp_path, monkeypatch):
    """Nulls, blanks, very long texts, ties, repeats, a dropped conversation, clashing columns, runs of a few rows."""
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [*odd_rows, (dropped, 0, "user", "gone.")]
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], "conv_id long, turn long, role string, text string, place long, conv string, code int, audit string").repartition(5)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    want = expected(rows)
    assert answered(QUERIES["op13_hirschberg_repair"](spark, str(tmp_path))) == want
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want
    monkeypatch.setattr(R, "CHUNK_BITS", 2)
    assert answered(QUERIES["op13_hirschberg_repair"](spark, str(tmp_path))) == want


def test_repaired_turns_keep_the_pattern(spark, odd_rows):
    rows = spark.createDataFrame(odd_rows, "conv_id long, turn long, role string, text string")
    done = R.repair(rows)
    found = {}
    for r in done.turns.orderBy("conv", "place", "part").collect():
        found[r["conv"]] = found.get(r["conv"], "") + r["role"][:1]
    assert all(re.fullmatch("s?(ua)+", f) for f in found.values()) and found["9"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = QUERIES["op13_hirschberg_repair"](spark, str(tmp_path))
    assert out.columns == COLUMNS and out.count() == 0
    assert R.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).turns.columns == ["conv", "place", "part", "role", "text"]

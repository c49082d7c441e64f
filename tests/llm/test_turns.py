"""Conversation repair against a search over all edits, one conversation at a time."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxmode.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, cid string, place string"
WHITE = re.compile(r"[^\x20\x09-\x0D]")
GOAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        held = WHITE.findall(text)
        out.append("blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def searched(rows):
    """Least (cost, edits) by a shortest-path search over places and written initials; lines of the result."""
    marks = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, shape, lines = heapq.heappop(heap)
        if at == len(rows) and GOAL.fullmatch(shape):
            return cost, audit, list(lines)
        state = (at, shape[-1:] if shape != "s" else "first")
        if state in done:
            continue
        done.add(state)
        for role in ("user", "assistant"):
            if _begins(shape + role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", at, (shape + role[0])[-2:], (*lines, f"{role}:")))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, shape, lines))
            if marks[at] in ("none", "truncated"):
                more = marks[at] == "truncated"
                if _begins(shape + role[:1]) and role[:1]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, (shape + role[0])[-2:], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if _begins(shape + new[0]):
                        heapq.heappush(heap, (cost + more + 2, audit + "R", at + 1, (shape + new[0])[-2:], (*lines, f"{new}:{text}")))
    raise AssertionError


def _begins(shape):
    """Whether the last two initials may stand in a good series: shapes keep two, as su, ua and au say all that follows."""
    return shape in ("s", "u") or shape[-2:] in ("su", "ua", "au")



def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        out += [(c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    return out


def expected(rows):
    by = defaultdict(list)
    for r in damage(rows):
        by[r[0]].append(r)
    out = {}
    for c in {r[0] for r in rows}:
        rs = sorted(by[c], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        pairs = [(r[2], r[3]) for r in rs]
        marks, ts = faults(pairs), [r[1] for r in rs if r[1] is not None]
        cost, audit, lines = searched(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
        out[c] = (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TEXTS = ["Yes.", "No", "", " \t", None, "What?", "one two.", "Ends here! ", "é.", "x" * 300 + "."]
ROLES = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "User"]


def conversations(seed, n, turns_of):
    r = random.Random(seed)
    return [(None if c == 3 else c, r.choice([None, *range(12)]), r.choice(ROLES), r.choice(TEXTS) if r.random() < 0.4 else f"text {r.random()}.", "x", "y") for c in range(n) for _ in range(turns_of(r))]


@pytest.mark.parametrize("shift", [1, 14])
def test_every_conversation(spark, shift):
    rows = conversations(1, 150, lambda r: r.randrange(9)) + [(500, t, "user" if t % 2 else "assistant", f"line {t}.", "x", "y") for t in range(60)]
    rows += [(600 + k, 0, "user", "dropped." if k else "twice.", "x", "y") for k in range(40)] + [(501, None, " ", None, "x", "y")] * 40
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.digest(spark.createDataFrame(rows, SCHEMA), shift).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == expected([r[:4] for r in rows])


def test_nothing(spark):
    assert turns.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_runs_that_never_converge(spark):
    rows = [(1, 0, "system", "Begin.")] + [(1, t, "tool" if t % 3 else "system", "  ") for t in range(1, 300)] + [(1, 300, "assistant", "End."), (1, 301, "user", "cut")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = turns.repair(df, shift=2)
    told = turns.report(done).first()
    cost, audit, lines = searched([(r[2], r[3]) for r in rows])
    assert (told["cost"], told["audit"], told["repaired_sha256"]) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert [f"{r['role']}:{r['text']}" for r in turns.repaired(done).orderBy("place", "n").collect()] == lines


def test_hot_conversation_is_split(spark):
    """A third of all rows are one conversation, whose turns are null and texts equal: chunks and numbering stay even."""
    rows = [(None, None, "user", "Same words.")] * 4000 + [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of {c}.") for c in range(1000) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = turns.numbered(df)
        sizes = [r["count"] for r in done.groupBy((done["place"] / 2**33).cast("int").alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 4500
    parts = turns.chunks(turns.coded(done), shift=8)
    assert max(len(r["codes"]) for r in parts.collect()) <= 256
    told = {r["conv_id"]: r for r in turns.report(turns.repair(df, shift=8)).collect()}
    assert len(told) == 1001 and told[None]["duplicate"] == 3999 and told[None]["cost"] == 3 * 3999 + 2 and told[5]["audit"] == "K" * 8


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["a.", "b.", "c", " ", "d!", "e?", "f"])), max_size=14), st.integers(1, 5))
def test_chunked_vectors(rows, size):
    """Any cut into chunks, run by passes without Spark, gives the searched edits."""
    machine, marks = turns.Machine(), faults(rows)
    codes = "".join(turns.CODES[("sua".find(r[0][:1]) if r[0][:1] in ("s", "u", "a") else 3) * 4 + turns.FAULTS.index(m)] for r, m in zip(rows, marks))
    parts = [codes[i : i + size] for i in range(0, len(codes), size)]
    ending = [turns.ENDING] * len(parts)
    begin = [machine.vectors(p, turns.ENDING)[-1] for p in parts]
    for _ in range(len(parts)):
        incoming = [*begin[1:], turns.ENDING]
        begin = [machine.refit(p, e, b, new) for p, e, b, new in zip(parts, ending, begin, incoming[: len(parts)])]
        ending = incoming[: len(parts)]
    state, audit = 0, ""
    for i, p in enumerate(parts):
        out, state = machine.run(p, ending[i], state, i == len(parts) - 1)
        audit += "".join(x[0] for x in out)
    assert audit == searched(rows)[1]

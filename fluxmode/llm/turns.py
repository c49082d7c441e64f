"""Conversation structure repair by rank-convergence parallel Viterbi.

A conversation should be an optional system turn and then user and assistant turns in pairs. Its rows are
kept (0), given the role user or assistant (2), deleted (3; blank rows and repeats must be), and empty user or assistant
rows inserted (2); a truncated row that stays costs 1 more. Of the cheapest series of edits the one with the least initials is taken.

The dynamic program has four states: nothing yet, a system turn, a user turn, an assistant turn. Rows are numbered in range
partitions and reduced to one letter each; a conversation's letters are cut into chunks at every 2 ** SHIFT-th row of
a partition, so one of any length spreads over the cluster. Every chunk computes its costs from behind, starting from a
speculative vector (as if the conversation ended there). A fix-up pass hands each chunk the vector its successor
arrived at; where that differs from the one it began with by more than a constant, the chunk is run again until old and
new vector differ by a constant only. Passes are written to the shared folder and end when no chunk changes.
Pass k takes 2 ** k neighbouring chunks one after the other, so their number is at most the logarithm of the chunks even where
vectors never converge (long runs of rows that must go). Costs that agree up to constants settle every choice, so the
chunks are then traced forward: each for all four entry states, which a scan over the chunks' exits reduces to one.

Rows of a conversation are taken by turn (nulls first), role and text (64 characters of each, then a hash of the whole); equal
rows are interchangeable. Null roles and texts are one space. Rows with null ids are one conversation. Texts are hashed or compared
whole, whatever their length. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import spread_join, stored

SPACE = " \t\n\x0b\x0c\r"
#: Rows of a partition in which one chunk of a conversation can lie: 2 ** SHIFT.
SHIFT = 14
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Letters of rows: initial (s, u, a, other) times fault (none, truncated, blank, duplicate).
INITIALS, FAULTS = "sua", ("none", "truncated", "blank", "duplicate")
CODES = "abcdefghijklmnop"
#: States 0 nothing, 1 system, 2 user, 3 assistant: what may follow by initial, and the one role that edits may bring.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT, BROUGHT = (2, 2, 3, 2), "uuau"
NAMES = {"u": "user", "a": "assistant"}
#: Least cost of ending in each state.
ENDING = (0, 2 * INSERT, INSERT, 0)


class Machine:
    """Cost vectors (least entry 0) and edits by row letter; both sets are small, so each is worked out once a task."""

    def __init__(self):
        self.steps: dict = {}
        self.traces: dict = {}

    def before(self, after: tuple, code: str) -> tuple:
        """The costs ahead of a row from those behind it, up to a constant."""
        found = self.steps.get((after, code))
        if found is None:
            cost = self._costs(after, code)
            low = min(cost)
            found = self.steps[after, code] = tuple(c - low for c in cost)
        return found

    def _costs(self, after: tuple, code: str) -> list[int]:
        cost = [min(c for c, _, _ in self._edits(after, code, s)) for s in range(4)]
        for s in (2, 3, 2, 0, 1):
            cost[s] = min(cost[s], INSERT + cost[NEXT[s]])
        return cost

    def _edits(self, after: tuple, code: str, state: int):
        """(cost, initial, state) of what can be done to a row itself, by initial."""
        k = CODES.index(code)
        initial, fault = (*INITIALS, "")[k // 4], k % 4
        yield DELETE + after[state], "D", state
        if fault < 2:
            held = AFTER.get((state, initial))
            if held is not None:
                yield fault * CUT + after[held], "K", held
            yield REROLE + fault * CUT + after[NEXT[state]], "R", NEXT[state]

    def trace(self, after: tuple, code: str, state: int) -> tuple:
        """The least cheapest edits up to and with a row: initials, roles inserted ahead, role brought or none, next state."""
        found = self.traces.get((after, code, state))
        if found is None:
            cost, at, ahead = self._costs(after, code), state, ""
            while True:
                edit, to = min((e, t) for c, e, t in [*self._edits(after, code, at), (INSERT + cost[NEXT[at]], "I", NEXT[at])] if c == cost[at])
                if edit != "I":
                    break
                ahead, at = ahead + BROUGHT[at], to
            found = self.traces[after, code, state] = ("I" * len(ahead) + edit, ahead, BROUGHT[at] if edit == "R" else None, to)
        return found

    def vectors(self, codes: str, end: tuple) -> list[tuple]:
        """The costs behind each row, and last those ahead of the first."""
        out = [end]
        for code in reversed(codes):
            out.append(self.before(out[-1], code))
        return out

    def refit(self, codes: str, end: tuple, begin: tuple, new: tuple) -> tuple:
        """The costs ahead of the chunk once it ends in new: run again until they differ from the old run's by a constant."""
        old = end
        for code in reversed(codes):
            if old == new:
                return begin
            old, new = self.before(old, code), self.before(new, code)
        return new

    def run(self, codes: str, end: tuple, state: int, last: bool) -> tuple[list[tuple], int]:
        """(initials, roles ahead, role, roles behind) of each row from an entry state, and the exit state."""
        behind, out = self.vectors(codes, end), []
        for i, code in enumerate(codes):
            edit, ahead, role, state = self.trace(behind[len(codes) - 1 - i], code, state)
            out.append((edit, ahead, role, ""))
        if last:
            tail = ""
            while ENDING[state]:
                tail, state = tail + BROUGHT[state], NEXT[state]
            edit, ahead, role, _ = out[-1]
            out[-1] = (edit + "I" * len(tail), ahead, role, tail)
        return out, state


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with one row in five damaged by a checksum of its place: dropped, emptied, cut, repeated or given to the user."""
    there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(there("conv_id"), F.lit(":"), there("turn")).cast("binary")) % 20
    rows = convs.select("conv_id", "turn", there("role").alias("role"), there("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def key_of(conv: Column) -> Column:
    """A name of a conversation that null ids have, too."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def numbered(convs: DataFrame) -> DataFrame:
    """conv_id, cid, turn, role, text and place, which grows in the order of a conversation's rows; stored.

    Rows are dealt by range of all they are ordered by and at last a number of their own: no conversation, turn or text is one task's.
    """
    there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = convs.select("conv_id", key_of(F.col("conv_id")).alias("cid"), F.col("turn").cast("long"), there("role"), there("text"))
    rows = rows.withColumns({"_r": F.left("role", F.lit(64)), "_t": F.left("text", F.lit(64)), "_h": F.xxhash64("role", "text"), "_n": F.monotonically_increasing_id()})
    order = ["cid", F.col("turn").asc_nulls_first(), "_r", "_t", "_h", "_n"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.select("conv_id", "cid", "turn", "role", "text", F.monotonically_increasing_id().alias("place")), "turns-rows")


def coded(rows: DataFrame) -> DataFrame:
    """cid, place, code: each row's initial and first fault as a letter."""
    held = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = rows.select("cid", "place", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("h"), F.left("role", F.lit(1)).alias("i"), F.right(held, F.lit(1)).alias("tail"))
    firsts = stored(narrow.groupBy("cid", "h").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"), "turns-repeats")
    met = spread_join(narrow, firsts, ["cid", "h"], "n", "left")
    initial = F.when(F.col("i") == "", 3).otherwise(F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.col("i")), F.lit(0)) - 1, F.lit(3)))
    fault = F.when(F.col("tail") == "", 2).when(F.col("place") > F.col("first"), 3).when(~F.col("tail").isin(".", "!", "?"), 1).otherwise(0)
    return met.select("cid", "place", F.substring(F.lit(CODES), initial * 4 + fault + 1, F.lit(1)).alias("code"))


_CHUNK = "cid string, c int, last boolean, first long, codes string"
_SPECULATED = f"{_CHUNK}, ending array<int>, begin array<int>"


def chunks(codes: DataFrame, shift: int = SHIFT) -> DataFrame:
    """cid, c (from 0), last, first (place), codes: the letters of conversations in chunks; a chunk's places are consecutive. Stored."""
    item = F.struct("place", "code")
    each = codes.groupBy("cid", F.shiftright("place", shift).alias("block")).agg(F.min("place").alias("first"), F.array_sort(F.collect_list(item)).alias("rows"))
    order = Window.partitionBy("cid").orderBy("block")
    letters = F.array_join(F.transform("rows", lambda r: r["code"]), "")
    return stored(each.select("cid", (F.row_number().over(order) - 1).alias("c"), F.lead("block").over(order).isNull().alias("last"), "first", letters.alias("codes")), "turns-chunks")


def _mapped(df: DataFrame, schema: str, make) -> DataFrame:
    """df with each row, a dict, put through make() -> (row -> rows), one function a task, in the order they come."""
    made = StructType.fromDDL(schema)
    arrow = to_arrow_schema(made)

    def run(batches):
        step = make()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                out = [dict(zip(arrow.names, x, strict=True)) for row in b.slice(at, 1024).to_pylist() for x in step(row)]
                for k in range(0, len(out), 8192):
                    yield pa.RecordBatch.from_pylist(out[k : k + 8192], arrow)

    return df.mapInArrow(run, made)


def _speculate():
    machine = Machine()
    return lambda r: [(r["cid"], r["c"], r["last"], r["first"], r["codes"], ENDING, machine.vectors(r["codes"], ENDING)[-1])]


def _fix_up(k: int):
    """Chunks of a run of 2 ** k neighbours come last one first; the run's last gets what its successor had before, each other what came out just now."""

    def make():
        machine, had = Machine(), [None, None]

        def step(r):
            run, ending = (r["cid"], r["c"] >> k), tuple(r["ending"])
            new = ENDING if r["last"] else had[1] if had[0] == run else tuple(r["incoming"])
            begin = machine.refit(r["codes"], ending, tuple(r["begin"]), new)
            had[:] = run, begin
            return [(r["cid"], r["c"], r["last"], r["first"], r["codes"], new, begin)]

        return step

    return make


def settled(parts: DataFrame) -> DataFrame:
    """Chunks with the vectors behind and ahead of each, once every chunk ends in what its successor begins with."""
    now = stored(_mapped(parts, _SPECULATED, _speculate), "turns-speculated")
    k = 0
    while True:
        met = now.withColumn("incoming", F.lead("begin").over(Window.partitionBy("cid").orderBy("c")))
        if met.where("NOT last AND incoming <> ending").isEmpty():
            return now
        k += 1
        dealt = met.withColumn("run", F.shiftright("c", k)).repartition("cid", "run").sortWithinPartitions("cid", "run", F.desc("c"))
        now = stored(_mapped(dealt, _SPECULATED, _fix_up(k)), "turns-settled")


def _exits():
    machine = Machine()
    return lambda r: [(r["cid"], r["c"], [machine.run(r["codes"], tuple(r["ending"]), s, False)[1] for s in range(4)])]


def _entries():
    had = [None, 0]

    def step(r):
        entry = had[1] if had[0] == r["cid"] else 0
        had[:] = r["cid"], r["exits"][entry]
        return [(r["cid"], r["c"], entry)]

    return step


def _edits():
    machine = Machine()

    def step(r):
        out, _ = machine.run(r["codes"], tuple(r["ending"]), r["entry"], r["last"])
        return [(r["first"] + i, r["codes"][i], *x) for i, x in enumerate(out)]

    return step


def edits(codes: DataFrame, shift: int = SHIFT) -> DataFrame:
    """place, code, edit (initials), ahead (initials of rows inserted ahead), brought (initial of the new role, or null), behind, for every coded row."""
    parts = chunks(codes, shift)
    split = parts.where("c > 0 OR NOT last")
    alone = parts.where("c = 0 AND last").withColumns({"ending": F.array(*(F.lit(x) for x in ENDING)), "entry": F.lit(0)})
    if not split.isEmpty():
        done = settled(split)
        exits = _mapped(done, "cid string, c int, exits array<int>", _exits).repartition("cid").sortWithinPartitions("cid", "c")
        entered = done.drop("begin").join(_mapped(exits, "cid string, c int, entry int", _entries), ["cid", "c"])
        alone = alone.unionByName(entered)
    return _mapped(alone, "place long, code string, edit string, ahead string, brought string, behind string", _edits)


def repair(convs: DataFrame, shift: int = SHIFT) -> DataFrame:
    """conv_id, cid, turn, role, text, place, initial, fault, edit, ahead, brought, behind for every row: what is wrong with it and what is done."""
    rows = numbered(convs)
    k = F.instr(F.lit(CODES), F.col("code")) - 1
    fault = F.element_at(F.array(*map(F.lit, FAULTS)), k % 4 + 1)
    return rows.join(edits(coded(rows), shift).withColumn("fault", fault), "place").withColumn("initial", F.left("role", F.lit(1))).drop("code")


def repaired(done: DataFrame) -> DataFrame:
    """conv_id, place, n, turn (null if inserted), role, text: the rows of repaired conversations in the order of place and n."""
    name = lambda i: F.when(i == "u", NAMES["u"]).otherwise(NAMES["a"])
    brought = lambda c: F.transform(F.filter(F.split(c, ""), lambda i: i != ""), lambda i: F.struct(F.lit(None).cast("long").alias("turn"), name(i).alias("role"), F.lit("").alias("text")))
    own = F.struct("turn", F.when(F.col("brought").isNull(), F.col("role")).otherwise(name(F.col("brought"))).alias("role"), "text")
    kept = F.when(F.contains("edit", F.lit("D")), F.array_remove(F.array(own), own)).otherwise(F.array(own))
    return done.select("conv_id", "place", F.posexplode(F.concat(brought(F.col("ahead")), kept, brought(F.col("behind")))).alias("n", "x")).select("conv_id", "place", "n", "x.*")


_REPORT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COSTS = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}


class _Report:
    """One conversation's counts, edits and hash, fed row by row in order."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.distinct, self.faults, self.illegal, self.cost, self.audit, self.hash, self.lines, self.last = conv_id, [], 0, dict.fromkeys(FAULTS, 0), 0, 0, [], hashlib.sha256(), 0, None

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def add(self, r: dict) -> None:
        if r["turn"] is not None and r["turn"] not in self.turns[1:]:
            self.turns, self.distinct = [(self.turns or [r["turn"]])[0], r["turn"]], self.distinct + 1
        if self.last is not None and self.last + r["initial"] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = r["initial"]
        self.faults[r["fault"]] += 1
        self.cost += sum(_COSTS[e] for e in r["edit"]) + (CUT if r["fault"] == "truncated" and "D" not in r["edit"] else 0)
        self.audit.append(r["edit"])
        for i in r["ahead"]:
            self.line(NAMES[i], "")
        if "D" not in r["edit"]:
            self.line(NAMES.get(r["brought"], r["role"]), r["text"])
        for i in r["behind"]:
            self.line(NAMES[i], "")

    def row(self) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return (self.conv_id, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def report(done: DataFrame) -> DataFrame:
    """A row for each conversation of repair(): faults, edits and the hash of what it became.

    A hash takes its text in order, so a task streams the rows of its conversations sorted; it holds one row and the edits' initials.
    """
    conv = done.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(_REPORT.replace("conv_id string", f"conv_id {conv}"))
    arrow = to_arrow_schema(schema)

    def run(batches):
        cid, now, out = None, None, []
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                for r in b.slice(at, 1024).to_pylist():
                    if now is None or r["cid"] != cid:
                        if now is not None:
                            out.append(now.row())
                        cid, now = r["cid"], _Report(r["conv_id"])
                    now.add(r)
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x, strict=True)) for x in out], arrow)
                    out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, now.row(), strict=True))], arrow)

    return done.repartition("cid").sortWithinPartitions("cid", "place").mapInArrow(run, schema)


def digest(convs: DataFrame, shift: int = SHIFT) -> DataFrame:
    """The report of every conversation after damage; those without a row left have zeros."""
    told = report(repair(damaged(convs), shift))
    filled = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    filled |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    ids = convs.select("conv_id").distinct().withColumn("cid", key_of(F.col("conv_id")))
    return ids.join(told.withColumn("cid", key_of(F.col("conv_id"))).drop("conv_id"), "cid", "left").drop("cid").withColumns(filled)

"""Secret scans: sliding-window Shannon entropy over candidate strings, with known formats and an allow list.

DataFrame functions only. Known formats (assign, access, hex) are found as they are. Other candidate
strings are runs of 20 or more key characters. Whatever the allow list explains within a run (and =,
which joins names and values) splits it into pieces; only the part that matches is suppressed. A window
of WINDOW characters slides over each piece of that length or more. The counts of its characters, and of
its digits, letters and signs, are carried along: a step raises the count of the character that enters
and lowers the one of the character that leaves, and updates the sum of c * log2 c by these two. The
window's character class follows from the carried counts, too. A piece with a window whose entropy
reaches its class's threshold, and that touches no known format, is a further span of kind entropy.

Pieces are scored in chunks of CHUNK characters (overlapping by a window less one), so a step costs the
same in a run of megabytes, and no pattern recurses on long texts. Null text is an empty text. Every row
gives one result row, repeated ids included; rows are told apart by their place in the scan. Ties do not
arise: all windows at or above a threshold count. Extra columns are ignored by scan(). An empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .common import stored

KINDS = ["assign", "access", "hex"]
#: The value of an assignment is its second group; a possessive run needs no second look.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "entropy": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
WINDOW, CHUNK = 20, 2048
#: Least bits a character by class; a window of 20 random hexadecimal digits has about 3.3, of letters and digits about 4.
THRESHOLDS = {"digits": 3.3, "hexadecimal": 2.9, "letters": 4.05, "one_case": 3.6, "mixed": 3.8}
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"
#: What is no secret within a run, with possessive repeats throughout: joints, UUIDs, alphabets and digits in order,
#: repeated patterns, numbers, and words (camel case included) with what joins them.
ALLOWED = [
    r"=++",
    r"(?<![0-9A-Fa-f-])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}+-[0-9a-fA-F]{12}(?![0-9A-Fa-f-])",
    r"(?i:0123456789|abcdefghij|qwertyuiop|example|placeholder|changeme)",
    r"(.{1,4})\1{3,}+",
    r"(?<![A-Za-z0-9])[0-9]{1,19}+(?![A-Za-z0-9])[+/_-]*+",
    r"(?<![A-Za-z0-9])(?:[A-Z]?+[a-z]{2,19}+(?![a-z]))++(?![A-Za-z0-9])[+/_-]*+",
    r"(?<![A-Za-z0-9])[A-Z]{3,19}+(?![A-Za-z0-9])[+/_-]*+",
]
_BETWEEN = "|".join(ALLOWED)


#: The kinds of a character, as counts that lie side by side in one number: digit, lower, upper, a-f, A-F.
_KINDS = [0, *((1 if c.isdigit() else 0) | c.islower() << 8 | c.isupper() << 16 | (c in "abcdef") << 24 | (c in "ABCDEF") << 32 for c in ALPHABET)]


def _limit(kinds: Column, window: int) -> Column:
    """The threshold of the class of a full window, from its carried counts of kinds."""
    digit, lower, upper, low_hex, up_hex = (F.shiftright(kinds, 8 * i).bitwiseAND(255) for i in range(5))
    return (
        F.when(lower + upper == 0, THRESHOLDS["digits"])
        .when((digit > 0) & (digit + low_hex + up_hex == window), THRESHOLDS["hexadecimal"])
        .when(digit == 0, THRESHOLDS["letters"])
        .when((lower == 0) | (upper == 0), THRESHOLDS["one_case"])
        .otherwise(THRESHOLDS["mixed"])
    )


def best_window(value: Column, window: int = WINDOW) -> Column:
    """struct(entropy, margin) of a string over ALPHABET at least as long as the window.

    entropy is the greatest of any window (bits), margin the greatest excess over its class's threshold.
    """
    chars = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))  # 1 is the digit 0
    long = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    kinds, names = long(_KINDS), [f"c{i}" for i in range(1 + len(ALPHABET) // 12)]
    # counts lie side by side, 12 in a number: the words of one character's count of 1
    ones = {name: long([1 << 5 * (c % 12) if c // 12 == i else 0 for c in range(len(ALPHABET) + 1)]) for i, name in enumerate(names)}
    logs = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)))  # n log2 n of a count n

    def held(acc: Column, c: Column) -> Column:
        return F.call_function("shiftright", F.get(F.array(*(acc[n] for n in names)), (c / 12).cast("int")), c % 12 * 5).bitwiseAND(31).cast("int")

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]  # leaves is 0 until the window is full
        n_in, n_out = held(acc, enters), F.when(leaves > 0, held(acc, leaves)).otherwise(1)
        s = acc["s"] + F.when(enters == leaves, 0.0).otherwise(F.get(logs, n_in + 1) - F.get(logs, n_in) + F.get(logs, n_out - 1) - F.get(logs, n_out))
        counts = [(acc[n] + F.get(ones[n], enters) - F.when(leaves > 0, F.get(ones[n], leaves)).otherwise(0)).alias(n) for n in names]
        now = F.struct(s.alias("s"), *counts, (acc["kinds"] + F.get(kinds, enters) - F.get(kinds, leaves)).alias("kinds"))

        def judged(t: Column) -> Column:
            e = F.lit(math.log2(window)) - t["s"] / window
            better = (x["at"] >= window) & (e - acc["margin"] >= min(THRESHOLDS.values()))
            return F.struct(
                t["s"].alias("s"), *(t[n].alias(n) for n in names), t["kinds"].alias("kinds"), F.when(x["at"] >= window, F.greatest(acc["entropy"], e)).otherwise(acc["entropy"]).alias("entropy"),
                F.when(better, F.greatest(acc["margin"], e - _limit(t["kinds"], window))).otherwise(acc["margin"]).alias("margin"),
            )

        return F.get(F.transform(F.array(now), judged), 0)

    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0.0).alias("s"), *(zero.alias(n) for n in names), zero.alias("kinds"), F.lit(0.0).alias("entropy"), F.lit(-99.0).alias("margin"))
    # the character that leaves stands window places before the one that enters
    before = F.concat(F.array_repeat(F.lit(0), window), chars)
    steps = F.zip_with(chars, F.zip_with(F.slice(before, 1, F.size(chars)), F.sequence(F.lit(1), F.size(chars)), lambda out, at: F.struct(out.alias("leaves"), at.alias("at"))), lambda c, o: F.struct(c.alias("enters"), o["leaves"].alias("leaves"), o["at"].alias("at")))
    return F.aggregate(steps, start, step, lambda acc: F.struct(acc["entropy"].alias("entropy"), acc["margin"].alias("margin")))


def pieces(runs: DataFrame, window: int = WINDOW) -> DataFrame:
    """rid, doc_id, start, stop, value of what the allow list leaves of each run, where a window fits. runs: rid, doc_id, start, value."""
    cut = runs.select("rid", "doc_id", F.col("start").alias("run"), F.split("value", _BETWEEN, -1).alias("g"), F.regexp_extract_all("value", F.lit(_BETWEEN), F.lit(0)).alias("m"))
    each = cut.select("rid", "doc_id", "run", F.posexplode(F.zip_with("g", "m", lambda g, m: F.struct(g.alias("g"), F.length(g) + F.coalesce(F.length(m), F.lit(0))))).alias("i", "p"))
    ends = Window.partitionBy("rid", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("run") + F.coalesce(F.sum("p.col2").over(ends), F.lit(0))
    placed = each.select("rid", "doc_id", start.alias("start"), F.col("p.g").alias("value"))
    return placed.where(F.length("value") >= window).select("rid", "doc_id", "start", (F.col("start") + F.length("value")).alias("stop"), "value")


def random_pieces(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Those pieces with a window of its class's entropy or more."""
    raw = F.col("value").cast("binary")  # one byte a character, reached without a walk from the start
    parts = F.sequence(F.lit(0), F.floor((F.length("value") - window) / CHUNK).cast("int"))
    chunks = found.select("*", F.explode(F.transform(parts, lambda k: F.substring(raw, k * CHUNK + 1, F.lit(CHUNK + window - 1)).cast("string"))).alias("chunk"))
    scored = chunks.where(best_window(F.col("chunk"), window)["margin"] >= 0)
    return scored.drop("chunk").distinct()


def matches(docs: DataFrame) -> DataFrame:
    """rid, doc_id, kind, start, stop, value, base: known formats and candidates that qualify; a null kind for each document."""
    gates = {
        "assign": F.col("text").rlike(r"[:=]") & F.lower("text").rlike("password|passwd|secret|token|api_?key"),
        "access": F.contains("text", F.lit("AKIA")),
        "hex": F.col("text").rlike("[0-9a-f]{32}"),
    }
    value = F.col("value")
    known = F.when(F.col("kind") == "assign", F.length(_assigned(value)) >= 8).when(F.col("kind") == "access", F.length(value) >= 16).when(F.col("kind") == "hex", True).otherwise(False)
    found = stored(spans.located(docs, PATTERNS, gates).withColumn("base", known), "secret-candidates")
    base = found.where("kind IS NULL OR base").select("rid", "doc_id", "kind", "start", "stop", "value", "base")
    more = random_pieces(pieces(found.where("kind = 'entropy'"))).select("rid", "doc_id", F.lit("entropy").alias("kind"), "start", "stop", "value", F.lit(False).alias("base"))
    both = base.where("kind IS NOT NULL").unionByName(more).withColumn("apart", spans.apart(F.col("base"))).where("base OR apart").drop("apart")
    return base.where("kind IS NULL").unionByName(both)


def _assigned(value: Column) -> Column:
    """The second group of an assignment: what follows the separator and an optional quote."""
    return F.regexp_extract(value, r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = matches(docs)
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    kinds = [*KINDS, "entropy"]
    base = spans.joined(kinds, F.col("base") & F.col("kind").isNotNull())
    return found.groupBy("rid", "doc_id").agg(*counts, F.sha2(base, 256).alias("base_sha256"), spans.joined(kinds, F.col("kind").isNotNull()).alias("spans")).drop("rid")

"""Places of pattern matches in texts, with DataFrame functions only. Positions are code points, ends exclusive.

A pattern's matches and the text between them (split at the same pattern) have lengths that add up
to positions; the sums are taken over the matches of one document and kind, after the rows of
documents without a match have been reduced to one marker each. Costs grow with the number of
matches, not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def located(docs: DataFrame, patterns: dict[str, str], gates: dict[str, Column] | None = None) -> DataFrame:
    """rid, doc_id, kind, start, stop, value, before, after: a row a match, and one with null kind for each document.

    before and after are up to 24 characters around the match. gates: conditions (over the column
    text) without which a pattern cannot match. Null text is an empty text.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = list(patterns)
    for i, kind in enumerate(names):
        got = F.regexp_extract_all("text", F.lit(patterns[kind]), F.lit(0))
        if gates and kind in gates:
            got = F.when(gates[kind], got)
        rows = rows.withColumn(f"m{i}", got)
    for i, kind in enumerate(names):
        rows = rows.withColumn(f"g{i}", F.when(F.size(f"m{i}") > 0, F.split("text", patterns[kind], -1)))
    each = [_structs(kind, i) for i, kind in enumerate(names)]
    found = rows.select("rid", "doc_id", F.explode_outer(F.concat(*each)).alias("m")).select("rid", "doc_id", "m.*")
    ends = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hits = found.where("kind IS NOT NULL").withColumn("stop", F.sum(F.col("gap") + F.length("value")).over(ends))
    hits = hits.select("rid", "doc_id", "kind", (F.col("stop") - F.length("value")).alias("start"), "stop", "value", "before", "after")
    marks = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id")
    none = marks.select("rid", "doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("start", "long"), ("stop", "long"), ("value", "string"), ("before", "string"), ("after", "string"))))
    return hits.unionByName(none)


def _structs(kind: str, i: int) -> Column:
    """The matches m{i} with their number, the length of the text g{i} before them and their surroundings."""
    gap = lambda j: F.get(f"g{i}", j)
    each = F.transform(f"m{i}", lambda m, j: F.struct(
        F.lit(kind).alias("kind"), j.alias("i"), m.alias("value"), F.length(gap(j)).alias("gap"),
        F.right(gap(j), F.lit(24)).alias("before"), F.left(gap(j + 1), F.lit(24)).alias("after")))
    return F.coalesce(each, F.array())


def apart(sure: Column) -> Column:
    """Whether a row (rid, start, stop) overlaps no other row of its document for which sure holds. Both windows only grow: linear."""
    order = (F.col("start"), F.col("stop"), sure)
    ahead = Window.partitionBy("rid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("rid").orderBy(*(c.desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.when(sure, F.col("stop"))).over(ahead), F.lit(-1)) > F.col("start")
    entered = F.coalesce(F.min(F.when(sure, F.col("start"))).over(behind), F.col("stop")) < F.col("stop")
    return ~(reached | entered)


def order_of(kinds: list[str], kind: Column) -> Column:
    at = F.lit(len(kinds))
    for i, k in enumerate(kinds):
        at = F.when(kind == k, i).otherwise(at)
    return at


def joined(kinds: list[str], keep: Column) -> Column:
    """Aggregate: kind:start:stop of the kept rows by start, then kind as listed, joined by commas."""
    item = F.struct(F.col("start"), order_of(kinds, F.col("kind")).alias("o"), F.col("stop"), F.col("kind"))
    spans = F.array_sort(F.collect_list(F.when(keep, item)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with each span (rid, start, stop, kind; rid as numbered by located) replaced by [KIND]; overlapping ones by the first."""
    held = Window.partitionBy("rid").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    first = spans.withColumn("reach", F.coalesce(F.max("stop").over(held), F.lit(0))).where("start >= reach")
    parts = first.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind", "reach"))).alias("s"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")).join(parts, "rid", "left")
    text = F.col("row.text")
    pieces = F.transform("s", lambda s: F.concat(F.substring(text, s["reach"] + 1, s["start"] - s["reach"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    last = F.element_at("s", -1)["stop"]
    new = F.when(F.col("s").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text))))
    return rows.select(F.col("row").withField("text", new).alias("row")).select("row.*")

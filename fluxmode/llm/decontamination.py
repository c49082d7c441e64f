"""Benchmark decontamination by a broadcast hash set of normalised test n-grams. DataFrame functions only.

Words are runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII. A window
is 13 consecutive words of a benchmark item; an item of fewer words, but not none, is one window.
Each document is split once, its word windows are laid out in chunks, hashed and looked up in the
broadcast set; on a hash match the words themselves are compared. A document's own words covered by
any matching window are hit. Where the windows are too large to broadcast, a broadcast of their hashes
lets only hits reach a shuffled join with them; only beyond MAX_KEYS hashes is every position shuffled.

Null texts have no words; items without words never match; items with a null id match but are not
counted. Every row of docs gives one result row, repeated ids included. Rows are told apart by their
place in the scan, so docs should be a scan or a stored table. An empty table, of documents or items,
gives no rows or no hits. Documents are laid out in chunks, so a very long one is many small rows. Extra columns are ignored by hits() and kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, spread_join, stored

N = 13
#: Positions of one chunk of a document; bytes of windows that may be broadcast, and beyond them window hashes that may be.
CHUNK, MAX_BROADCAST, MAX_KEYS = 1024, 64 << 20, 4_000_000
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD), "")


def _key(fields: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(fields)), *fields)


def test_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows: h, gram (words, each followed by a space), k (its words), items (ids as sorted strings)."""
    split = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    each = split.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("g"))
    got = [F.get("g", F.lit(i)) for i in range(n)]
    h = F.lit(None).cast("long")
    for k in range(1, n + 1):
        h = F.when(F.size("g") == k, _key(got[:k])).otherwise(h)
    rows = each.select("item", h.alias("h"), F.concat_ws(" ", "g", F.array(F.lit(""))).alias("gram"), F.size("g").alias("k"))
    return rows.groupBy("h", "gram", "k").agg(F.array_sort(F.collect_set("item")).alias("items"))


def occurrences(docs: DataFrame, tests: DataFrame, n: int = N) -> DataFrame:
    """rid, doc_id, n_words, and start, k, items where a window occurs; a document has a row without them besides."""
    stats = tests.groupBy("k").agg(F.sum(F.length("gram") + F.lit(40) + 12 * F.size("items")).alias("bytes"), F.count("*").alias("n")).collect()  # n rows at most
    lengths, total = sorted(r["k"] for r in stats), sum(r["bytes"] for r in stats)
    split = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), words(F.col("text")).alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / CHUNK).cast("int")), lambda i: F.slice("w", i * CHUNK + 1, F.lit(CHUNK + n - 1)))
    chunks = split.select("rid", "doc_id", F.size("w").alias("n_words"), F.posexplode_outer(F.when(F.size("w") > 0, cut)).alias("c", "chunk"))
    longest = max(lengths, default=1)
    zipped = F.arrays_zip(F.col("chunk"), *(F.slice("chunk", i + 1, F.lit(CHUNK + n)) for i in range(1, longest)))
    at = chunks.select("rid", "doc_id", "n_words", "c", F.posexplode_outer(zipped).alias("p", "z"))
    fields = [F.col(f"z.{name}") for name in ["chunk", *map(str, range(1, longest))]]
    start = (F.col("c") * CHUNK + F.col("p")).alias("start")
    parts = []
    valid = lambda k: fields[k - 1].isNotNull() & (F.col("p") < CHUNK)
    if len(lengths) == 1:
        k = lengths[0]
        laid = at.select("rid", "doc_id", "n_words", start, F.when(valid(k), _key(fields[:k])).alias("key"), F.lit(k).alias("own_k"), "z")
    else:
        parts = [F.struct(F.lit(k).alias("k"), F.when(valid(k), _key(fields[:k])).alias("key")) for k in lengths] or [F.struct(F.lit(0).alias("k"), F.lit(None).cast("long").alias("key"))]
        laid = at.select("rid", "doc_id", "n_words", start, F.explode(F.array(*parts)).alias("o"), "z").select("rid", "doc_id", "n_words", "start", F.col("o.key").alias("key"), F.col("o.k").alias("own_k"), "z")
    fields = [F.col(f"z.{name}") for name in ["chunk", *map(str, range(1, longest))]]
    text = F.lit(None).cast("string")
    for k in lengths:
        text = F.when(F.col("own_k") == k, F.concat_ws(" ", *fields[:k], F.lit(""))).otherwise(text)
    # two one-sided comparisons: an equality would become part of the hashed key of every window
    same = (F.col("key") == F.col("h")) & F.startswith(text, F.col("gram")) & F.startswith(F.col("gram"), text)
    if total > MAX_BROADCAST:
        held = laid.where("key IS NOT NULL")
        if sum(r["n"] for r in stats) <= MAX_KEYS:
            held = held.join(F.broadcast(tests.select(F.col("h").alias("key")).distinct()), "key", "left_semi")
        marks = split.select("rid", "doc_id", F.size("w").alias("n_words"), *(F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("k", "int"), ("items", "array<string>"))))
        # a window that a third of all documents hold is dealt over tasks
        sizes = held.groupBy("key").agg(F.count("*").alias("times"))
        keyed = stored(tests.withColumn("key", F.col("h")).join(sizes, "key"), "test-sizes")
        return spread_join(held, keyed, ["key"], "times").where(same).select("rid", "doc_id", "n_words", "start", "k", "items").union(marks)
    first = F.coalesce(F.col("start"), F.lit(0)) == 0
    if len(lengths) > 1:
        first = first & (F.coalesce(F.col("own_k"), F.lit(lengths[0])) == lengths[0])
    return laid.join(F.broadcast(tests), same, "left").where(F.col("h").isNotNull() | first).select("rid", "doc_id", "n_words", "start", "k", "items")


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row for each row of docs: rid, doc_id, n_words, n_hit, n_items, items, spans, contaminated.

    spans are the hit ranges of word positions (start, stop), joined where they touch.
    """
    found = occurrences(docs, stored(test_windows(benchmark, n), "test-windows"), n)
    grouped = found.groupBy("rid", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("k").isNotNull(), F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("k")).cast("long").alias("stop"))))).alias("o"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("o", lambda x: F.sequence(x["start"], x["stop"] - 1)))))
    begins = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1))
    n_hit = F.size("p").cast("long")
    return grouped.withColumn("p", covered).select(
        "rid", "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        F.zip_with(begins, ends, lambda a, z: F.struct(a.alias("start"), (z + 1).alias("stop"))).alias("spans"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, spans: bool = False) -> DataFrame:
    """docs without contaminated rows; with spans=True, every hit word is cut from the texts that stay instead."""
    numbered = docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct("*").alias("_row"))
    found = hits(docs, benchmark)
    if not spans:
        bad = found.where("contaminated").select(F.col("rid").alias("_rid"))
        return numbered.join(bad, "_rid", "left_anti").select("_row.*")
    hit = found.where("n_hit > 0").select(F.col("rid").alias("_rid"), "spans")
    text = F.col("_row.text")
    # each word with what stands before it; the last piece is what follows the last word
    pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*(?:[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|$)"), F.lit(0))
    kept = F.filter(pieces, lambda x, i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i < s["stop"])))
    return numbered.join(hit, "_rid", "left").select(F.col("_row").withField("text", F.when(F.col("spans").isNotNull(), F.array_join(kept, "")).otherwise(text)).alias("_row")).select("_row.*")

"""MinHash near-dedup by min-max hashing: both the minimum and the maximum under each permutation.

A document's set holds the distinct k-word shingles of its whole lower-cased (A-Z) text. Each of the
PERMUTATIONS hash evaluations gives two signature values; a band takes the two of ROWS_PER_BAND / 2
permutations. With 48 bands of 6 values a pair of similarity 0.8 is missed with probability 5e-7.

1. Documents with one and the same set fall into one class, whose least id stands for it.
2. Classes that share a band meet in a bucket. Each is tried against one hub of the bucket, on full
   sets (100 * intersection >= 80 * union); most copies are connected then, into parts.
3. A bucket whose members lie in more than one part stays open; of open buckets with the same members
   one is looked at. There the members outside the bucket's largest part are compared with all members,
   block against block, inside tasks: no pair is laid out as a row, members of the largest part meet
   the others only, and no link between parts is left out.
4. Parts that such links join are components, which give each document the least id it can reach.

A hot class is folded by a partial aggregate, and a hot bucket costs as many tries as it has members;
what stays open of it is spread over blocks of bounded size. Tables between steps lie in the shared folder.

Null and empty texts have an empty set and link with nothing. Rows that share an id are one document
of the graph; null ids take part through their class alone (component null if no id is in it). Ties
do not arise: the least id decides. An empty table gives an empty result. Extra columns are ignored
by groups() and kept by dedup(). Texts are hashed in segments, so a very long one costs its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import connected_components, fresh, spread_join, stored

PERMUTATIONS, ROWS_PER_BAND = 144, 6
BANDS = 2 * PERMUTATIONS // ROWS_PER_BAND
#: Similarity in hundredths, words of a shingle, ids that may be broadcast, shingles of a block (but one set at least).
LEVEL, SHINGLE, MAX_BROADCAST_IDS, BLOCK = 80, 2, 1_000_000, 1 << 17
_rng = np.random.default_rng(7102)
_A = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    h, at = kernel.word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    pair = kernel.mix(kernel.windows(h, k)) if len(h) >= k else np.zeros(0, np.uint64)
    out = []
    for a, z in zip(at[:-1], at[1:], strict=True):
        if z - a >= k:
            out.append(np.unique(pair[a : z - k + 1]))
        elif z > a:  # the whole sequence as one shingle; its length keeps it apart from longer ones
            out.append(kernel.mix(kernel.windows(h[a:z], int(z - a)) ^ np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band hashes (sets x BANDS) of concatenated non-empty sets that begin at starts."""
    sig = np.empty((len(starts), PERMUTATIONS, 2), np.uint64)
    buf = np.empty_like(values)
    for p in range(PERMUTATIONS):
        np.multiply(values, _A[p], out=buf)
        np.add(buf, _B[p], out=buf)
        sig[:, p, 0] = np.minimum.reduceat(buf, starts)
        sig[:, p, 1] = np.maximum.reduceat(buf, starts)
    rows = sig.reshape(len(starts), BANDS, ROWS_PER_BAND)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(starts), BANDS)).copy()
    for r in range(ROWS_PER_BAND):
        out = kernel.mix(out * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, :, r])
    return out


def _sketches(sets: list[np.ndarray], chunk: int = 1 << 15):
    """n, two fingerprints and bands of each set, worked on in chunks that fit the processor's cache."""
    n = np.array([len(s) for s in sets], np.int64)
    fp = np.zeros((len(sets), 2), np.uint64)
    bands = np.zeros((len(sets), BANDS), np.uint64)
    todo = np.flatnonzero(n)
    group, size = [], 0
    for j, i in enumerate(todo):
        group.append(i)
        size += n[i]
        if size >= chunk or j == len(todo) - 1:
            values = np.concatenate([sets[i] for i in group])
            starts = np.concatenate(([0], np.cumsum(n[group])[:-1]))
            for c, salt in enumerate((0x51, 0xA7)):
                fp[group, c] = np.add.reduceat(kernel.mix(values ^ np.uint64(salt)), starts)
            bands[group] = signature(values, starts)
            group, size = [], 0
    return n, fp.view(np.int64), bands.view(np.int64)


def sketch(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2, bands (array<long>) for every row of docs."""

    def run(batches):
        for b in batches:
            for at, end in kernel.slices(b.column(1), 512):
                part = b.slice(at, end - at)
                n, fp, bands = _sketches(shingle_sets(part.column(1).to_pylist(), k))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(np.ascontiguousarray(fp[:, 0])), pa.array(np.ascontiguousarray(fp[:, 1])), flat], ["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def _sets_of(docs: DataFrame, active: DataFrame, k: int) -> DataFrame:
    """id, shingles (sorted 64-bit hashes) of the active ids."""
    few = active.count() <= MAX_BROADCAST_IDS  # 8 bytes each
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(active) if few else active, "id", "left_semi")

    def run(batches):
        for b in batches:
            for at, end in kernel.slices(b.column(1), 512):
                part = b.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1).to_pylist(), k)], pa.binary())], ["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles binary").dropDuplicates()


def confirmed(pairs: DataFrame, sets: DataFrame, level: int = LEVEL) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            left, right, good = batch.column(2), batch.column(3), []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                # distinct values of both sets: sorted together, equal neighbours are shared
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= level * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    # a hub meets all its near copies: its set goes to the tasks they are dealt over
    asked = stored(pairs.groupBy("b").agg(F.count("*").alias("n")), "near-asked")
    two = spread_join(one, sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")).join(asked, "b"), ["b"], "n").select("a", "b", "sa", "sb")
    return two.mapInArrow(run, "a long, b long").distinct()


def components(docs: DataFrame, classes: DataFrame, k: int = SHINGLE, level: int = LEVEL) -> DataFrame:
    """rep, component of the classes that share a bucket with another. classes: rep, n_shingles, bands."""
    laid = classes.where("rep IS NOT NULL").select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    full = stored(laid.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("far"), F.count("*").alias("n")).where("hub < far").drop("far"), "near-buckets")
    seen = stored(spread_join(laid, full, ["bucket"], "n").select("bucket", "rep", "n_shingles", "hub"), "near-seen")
    met = stored(seen.where("rep <> hub").select("rep", "n_shingles", "hub").distinct(), "near-met")
    active = stored(met.select("rep").union(met.select("hub")).distinct(), "near-active")
    sets = stored(_sets_of(docs, active.withColumnRenamed("rep", "id"), k), "near-sets")
    sizes = classes.select(F.col("rep").alias("hub"), F.col("n_shingles").alias("hub_n"))
    sized = (F.col("n_shingles") * 100 >= level * F.col("hub_n")) & (F.col("hub_n") * 100 >= level * F.col("n_shingles"))
    of_hub = stored(met.groupBy("hub").agg(F.count("*").alias("n")).join(sizes, "hub"), "near-hubs")
    tried = stored(spread_join(met, of_hub, ["hub"], "n").where(sized).select(F.col("rep").alias("a"), F.col("hub").alias("b")), "near-tried")
    parts = connected_components(stored(confirmed(tried, sets, level), "near-links"), "near-parts").select(F.col("node").alias("rep"), F.col("component").alias("part"))
    parts = stored(active.join(parts, "rep", "left").select("rep", F.coalesce("part", "rep").alias("part")), "near-named")
    between = stored(_between_parts(seen.join(parts, "rep"), sets, level), "near-between")
    joined = connected_components(between, "near-joined")
    return parts.join(joined, F.col("part") == F.col("node"), "left").select("rep", F.coalesce("component", "part").alias("component"))


def _between_parts(members: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Links (a, b) between different parts that meet in a bucket, by the names of the parts. members: bucket, rep, n_shingles, part.

    Members outside the largest part of a bucket are dealt into `few` blocks of about BLOCK shingles, all
    members into `all` blocks, and each pair (x of few, y of all) is one group.
    """
    each = members.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"), *(F.sum(F.xxhash64("rep", F.lit(i)).cast("decimal(38,0)")).alias(f"f{i}") for i in range(2)))
    whole = each.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("n", "part", "m")).alias("big"), F.sum("n").alias("of"), F.sum("m").alias("m"), F.sum("f0").alias("f0"), F.sum("f1").alias("f1")).where("parts > 1")
    one = whole.groupBy("f0", "f1", "m").agg(F.min("bucket").alias("bucket"), F.first("big").alias("big"), F.first("of").alias("of"))  # buckets of the same members
    blocks = lambda m: F.ceil(m / F.lit(BLOCK)).cast("int")
    open_ = stored(one.select("bucket", "of", F.col("big.part").alias("largest"), blocks(F.col("m")).alias("all"), blocks(F.col("m") - F.col("big.m")).alias("few")), "near-open")
    held = spread_join(members, open_, ["bucket"], "of").withColumn("asks", F.col("part") != F.col("largest"))
    x, y = F.pmod(F.xxhash64("rep"), F.col("few")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("all")).cast("int")
    cell = lambda x, y, asks, answers: F.struct(x.alias("x"), y.alias("y"), asks.alias("asks"), answers.alias("answers"))
    yes, no = F.lit(True), F.lit(False)
    asked = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda i: cell(i, y, F.col("asks") & (i == x), yes))
    asking = F.filter(F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda j: cell(x, j, yes, no)), lambda c: F.col("asks") & (c["y"] != y))
    dealt = held.select("bucket", "rep", "part", F.explode(F.concat(asked, asking)).alias("c")).select("bucket", "c.x", "c.y", "c.asks", "c.answers", "rep", "part")
    laid = dealt.join(sets.withColumnRenamed("id", "rep"), "rep").select("bucket", "x", "y", "asks", "answers", "part", "shingles")

    def run(batches):
        rows, key = [], None
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            asks, answers, parts = (b.column(i).to_pylist() for i in (3, 4, 5))
            for i, now in enumerate(keys):
                if now != key:
                    if len(rows) > 1:
                        yield _block_links(rows, level)
                    rows, key = [], now
                rows.append((asks[i], answers[i], parts[i], b.column(6)[i].as_py()))
        if len(rows) > 1:
            yield _block_links(rows, level)

    # the columns of a pair of blocks are the key of the deal and of the order
    return laid.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _block_links(rows: list[tuple], level: int) -> pa.RecordBatch:
    """For each member that asks, one link to each other part with a member that answers and is similar enough."""
    asks, answers = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    parts = np.array([r[2] for r in rows], np.int64)
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    n = np.array([len(s) for s in sets])
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    mark = np.zeros(len(names), np.int64)
    a, b = [], []
    for i in np.flatnonzero(asks):
        facing = answers & (parts != parts[i]) & (100 * np.minimum(n, n[i]) >= level * np.maximum(n, n[i]))
        if not facing.any():
            continue
        mine = codes[starts[i] : starts[i] + n[i]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[codes], starts)
        mark[mine] = 0
        hit = np.unique(parts[facing & (100 * shared >= level * (n + n[i] - shared))])
        a += [parts[i]] * len(hit)
        b += hit.tolist()
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def groups(docs: DataFrame, k: int = SHINGLE, level: int = LEVEL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    rows = stored(sketch(docs, k), "near-sketches")
    classes = stored(
        rows.where("n_shingles > 0").groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("n")),
        "near-classes",
    )
    reps = classes.join(components(docs, classes, k, level), "rep", "left").select("fp1", "fp2", "n_shingles", "n", F.coalesce("component", "rep").alias("of"))
    # copies of one text are dealt over tasks; documents without a set meet nothing
    met = spread_join(rows.where("n_shingles > 0").drop("bands"), stored(reps, "near-reps"), ["fp1", "fp2", "n_shingles"], "n", "left")
    out = met.select("doc_id", "n_shingles", "of").union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    component = F.when(F.col("n_shingles") > 0, F.col("of")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def dedup(docs: DataFrame, k: int = SHINGLE, level: int = LEVEL) -> DataFrame:
    """The rows of docs of which their group keeps one (the least id), with all their columns."""
    name = fresh(docs, "gone")
    gone = groups(docs, k, level).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name))
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")

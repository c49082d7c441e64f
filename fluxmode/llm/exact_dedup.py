"""Exact dedup by an extendible-hash index on shared files.

Texts are equal when they are identical after lower-casing A-Z. The index has a directory of 2^g
slots, addressed by the leading g bits of a 64-bit key; a bucket that would hold more distinct keys
than its capacity is split on its next bit, and the directory doubles when a bucket's local depth
passes the global one. Each bucket has one owner task; an owner holds a range of neighbouring buckets of
about OWNER_BYTES of text, gets its key range sorted, chains entries of one key and compares the bytes of
their texts. The entries lie in the shared folder. The capacity grows with the number of keys, so the
directory has at most about MAX_BUCKETS buckets and the driver at most 16 counts for each.

Copies are folded within each Arrow batch before anything is shuffled, so a text held by a third of
all rows reaches its owner as one row a batch; the owner streams its rows and holds one chain only.

Rows with null text count as empty texts; of equal texts the row with the largest id stays (null ids
are smallest; of rows equal in both, any one stays). Other columns, of whatever name, ride along
untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread_join, stored

#: Distinct keys a bucket holds before it is split (more where else there were over MAX_BUCKETS buckets), and bytes of text of an owner.
CAPACITY, MAX_BUCKETS, OWNER_BYTES = 8192, 1 << 16, 256 << 20
_LOW = -(2**63)


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only


def _key(norm: bytes) -> int:
    return xxhash.xxh3_64_intdigest(norm)


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One entry a row of docs: doc_id, key, text_sha256, size (bytes)."""

    def scan(batches):
        for b in batches:
            norm = [normalised(x) for x in b.column(1).to_pylist()]
            keys = np.array([_key(x) for x in norm], np.uint64).view(np.int64)
            sha = [hashlib.sha256(x).hexdigest() for x in norm]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(keys), pa.array(sha), pa.array([len(x) for x in norm], pa.int32())], ["doc_id", "key", "text_sha256", "size"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(scan, "doc_id long, key long, text_sha256 string, size int")


class Directory:
    """slots[leading global_depth bits of a key] = bucket; depths and sizes[bucket] = its local depth and keys; owners[bucket] = its owner."""

    def __init__(self, slots: np.ndarray, depths: list[int], sizes: np.ndarray, global_depth: int):
        self.slots, self.depths, self.sizes, self.global_depth = slots, depths, sizes, global_depth
        self.own(len(depths))

    def own(self, count: int) -> None:
        """Deal the buckets, in order, to at most count owners of about equal keys."""
        before = np.cumsum(self.sizes) - self.sizes
        self.owners = (before * max(1, min(count, len(self.depths))) // max(1, int(self.sizes.sum()))).astype(np.int32)

    @classmethod
    def grown(cls, histogram: dict[int, int], fine_depth: int, capacity: int) -> Directory:
        """Splits overfull buckets until each holds at most capacity keys, or fine_depth is reached."""
        fine = np.zeros(1 << fine_depth, np.int64)
        for slot, n in histogram.items():
            fine[slot] = n
        filled = np.concatenate(([0], np.cumsum(fine)))
        depth, slots = 0, np.zeros(1, np.int64)
        buckets, todo = {0: (0, 0)}, [0]  # id: (prefix, local depth)
        while todo:
            at = todo.pop()
            prefix, local = buckets[at]
            width = fine_depth - local
            if filled[(prefix + 1) << width] - filled[prefix << width] <= capacity or local == fine_depth:
                continue
            if local == depth:  # the directory doubles
                slots, depth = np.repeat(slots, 2), depth + 1
            new = len(buckets)
            buckets[at], buckets[new] = (prefix << 1, local + 1), ((prefix << 1) + 1, local + 1)
            span = depth - local - 1
            slots[((prefix << 1) + 1) << span : ((prefix << 1) + 2) << span] = new
            todo += [at, new]
        order = {b: i for i, (b, _) in enumerate(sorted(buckets.items(), key=lambda x: x[1][0] << (fine_depth - x[1][1])))}
        depths, sizes = [0] * len(order), np.zeros(len(order), np.int64)
        for b, (prefix, local) in buckets.items():
            width = fine_depth - local
            depths[order[b]], sizes[order[b]] = local, filled[(prefix + 1) << width] - filled[prefix << width]
        return cls(np.array([order[b] for b in slots], np.int32), depths, sizes, depth)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        u = keys.view(np.uint64)
        return self.slots[(u >> np.uint64(64 - self.global_depth)).astype(np.int64)] if self.global_depth else np.zeros(len(keys), np.int32)


def build_directory(index: DataFrame, capacity: int = CAPACITY) -> Directory:
    """Counts distinct keys by leading bits (at most about 16 * MAX_BUCKETS counts reach the driver) and grows the directory. index: key, size."""
    n, total = index.agg(F.approx_count_distinct("key"), F.coalesce(F.sum("size"), F.lit(0))).first()
    capacity = max(capacity, -(-n // MAX_BUCKETS))
    depth = 1
    while (n >> depth) * 8 > capacity:
        depth += 1
    slot = F.expr(f"cast(shiftrightunsigned(key, {64 - depth}) as int)")
    counts = index.select("key").distinct().groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).toArrow()
    found = Directory.grown(dict(zip(counts["slot"].to_pylist(), counts["n"].to_pylist(), strict=True)), depth, capacity)
    found.own(max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_BYTES)))
    return found


def classes(docs: DataFrame, directory: Directory, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct text: payload (the whole row of docs that stays), key, text_sha256, group_size."""
    spark = docs.sparkSession
    owners = spark.sparkContext.broadcast(directory)
    packed = docs.select(F.struct("*").alias("payload"), F.col(id_col).cast("long").alias("id"))
    place = [c.lower() for c in docs.columns].index(text_col.lower())  # the text travels once, within the row
    routed = T.StructType([*packed.schema.fields, *(T.StructField(c, T.LongType()) for c in ("key", "n")), T.StructField("owner", T.IntegerType())])

    def texts(b):
        return b.column(0).field(place).cast(pa.string())

    def fold(batches):
        for b in batches:
            norm = [normalised(x) for x in texts(b).to_pylist()]
            ids, best, n = b.column(1).to_pylist(), {}, {}
            for i, t in enumerate(norm):
                n[t] = n.get(t, 0) + 1
                if t not in best or (ids[i] is not None and (ids[best[t]] is None or ids[i] > ids[best[t]])):
                    best[t] = i
            keys = np.array([_key(t) for t in best], np.uint64).view(np.int64)
            rows = b.take(pa.array(list(best.values()), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(keys), pa.array(list(n.values()), pa.int64()), pa.array(owners.value.owners[owners.value.bucket(keys)], pa.int32())],
                schema=pa.schema([*b.schema, ("key", pa.int64()), ("n", pa.int64()), ("owner", pa.int32())]),
            )

    def own(batches):
        chain, last = [], None  # chain: [bytes, one-row slice, id, n] of each distinct text of the key `last`

        def closed():
            rows = pa.Table.from_batches([c[1] for c in chain])
            rows = rows.append_column("text_sha256", pa.array([hashlib.sha256(c[0]).hexdigest() for c in chain], pa.string()))
            return rows.append_column("group_size", pa.array([c[3] for c in chain], pa.int64()))

        for b in batches:
            keys, n = b.column(2).to_numpy(), b.column(3).to_pylist()
            ids, text, out = b.column(1).to_pylist(), texts(b), []
            for i in range(len(keys)):
                if keys[i] != last:
                    if chain:
                        out.append(closed())
                    chain, last = [], keys[i]
                t = normalised(text[i].as_py())
                for c in chain:
                    if c[0] == t:  # the bytes are compared, not the keys
                        c[3] += n[i]
                        if (_LOW if ids[i] is None else ids[i]) > (_LOW if c[2] is None else c[2]):
                            c[1], c[2] = b.slice(i, 1), ids[i]
                        break
                else:
                    chain.append([t, b.slice(i, 1), ids[i], n[i]])
            if out:
                yield from pa.concat_tables(out).select([0, 2, 5, 6]).combine_chunks().to_batches()
        if chain:
            yield from closed().select([0, 2, 5, 6]).combine_chunks().to_batches()

    kept = T.StructType([routed["payload"], routed["key"], T.StructField("text_sha256", T.StringType()), T.StructField("group_size", T.LongType())])
    dealt = packed.mapInArrow(fold, routed).repartitionById(int(directory.owners.max()) + 1, F.col("owner"))
    return dealt.sortWithinPartitions("key").mapInArrow(own, kept)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    index = stored(entries(docs, id_col, text_col).select("key", "size"), "exact-index")
    return classes(docs, build_directory(index, capacity), id_col, text_col).select("payload.*")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    index = stored(entries(docs, id_col, text_col), "exact-index")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = classes(slim, build_directory(index, capacity), "doc_id").select("key", "text_sha256", F.col("payload.doc_id").alias("keep_id"), "group_size")
    found = stored(found, "exact-classes")
    return spread_join(index.drop("size"), found, ["key", "text_sha256"], "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )

"""Substring dedup by level-wise doubling of repeated word windows.

Words are runs without white space, unchanged. A window is WINDOW (20) consecutive words of one
document. Each word covered by a window whose word sequence also starts earlier (smaller doc_id, or
the same document and an earlier start) is removed; windows are judged on the input.

Lengths double from 5 to 10 to 20. At each length below the last a window of 20 is represented by
the part of that length whose hash is least (equal windows choose the same part), so that a small
share of the parts needs counting. Only windows whose part occurs twice or more go on to twice the
length; when none does, the search ends. At the full length the least place of each window stays and
the others' words go; a window is then known by two hashes of 64 bits with different factors (shorter
parts by one, as an accident there only sends a window on). Nothing is sampled: a repeated window has
repeated parts at every length.

Counts and least places are partial aggregates, and the places of a passage in a third of all documents
are dealt over many tasks. What a document needs to know of its own windows comes back packed, one row a
document. It is broadcast if MAX_BROADCAST bytes hold all of it; beyond that the texts are written once
as a table bucketed by row, to which each level's lists are dealt, so texts are shuffled once. Texts of
any length are hashed in segments, and a task works on a few documents of about kernel.SEGMENT bytes.

Null texts have no words. Rows that share an id are one document: none of them is earlier at equal
starts; a start is a first place only in the rows that have this very window there. Null ids come before
all others. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import noted
from . import kernel
from .common import shared_dir, spread_join, stored

WINDOW, LENGTHS = 20, (5, 10)
#: Bytes of packed positions that may be broadcast, bytes of text of a bucket, and documents hashed at once.
MAX_BROADCAST, BUCKET_BYTES, GROUP = 32 << 20, 128 << 20, 256
_NULL_ID = -(2**63)
#: Bits for a position among the words hashed at once: a text has less than 2^31 bytes.
_PLACE = np.uint64(31)
_SECOND = 0xA0761D6478BD642F


def _pack(positions: np.ndarray) -> bytes:
    p = np.unique(np.asarray(positions, np.int64))
    return zlib.compress(np.diff(p, prepend=0).astype("<u4").tobytes(), 1)


def _unpack(packed: bytes | None) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)) if packed else np.zeros(0, np.int64)


class _Words:
    """Word hashes of a few documents and the starts at which a window fits within one document."""

    def __init__(self, texts: list[bytes], window: int):
        self.h, self.at = kernel.word_hashes(texts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.at))
        self.window = window
        n = max(0, len(self.h) - window + 1)
        self.fits = self.doc[:n] == self.doc[window - 1 : window - 1 + n] if n else np.zeros(0, bool)

    def parts(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each start the position of the part of its window that represents it, and all parts' hashes."""
        hashes = kernel.mix(kernel.windows(self.h, length))
        n = len(self.fits)
        if not n:
            return np.zeros(0, np.int64), hashes
        # the high bits of a hash above its position: the leftmost of equals is least
        low = (hashes >> _PLACE << _PLACE) | np.arange(len(hashes), dtype=np.uint64)
        width, reach = 1, self.window - length + 1
        while width < reach:
            step = min(width, reach - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        return (low[:n] & np.uint64((1 << 31) - 1)).astype(np.int64), hashes

    def listed(self, packed: list[bytes | None]) -> np.ndarray:
        """Marks at the listed positions (within each document) of all documents."""
        mark = np.zeros(len(self.h) + 1, bool)
        for i, p in enumerate(packed):
            if p:
                own = _unpack(p) + self.at[i]
                mark[own[own < self.at[i + 1]]] = True
        return mark


class Rows:
    """id, row, text, and whether an id has unlike texts. Lists of positions are kept by row: the id, or then a hash of id and text.

    Rows of one id and text have the same words at the same places, so they may share their lists.
    """

    def __init__(self, docs: DataFrame):
        rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        each = rows.select("id", F.xxhash64("text").alias("t")).groupBy("id").agg(F.min("t").alias("low"), F.max("t").alias("high"))
        self.shared = not each.where("low <> high").isEmpty()
        self.scan = rows.select("id", (F.xxhash64("id", "text") if self.shared else F.col("id")).alias("row"), "text")
        self._bucketed = None

    def bucketed(self) -> DataFrame:
        """The same rows as a table in the shared folder, dealt by row: a join on row does not shuffle them again."""
        if self._bucketed is None:
            spark = self.scan.sparkSession
            size = self.scan.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
            name = f"texts_{uuid.uuid4().hex}"
            self.scan.repartition(n, "row").write.bucketBy(n, "row").option("path", noted(spark, f"{shared_dir(spark)}/{name}", name)).saveAsTable(name)
            self._bucketed = spark.table(name)
        return self._bucketed

    def joined(self, lists: dict[str, DataFrame | None], how: str) -> DataFrame:
        """The rows with their packed positions, a column for each name."""
        given = {name: df.select("row", F.col("packed").alias(name)) for name, df in lists.items() if df is not None}
        few = {name: (df.agg(F.sum(F.octet_length(name) + 64)).first()[0] or 0) <= MAX_BROADCAST for name, df in given.items()}
        out = self.scan if all(few.values()) else self.bucketed()
        for name in lists:
            out = out.join(F.broadcast(given[name]) if few[name] else given[name].hint("shuffle_hash"), "row", how) if name in given else out.withColumn(name, F.lit(None).cast("binary"))
        return out


def _encoded(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _packed(positions: DataFrame, label: str) -> DataFrame:
    """row, packed positions. positions: row, p."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_pack(np.array(p.values, np.int64)) for p in b.column(1)], pa.binary())], ["row", "packed"])

    return stored(positions.groupBy("row").agg(F.collect_set("p").alias("p")).mapInArrow(run, "row long, packed binary"), label)


def _surviving(words: _Words, packed: list | None, length: int | None) -> np.ndarray:
    """Starts whose windows fit and whose part of the last length was repeated."""
    if length is None:
        return np.flatnonzero(words.fits)
    part, _ = words.parts(length)
    return np.flatnonzero(words.fits & words.listed(packed)[part])


def _emit(rows: DataFrame, window: int, before: int | None, length: int) -> DataFrame:
    """h, g, id, row, p of the parts (or, at the full length, windows) of all surviving windows. rows: id, row, text, packed.

    g is the second hash of a full window, and null for shorter parts.
    """

    def run(batches):
        for b in batches:
            for at, end in kernel.slices(b.column(2), GROUP):
                part = b.slice(at, end - at)
                words = _Words(_encoded(part.column(2)), window)
                starts = _surviving(words, part.column(3).to_pylist(), before)
                if length < window:
                    where, hashes = words.parts(length)
                    p, second = np.unique(where[starts]), None
                else:
                    p, hashes, second = starts, kernel.mix(kernel.windows(words.h, window)), kernel.mix(kernel.windows(words.h, window, _SECOND))
                ids, own = part.column(0).to_numpy(), part.column(1).to_numpy()
                for k in range(0, len(p), 1 << 16):
                    q = p[k : k + (1 << 16)]
                    doc = words.doc[q]
                    g = pa.nulls(len(q), pa.int64()) if second is None else pa.array(second[q].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[q].view(np.int64)), g, pa.array(ids[doc]), pa.array(own[doc]), pa.array((q - words.at[doc]).astype(np.int32))], ["h", "g", "id", "row", "p"])

    return rows.select("id", "row", "text", "packed").mapInArrow(run, "h long, g long, id long, row long, p int")


def repeats(rows: Rows, window: int = WINDOW, lengths: tuple[int, ...] = LENGTHS) -> tuple[DataFrame | None, DataFrame | None]:
    """Packed lists: the parts of the last length that survive, and the window starts that are least of their kind."""
    lists, before = None, None
    for length in lengths:
        parts = stored(_emit(rows.joined({"packed": lists}, "inner"), window, before, length).select("h", "row", "p"), f"parts-{length}")
        twice = stored(parts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), f"twice-{length}")
        lists, before = _packed(spread_join(parts, twice, ["h"], "n", "left_semi").select("row", "p"), f"repeated-{length}"), length
        if lists.isEmpty():
            return None, None
    found = _emit(rows.joined({"packed": lists}, "inner"), window, before, window)
    if rows.shared:
        found = stored(found, "repeated-windows")
    # the place as one number, in the order of (id, start)
    place = (F.col("id").cast("decimal(20,0)") * F.lit(2**31) + F.col("p")).cast("decimal(38,0)")
    least = found.select("h", "g", place.alias("place")).groupBy("h", "g").agg(F.min("place").alias("place"))
    start = F.pmod("place", F.lit(2**31).cast("decimal(38,0)")).cast("int")
    owner = F.floor((F.col("place") - start) / F.lit(2**31)).cast("long")
    least = least.select("h", "g", owner.alias("id"), start.alias("p"))
    # only the rows of that id that have this very window there
    least = found.join(least, ["h", "g", "id", "p"], "left_semi").select("row", "p") if rows.shared else least.select(F.col("id").alias("row"), "p")
    return lists, _packed(least, "least-places")


def removals(docs: DataFrame, window: int = WINDOW, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """id, n_words, n_removed, kept (the remaining words joined by one space) for every row of docs."""
    rows = Rows(docs)
    packed, least = repeats(rows, window, lengths)
    given = rows.joined({"packed": packed, "least": least}, "left").select("id", "text", "packed", "least")
    last = lengths[-1]

    def cut(texts: list[bytes], packed: list, least: list):
        """Words of each text, and the marks of those that go (None for none)."""
        open_ = [i for i, p in enumerate(packed) if p]
        gone: dict[int, np.ndarray] = {}
        if open_:
            words = _Words([texts[i] for i in open_], window)
            mine = np.zeros(len(words.h) + 1, bool)
            mine[_surviving(words, [packed[i] for i in open_], last)] = True
            mine &= ~words.listed([least[i] for i in open_])
            edge = np.zeros(len(words.h) + window + 1, np.int64)
            starts = np.flatnonzero(mine)
            edge[starts] += 1
            np.subtract.at(edge, starts + window, 1)
            covered = np.cumsum(edge)[: len(words.h)] > 0
            gone = {i: covered[words.at[k] : words.at[k + 1]] for k, i in enumerate(open_)}
        return ((t.split(), gone.get(i)) for i, t in enumerate(texts))

    def run(batches):
        for b in batches:
            for at, end in kernel.slices(b.column(1), GROUP):
                part = b.slice(at, end - at)
                n_words, n_removed, kept = [], [], []
                for w, out in cut(_encoded(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    n_words.append(len(w))
                    if out is not None and out.any():
                        w = [x for x, off in zip(w, out.tolist(), strict=True) if not off]
                    n_removed.append(n_words[-1] - len(w))
                    kept.append(b" ".join(w))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    out = given.mapInArrow(run, "id long, n_words long, n_removed long, kept string")
    return out.withColumn("id", F.when(F.col("id") != _NULL_ID, F.col("id")))


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

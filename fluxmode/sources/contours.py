"""Files of annotation contours: big-endian lists of nodes, with or without a header that says what each node holds.

They are read through Spark's binaryFile source and written by a data source of their own, one file a task.
"""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

# fixed values of the file format
MAGIC, VERSION = b"silbido!", 4
NODE_FLAGS = {"time": 1, "frequency": 2, "snr": 4, "phase": 8, "ridge": 64}
CONTOUR_FLAGS = {"confidence": 32, "score": 16, "species": 512, "call": 1024}
TIMESTAMP, COMMENT = 128, 256
#: The columns of a read contour.
SCHEMA = "path string, contour long, graph long, confidence double, score double, species string, call string, time array<double>, frequency array<double>, snr array<double>, phase array<double>, ridge array<double>, comment string, timestamp string, error string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
_ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in SCHEMA.split(", ")])


class _Bytes:
    """A place in a file's bytes; reading beyond the end is an error."""

    def __init__(self, content: bytes):
        self.content, self.at = content, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.content):
            raise ValueError("the file ends within a contour")
        self.at += n
        return self.content[self.at - n : self.at]

    def number(self, kind: str):
        return struct.unpack(">" + kind, self.take(struct.calcsize(kind)))[0]

    def text(self) -> str:
        return self.take(self.number("H")).decode()


def decoded(content: bytes) -> list[dict]:
    """The contours of one file. What stands before a broken one is kept; the last row then has an error and no nodes."""
    b, out = _Bytes(content), []
    flags, version, about = NODE_FLAGS["time"] | NODE_FLAGS["frequency"], -1, {"comment": None, "timestamp": None}
    try:
        if content.startswith(MAGIC):
            b.take(len(MAGIC))
            version, flags, _ = (b.number("H") for _ in range(3))
            size = b.number("I")
            if flags & COMMENT or (size > b.at and not flags & TIMESTAMP):  # older files have a comment without saying so
                about["comment"] = b.text()
            if flags & TIMESTAMP:
                about["timestamp"] = b.text()
            b.at = max(b.at, size)
        held = [name for name, flag in NODE_FLAGS.items() if flags & flag]
        while b.at < len(content):
            row = {"contour": len(out)} | about
            for name, flag in CONTOUR_FLAGS.items():
                if flags & flag:
                    row[name] = b.number("d") if name in ("confidence", "score") else b.text()
            if version > 2:
                row["graph"] = b.number("q")
            n = b.number("i")
            nodes = np.frombuffer(b.take(8 * n * len(held)), ">f8").astype(float).reshape(n, len(held))
            out.append(row | {name: nodes[:, k] for k, name in enumerate(held)})
    except (ValueError, struct.error) as e:
        out.append({"contour": len(out), "error": str(e)} | about)
    return out


def read(spark: SparkSession, path: str, pattern: str = "*.ton") -> DataFrame:
    """A row a contour with all that its file holds of it; what it lacks is null."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = decoded(content)
                for at in range(0, len(rows), 4096):
                    part = [r | {"path": name} for r in rows[at : at + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in part], t) for c, t in zip(_NAMES, _ARROW.types, strict=True)], schema=_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def encoded_header(columns: list[str], comment: str = "", timestamp: str = "", user_version: int = 0) -> bytes:
    """The header of a file whose contours hold the columns."""
    texts = [t.encode() for t in (comment, timestamp) if t]
    if any(len(t) > 65535 for t in texts):
        raise ValueError("a comment or time stamp has at most 65535 bytes")
    flags = sum(flag for name, flag in (NODE_FLAGS | CONTOUR_FLAGS).items() if name in columns) | (COMMENT if comment else 0) | (TIMESTAMP if timestamp else 0)
    size = len(MAGIC) + 10 + sum(2 + len(t) for t in texts)
    return MAGIC + struct.pack(">HHHI", VERSION, flags, user_version, size) + b"".join(struct.pack(">H", len(t)) + t for t in texts)


def encoded(row: dict, columns: list[str]) -> bytes:
    """One contour. Its node lists have one length; null numbers are 0, null texts empty, a null graph 0."""
    out = []
    for name in CONTOUR_FLAGS:
        if name in columns:
            if name in ("confidence", "score"):
                out.append(struct.pack(">d", row[name] or 0.0))
            else:
                t = (row[name] or "").encode()
                if len(t) > 65535:
                    raise ValueError(f"a {name} has at most 65535 bytes")
                out.append(struct.pack(">H", len(t)) + t)
    lists = [row[name] or [] for name in NODE_FLAGS if name in columns]
    if len({len(v) for v in lists}) > 1:
        raise ValueError("the node lists of a contour have one length")
    out.append(struct.pack(">qi", row.get("graph") or 0, len(lists[0])))
    return b"".join(out) + np.array([[0.0 if x is None else x for x in v] for v in lists], ">f8").T.tobytes()


@dataclass
class _Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class ContourWriter(DataSourceArrowWriter):
    """Each task writes under a name that readers skip; the driver gives the files their names when all tasks are done."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite, self.job = options["path"].removeprefix("file:"), columns, overwrite, uuid.uuid4().hex
        if not {"time", "frequency"} <= set(columns):
            raise ValueError("contours have the columns time and frequency")
        self.header = encoded_header(columns, options.get("comment", ""), options.get("timestamp", ""), int(options.get("userversion", 0)))

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        name, n = f"_{self.job}-{uuid.uuid4().hex}", 0
        at = os.path.join(self.path, name)
        try:
            with open(at, "wb") as f:
                f.write(self.header)
                for batch in iterator:
                    for row in batch.to_pylist():
                        f.write(encoded(row, self.columns))
                        n += 1
        except BaseException:
            if os.path.exists(at):
                os.remove(at)
            raise
        if n == 0:
            os.remove(at)
        return _Written([name] if n else [])

    def _mine(self) -> list[str]:
        return [n for n in (os.listdir(self.path) if os.path.isdir(self.path) else []) if n.startswith(f"_{self.job}-")]

    def commit(self, messages):
        os.makedirs(self.path, exist_ok=True)
        before = [n for n in os.listdir(self.path) if n.endswith(".ton")] if self.overwrite else []
        done = [n for m in messages if m is not None for n in m.names]
        for k, name in enumerate(done):
            os.rename(os.path.join(self.path, name), os.path.join(self.path, f"part-{k:05d}-{self.job}.ton"))
        for name in [*before, *self._mine()]:  # what was there, and what attempts that did not count left
            os.remove(os.path.join(self.path, name))

    def abort(self, messages):
        for name in self._mine():
            os.remove(os.path.join(self.path, name))


class ContourSource(DataSource):
    """df.write.format("contours").mode("append" or "overwrite").save(path), after spark.dataSource.register(ContourSource).

    df has time and frequency, and may have snr, phase, ridge (lists), confidence, score, species, call and graph. Options: comment,
    timestamp, userVersion. The path is a folder that driver and executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "contours"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite):
        return ContourWriter(dict(self.options), [f.name for f in schema.fields], overwrite)


def write(df: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    df.sparkSession.dataSource.register(ContourSource)
    df.write.format("contours").options(**options).mode(mode).save(path)

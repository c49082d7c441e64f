"""Time series in text tables, each file with columns of its own, and bundles of named arrays in npz files.

Text tables are read line by line through Spark's text source, so one long file is read by many tasks and
files of one folder may name different channels. Bundles are one file each: a task writes them array by array.
"""

from __future__ import annotations

import io
import os
import re
import shutil
import uuid
import zipfile
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BUNDLE = "input string, key string, dtype string, shape array<int>, data array<double>, text string"


def _plain(path: Column) -> Column:
    """A path without its percent signs; a plus is a plus."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read(spark: SparkSession, path: str, sep: str | None = ",", pattern: str = "*", folder: str | None = None) -> DataFrame:
    """Text tables in long form: input (path of the file), time, place (of the channel, from 1), channel, x.

    The first field of a line is the time. sep None: fields are parted by white space. Lines that begin with # and
    empty lines say nothing. A line whose first field is no number is the file's header (of several, the one of most
    fields, then the greatest as text); without it, and where it is too short or blank, channels are channel_1,
    channel_2 and so on. Blank fields and fields that are no numbers give a null x, fields that a line lacks no row.
    Between double quotes a separator is text. folder: the name in folders name=value whose value is the input instead.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("input"), F.regexp_replace("value", "^﻿", "").alias("line"))
    lines = lines.where(~F.col("line").rlike(r"^\s*(#|$)"))
    if sep is None:
        fields = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+")
    else:
        at = re.escape(sep)
        quoted = F.transform(F.split("line", at + '(?=(?:[^"]*+"[^"]*+")*+[^"]*+$)', -1), lambda s: F.regexp_replace(F.regexp_replace(s, r'^\s*"|"\s*$', ""), '""', '"'))
        fields = F.transform(F.when(F.contains("line", F.lit('"')), quoted).otherwise(F.split("line", at, -1)), lambda s: F.trim(s))
    lines = lines.select("input", fields.alias("fields")).withColumn("time", F.col("fields")[0].try_cast("double"))
    heads = lines.where("time IS NULL").groupBy("input").agg(F.max(F.struct(F.size("fields").alias("n"), "fields"))["fields"].alias("names"))
    # a row a file: sent to the tasks if its measured bytes are few; the adaptive plan splits a file of many lines otherwise
    each = lines.where("time IS NOT NULL").join(heads, "input", "left").select("input", "time", "names", F.posexplode(F.slice("fields", 2, F.greatest(F.size("fields") - 1, F.lit(0)))).alias("at", "value"))
    place = F.col("at") + 1
    name = F.coalesce(F.nullif(F.get("names", place), F.lit("")), F.concat(F.lit("channel_"), place))
    source = _plain(F.col("input"))
    if folder is not None:
        source = _plain(F.regexp_extract(source, f"/{re.escape(folder)}=([^/]*)", 1))
    return each.select(source.alias("input"), "time", place.alias("place"), name.alias("channel"), F.col("value").try_cast("double").alias("x"))


def write(series: DataFrame, path: str, sep: str = ",", channels: list[str] | None = None, mode: str = "error") -> None:
    """Long rows (input, time, channel, x) as wide text tables with a header, in a folder input=... for each input.

    A long input becomes several files of neighbouring times. What is missing is blank, nan between spaces. Of several
    values at one time of one channel the least stays. channels fixes the columns; else they are all channels there are.
    """
    wide = series.groupBy("input", "time").pivot("channel", channels).agg(F.min("x"))
    dealt = wide.repartitionByRange("input", "time").sortWithinPartitions("input", "time")
    dealt.write.mode(mode).partitionBy("input").csv(path, sep=sep, header=True, escape='"', nullValue="nan" if sep == " " else "")


def sampling(series: DataFrame) -> DataFrame:
    """Of each input: samples, channels, first and last time, and samples a unit of time (1 for a single sample, null if time stands still)."""
    n, first, last = F.count(F.when(F.col("place") == 1, 1)), F.min("time"), F.max("time")
    found = series.groupBy("input").agg(n.alias("samples"), F.max("place").alias("channels"), first.alias("first"), last.alias("last"))
    rate = F.when(F.col("samples") <= 1, 1.0).when(F.col("last") > F.col("first"), (F.col("samples") - 1) / (F.col("last") - F.col("first")))
    return found.withColumn("rate", rate)


@dataclass
class _Bundles(WriterCommitMessage):
    folder: str = ""
    names: list[str] = field(default_factory=list)


class BundleWriter(DataSourceArrowWriter):
    """Each task writes into a folder that readers skip; the driver moves what counts when all tasks are done."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.removeprefix("file:"), overwrite, uuid.uuid4().hex

    def write(self, iterator):
        folder = f"_{self.job}-{uuid.uuid4().hex}"
        out, now, names = None, None, []
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in ("input", "key", "dtype", "shape", "data", "text")}
                    name = quote(row["input"].as_py() or "", safe="") + ".npz"
                    if name != now:
                        if out is not None:
                            out.close()
                        os.makedirs(os.path.join(self.path, folder), exist_ok=True)
                        out, now = zipfile.ZipFile(os.path.join(self.path, folder, name), "x", zipfile.ZIP_DEFLATED), name
                        names.append(name)
                    if not row["text"].is_valid and not row["data"].is_valid:
                        continue  # what is not there has no key
                    with out.open(f"{row['key'].as_py()}.npy", "w", force_zip64=True) as f:
                        np.lib.format.write_array(f, self._array(row), allow_pickle=False)
        finally:
            if out is not None:
                out.close()
        return _Bundles(folder, names)

    @staticmethod
    def _array(row: dict) -> np.ndarray:
        if row["text"].is_valid:
            return np.array(row["text"].as_py())
        data = row["data"].values.to_numpy(zero_copy_only=False).astype(row["dtype"].as_py() or "f8")
        return data.reshape(row["shape"].as_py() if row["shape"].is_valid else -1)

    def commit(self, messages):
        os.makedirs(self.path, exist_ok=True)
        done = [m for m in messages if m is not None]
        kept = {n for m in done for n in m.names}
        for n in os.listdir(self.path) if self.overwrite else []:
            if n.endswith(".npz") and n not in kept:
                os.remove(os.path.join(self.path, n))
        for m in done:
            for n in m.names:
                os.replace(os.path.join(self.path, m.folder, n), os.path.join(self.path, n))
        self._swept()

    def abort(self, messages):
        self._swept()

    def _swept(self) -> None:
        for n in os.listdir(self.path) if os.path.isdir(self.path) else []:
            if n.startswith(f"_{self.job}-"):
                shutil.rmtree(os.path.join(self.path, n))


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundles"

    def schema(self) -> str:
        return BUNDLE

    def writer(self, schema, overwrite):
        return BundleWriter(dict(self.options)["path"], overwrite)


def write_bundles(arrays: DataFrame, path: str, mode: str = "append") -> None:
    """One npz file for each input, on a folder that driver and executors share: key, and dtype, shape, data or a text.

    Rows with neither data nor text leave their key out; null dtypes are doubles, null shapes flat. A key given twice
    for an input fails. An input that is there already is replaced.
    """
    held = [F.col(c) if c in arrays.columns else F.lit(None) for c in ("input", "key", "dtype", "shape", "data", "text")]
    types = [f.split(" ", 1) for f in BUNDLE.split(", ")]
    rows = arrays.select(*(c.cast(t).alias(n) for c, (n, t) in zip(held, types, strict=True)))
    rows = rows.withColumn("key", F.when(F.count("*").over(_same()) > 1, F.raise_error(F.concat(F.lit("given twice: "), "key"))).otherwise(F.col("key")))
    arrays.sparkSession.dataSource.register(BundleSource)
    rows.repartition("input").sortWithinPartitions("input", "key").write.format("bundles").mode(mode).save(path)


def _same():
    from pyspark.sql import Window

    return Window.partitionBy("input", "key")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """The arrays of npz files as written: input, key, dtype, shape, data, text; a file that is none gives no rows."""

    def run(batches):
        for b in batches:
            for at, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = unquote(at.rsplit("/", 1)[1].removesuffix(".npz"))
                try:
                    held = np.load(io.BytesIO(content), allow_pickle=False)
                    keys = held.files
                except (ValueError, OSError, EOFError, zipfile.BadZipFile, AttributeError):
                    continue
                for key in keys:
                    a = held[key]
                    is_text = a.dtype.kind in "US"
                    data = None if is_text else a.astype(float).ravel()
                    row = [[name], [key], [a.dtype.str.lstrip("<>|=")], [list(a.shape)], [data], [str(a[()]) if is_text else None]]
                    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["input", "key", "dtype", "shape", "data", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInArrow(run, BUNDLE)

"""File readers: arrays, text tables, raw samples and sound, each file a row or rows of long signals.

Binary files come through Spark's binaryFile source, so they may lie in any store Spark reads; they are
decoded in Arrow batches. Files that cannot be decoded give a row with an error and no data.
"""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contours as contour_files

ARRAY = "path string, shape array<int>, data array<double>, error string"
#: Formats by extension and by the hexadecimal bytes a file begins with.
FORMATS = (("npy", "934e554d5059"), ("npz", "504b0304"), ("hdf5", "894844460d0a1a0a"), ("netcdf", "434446"), ("matlab", "4d41544c4142"), ("gzip", "1f8b"), ("wav", "52494646"))


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _decoded(files: DataFrame, decode) -> DataFrame:
    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    a, error = np.asarray(decode(content), float), None
                except (ValueError, OSError, EOFError, struct.error, wave.Error) as e:
                    a, error = np.zeros(0), f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([list(a.shape)], pa.list_(pa.int32())), pa.array([a.ravel()], pa.list_(pa.float64())), pa.array([error], pa.string())], ["path", "shape", "data", "error"]
                )

    return files.mapInArrow(run, ARRAY)


def npy(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(_files(spark, path, "*.npy"), lambda content: np.load(io.BytesIO(content), allow_pickle=False))


def raw(spark: SparkSession, path: str, dtype: str = "<f8", columns: int = 1, pattern: str = "*.bin") -> DataFrame:
    return _decoded(_files(spark, path, pattern), lambda content: np.frombuffer(content, dtype).reshape(-1, columns))


def sound(spark: SparkSession, path: str) -> DataFrame:
    """PCM samples of wave files in [-1, 1], samples x channels."""

    def decode(content: bytes) -> np.ndarray:
        with wave.open(io.BytesIO(content)) as w:
            width = w.getsampwidth()
            a = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).reshape(-1, w.getnchannels())
            return (a.astype(float) - 128) / 128 if width == 1 else a / float(1 << (8 * width - 1))

    return _decoded(_files(spark, path, "*.wav"), decode)


def signals(arrays: DataFrame) -> DataFrame:
    """Long form of one-dimensional arrays: input, i, x; others are left out."""
    good = arrays.where(F.col("error").isNull() & (F.size("shape") == 1) & (F.size("data") > 0))
    return good.select(F.col("path").alias("input"), F.posexplode("data").alias("i", "x"))


def images(arrays: DataFrame) -> DataFrame:
    """Long form of two-dimensional arrays: input, f, t, v."""
    good = arrays.where(F.col("error").isNull() & (F.size("shape") == 2))
    each = good.select(F.col("path").alias("input"), F.col("shape")[1].alias("w"), F.posexplode("data").alias("p", "v"))
    return each.select("input", F.floor(F.col("p") / F.col("w")).alias("f"), (F.col("p") % F.col("w")).alias("t"), "v")


def series(spark: SparkSession, path: str, sep: str = ",", header: bool = True, time: str | None = None) -> DataFrame:
    """A text table of time and channels as long form: channel, t, x. The first column is the time unless named."""
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=False)
    time = time or df.columns[0]
    channels = [c for c in df.columns if c != time]
    wide = df.select(F.col(f"`{time}`").cast("double").alias("t"), *(F.col(f"`{c}`").cast("double").alias(c) for c in channels))
    return wide.unpivot("t", channels, "channel", "x")


def detected(spark: SparkSession, path: str) -> DataFrame:
    """path, format: by extension, then by the first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head, found = F.lower(F.hex(F.substring("content", 1, 8))), F.lit("unknown")
    for name, magic in reversed(FORMATS):
        found = F.when(F.startswith(head, F.lit(magic)), name).otherwise(found)
    for name, _ in reversed(FORMATS):
        found = F.when(F.endswith(F.col("path"), F.lit("." + name)), name).otherwise(found)
    return files.select("path", found.alias("format"))


def contours(spark: SparkSession, path: str, pattern: str = "*.ton") -> DataFrame:
    """Annotation contours: path, contour, time, frequency (lists of nodes)."""
    return contour_files.read(spark, path, pattern).where("error IS NULL").select("path", "contour", "time", "frequency")

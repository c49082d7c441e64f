"""One catalogue of detections, queried by time, band, mode number and detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import events

COLUMNS = ("shot", "diagnostic", "detector", "start", "stop", "f_low", "f_high", "n", "amplitude")


def record(df: DataFrame, **given: Column) -> DataFrame:
    """A producer's rows in the catalogue's columns; what it does not know is null."""
    types = {"shot": "long", "diagnostic": "string", "detector": "string", "start": "long", "stop": "long", "f_low": "double", "f_high": "double", "n": "long", "amplitude": "double"}
    return df.select(*(given.get(c, F.lit(None)).cast(types[c]).alias(c) for c in COLUMNS))


def union(*producers: DataFrame) -> DataFrame:
    out = producers[0]
    for p in producers[1:]:
        out = out.unionByName(p)
    return out


def find(catalogue: DataFrame, n: int | None = None, band: tuple[float, float] | None = None, without: str | None = None, bucket: int = 64) -> DataFrame:
    """Records of mode number n whose band meets the given one, and that no record of detector `without` overlaps in time."""
    rows = catalogue
    if n is not None:
        rows = rows.where(F.col("n") == n)
    if band is not None:
        rows = rows.where((F.col("f_low") <= band[1]) & (F.col("f_high") >= band[0]))
    if without is not None:
        rows = events.overlapping(rows.where(F.col("detector") != without), catalogue.where(F.col("detector") == without), bucket, "shot", how="left_anti")
    return rows


def confirmed(catalogue: DataFrame, bucket: int = 64, least: int = 2) -> DataFrame:
    """Time buckets of a shot in which at least `least` diagnostics saw something."""
    each = catalogue.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))))
    return each.groupBy("shot", "bucket").agg(F.count_distinct("diagnostic").alias("diagnostics"), F.count("*").alias("records")).where(F.col("diagnostics") >= least)

"""Queries through files: series written as text tables and read again, and images bundled with their axes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import series
from ..sources import standins as S
from .signal_queries import query, r
from .staging import noted, shared_dir


def _path(spark, label: str) -> str:
    return noted(spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")


def _weeks(spark, d):
    """Hourly sums of each event type as series of a week; time in days."""
    week = F.concat(F.lit("week "), F.floor(F.col("i") / 168))
    return S.hourly(spark, d).select(week.alias("input"), (F.col("i") / 24).alias("time"), "channel", "x")


@query("SELECT 'week ' || (i // 168) AS input, round(i / 24, 6) AS time, channel, round(x, 4) AS x FROM hourly", "hourly")
def series_csv(spark, d):
    """Series written as comma-separated tables, a folder a week, and read again; blanks are no samples."""
    path = _path(spark, "series-csv")
    series.write(_weeks(spark, d), path)
    return series.read(spark, path, folder="input").where("x IS NOT NULL").select("input", r("time").alias("time"), "channel", r("x", 4).alias("x"))


@query("""SELECT 'week ' || (i // 168) AS input, count(DISTINCT i) AS samples, (SELECT CAST(count(DISTINCT channel) AS INTEGER) FROM hourly) AS channels, round(min(i) / 24, 6) AS first, round(max(i) / 24, 6) AS last,
round(CASE WHEN count(DISTINCT i) <= 1 THEN 1.0 WHEN max(i) > min(i) THEN (count(DISTINCT i) - 1) / ((max(i) - min(i)) / 24) END, 6) AS rate FROM hourly GROUP BY 1""", "hourly")
def series_sampling(spark, d):
    """The axis of each series, from tables parted by spaces."""
    path = _path(spark, "series-text")
    series.write(_weeks(spark, d), path, sep=" ")
    found = series.sampling(series.read(spark, path, sep=None, folder="input"))
    return found.select("input", "samples", "channels", r("first").alias("first"), r("last").alias("last"), r("rate").alias("rate"))


@query(""", b AS (SELECT CAST(t // 90 AS VARCHAR) AS input, f, t, round(v, 4) AS v FROM grid)
SELECT input, 'image' AS key, 'f4' AS dtype, 1440 AS size, NULL AS text, round(sum(CAST(v AS FLOAT)::DOUBLE * (f * 90 + t % 90 + 1)), 0) AS checked FROM b GROUP BY 1
UNION ALL SELECT input, 'columns', 'i8', 90, NULL, CAST(sum(t * (t % 90 + 1)) AS DOUBLE) FROM b WHERE f = 0 GROUP BY 1
UNION ALL SELECT DISTINCT input, 'params', 'U12', 1, '{"rows": 16}', NULL FROM b""", "grid")
def bundle_arrays(spark, d):
    """Images of 90 hours bundled with their columns and parameters, one file each, and read again: each array's sum weighted by place."""
    g = S.grid(spark, d).select(F.floor(F.col("t") / 90).cast("string").alias("input"), "f", "t", F.round("v", 4).alias("v"))
    cells = lambda df, *by: df.groupBy("input").agg(F.array_sort(F.collect_list(F.struct(*by))).alias("c"))  # noqa: E731  an image of fixed size
    image = cells(g, "f", "t", "v").select("input", F.lit("image").alias("key"), F.lit("f4").alias("dtype"), F.array(F.lit(16), F.lit(90)).alias("shape"), F.col("c.v").alias("data"), F.lit(None).cast("string").alias("text"))
    columns = cells(g.where("f = 0"), "t").select("input", F.lit("columns").alias("key"), F.lit("i8").alias("dtype"), F.array(F.lit(90)).alias("shape"), F.col("c.t").cast("array<double>").alias("data"), F.lit(None).cast("string").alias("text"))
    params = image.select("input", F.lit("params").alias("key"), F.lit(None).cast("string").alias("dtype"), F.lit(None).cast("array<int>").alias("shape"), F.lit(None).cast("array<double>").alias("data"), F.lit('{"rows": 16}').alias("text"))
    path = _path(spark, "bundles")
    series.write_bundles(image.unionByName(columns).unionByName(params), path)
    size = F.aggregate("shape", F.lit(1), lambda n, s: n * s)
    checked = F.aggregate(F.transform("data", lambda v, i: v * (i + 1)), F.lit(0.0), lambda n, v: n + v)
    return series.read_bundles(spark, path).select("input", "key", "dtype", size.alias("size"), "text", r(checked, 0).alias("checked"))

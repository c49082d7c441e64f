"""Thresholds and sizes chosen from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, bins: int, *keys: str) -> DataFrame:
    """Cumulative share of values on an even grid of bins from least to greatest: keys, b, cdf, low, high; a few rows a key."""
    ends = df.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    at = F.least(F.floor((F.col("x") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * bins), F.lit(bins - 1))
    h = df.join(ends, list(keys)).groupBy(*keys, "low", "high", at.alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    return h.withColumn("cdf", F.sum("n").over(w.orderBy("b")) / F.sum("n").over(w)).drop("n")


def triangle_threshold(df: DataFrame, *keys: str, bins: int = 256, adjust: float = 0.0) -> DataFrame:
    """The bin of greatest distance between the cumulative curve and its chord (the first of equals)."""
    h = histogram(df, bins, *keys)
    w = Window.partitionBy(*keys)
    first, last = F.min(F.struct("b", "cdf")).over(w), F.max(F.struct("b", "cdf")).over(w)
    chord = first["cdf"] + (last["cdf"] - first["cdf"]) * (F.col("b") - first["b"]) / F.greatest(last["b"] - first["b"], F.lit(1))
    best = F.max(F.struct(F.round(F.col("cdf") - F.col("_c"), 9), (-F.col("b")).alias("m"))).alias("b")
    g = h.withColumn("_c", chord).groupBy(*keys, "low", "high").agg(best)
    return g.select(*keys, (F.col("low") + (F.col("high") - F.col("low")) * ((-F.col("b.m") + 0.5) / bins + adjust)).alias("threshold"))


def knee_threshold(df: DataFrame, *keys: str, grid: int = 512, sensitivity: float = 1.0, fallback: float = 0.02, least: int = 100) -> DataFrame:
    """Knee of the cumulative curve of positive values up to their 99.9 % quantile.

    The knee is the first local maximum of the difference curve that falls by sensitivity / grid
    before a higher one; without one the upper `fallback` quantile is taken, and under `least` values
    infinity. Keys, threshold, used_fallback.
    """
    pos = df.where("x > 0")
    top = pos.groupBy(*keys).agg(F.percentile("x", 0.999).alias("_top"), F.percentile("x", 1 - fallback).alias("_back"), F.count("*").alias("_n"))
    below = pos.join(top, list(keys)).where(F.col("x") <= F.col("_top"))
    h = below.groupBy(*keys, F.least(F.floor(F.col("x") / F.col("_top") * (grid - 1)), F.lit(grid - 1)).alias("b")).agg(F.count("*").alias("m"))
    dense = top.select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("b")).withColumn("b", F.col("b").cast("long"))
    w = Window.partitionBy(*keys).orderBy("b")
    upto = F.sum(F.coalesce("m", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = dense.join(h, [*keys, "b"], "left").withColumn("d", upto / F.col("_n") - F.col("b") / (grid - 1))
    peak = (F.col("d") > F.coalesce(F.lag("d").over(w), F.lit(-1.0))) & (F.col("d") >= F.coalesce(F.lead("d").over(w), F.lit(-1.0)))
    later = F.min("d").over(w.rowsBetween(1, Window.unboundedFollowing))
    knees = d.withColumn("_p", peak).withColumn("_l", later).where(F.col("_p") & (F.col("_l") < F.col("d") - sensitivity / (grid - 1))).groupBy(*keys).agg(F.min("b").alias("_k"))
    found = df.select(*keys).distinct().join(top, list(keys), "left").join(knees, list(keys), "left")
    value = F.when(F.coalesce("_n", F.lit(0)) < least, F.lit(float("inf"))).when(F.col("_k").isNull(), F.col("_back")).otherwise(F.col("_k") / (grid - 1) * F.col("_top"))
    return found.select(*keys, value.alias("threshold"), F.col("_k").isNull().alias("used_fallback"))


def edge_bins(profile: DataFrame, *keys: str, k: float = 2.0, cap: float = 0.15) -> DataFrame:
    """Bins of the contiguous runs at both ends whose energy is over k times off the median, 1 at least and cap at most. profile: keys, f, e."""
    mid = profile.groupBy(*keys).agg(F.median("e").alias("_m"), F.count("*").alias("_n"))
    off = profile.join(mid, list(keys)).withColumn("_ok", F.abs(F.log("e") - F.log("_m")) <= F.log(F.lit(k)))
    good = off.groupBy(*keys, "_n").agg(F.min(F.when(F.col("_ok"), F.col("f"))).alias("_lo"), F.max(F.when(F.col("_ok"), F.col("f"))).alias("_hi"))
    most = F.floor(F.col("_n") * cap)
    clip = lambda c: F.greatest(F.lit(1), F.least(c, most)).cast("long")
    return good.select(*keys, clip(F.coalesce("_lo", "_n")).alias("lower"), clip(F.coalesce(F.col("_n") - 1 - F.col("_hi"), F.col("_n"))).alias("upper"))


def energy_profile(df: DataFrame, *keys: str) -> DataFrame:
    """Median over samples of the root mean square of each bin. df: keys, sample, f, v."""
    rms = df.groupBy(*keys, "sample", "f").agg(F.sqrt(F.avg(F.col("v") ** 2)).alias("e"))
    return rms.groupBy(*keys, "f").agg(F.median("e").alias("e"))


def cdf_threshold(df: DataFrame, *keys: str, bins: int = 100, adjust: float = 0.0) -> DataFrame:
    """The place where the cumulative curve of values, raised to their median, is farthest from its chord: keys, threshold.

    The curve is interpolated exactly at `bins` even places: what it takes are the count up to each place and the values
    beside it, which cells of values give by partial aggregates, so that no key is sorted.
    """
    mid = df.groupBy(*keys).agg(F.median("x").alias("_m"))
    x = df.join(mid, list(keys)).select(*keys, F.greatest("x", "_m").alias("x"))
    ends = x.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).where("high > low")
    u = (F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins
    # values of cell c lie up to place c and above place c - 1
    cells = x.join(ends, list(keys)).withColumn("u", u).withColumn("c", F.least(F.ceil(F.col("u") * (bins - 1) / bins), F.lit(bins - 1)))
    cells = cells.groupBy(*keys, "c").agg(F.count("*").alias("m"), F.min("u").alias("first"), F.max("u").alias("last"))
    dense = ends.select(*keys, "low", "high", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("c")).join(cells, [*keys, "c"], "left")
    w = Window.partitionBy(*keys).orderBy("c")
    upto, onward = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("c") * bins / (bins - 1)
    near = dense.select(*keys, "low", "high", "n", "c", at.alias("at"), F.sum("m").over(upto).alias("r"), F.max("last").over(upto).alias("a"), F.min("first").over(onward).alias("z"))
    share = F.coalesce(F.try_divide(F.col("at") - F.col("a"), F.col("z") - F.col("a")), F.lit(0.0))
    y = near.withColumn("y", (F.col("r") - 1 + share) / (F.col("n") - 1) * 2 * bins)
    first, last = (F.first("y").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("y").over(Window.partitionBy(*keys).orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)))
    off = F.round(F.abs(F.col("y") - first - (last - first) / bins * F.col("at")), 9)
    best = y.withColumn("d", off).groupBy(*keys, "low", "high").agg(F.max(F.struct("d", (-F.col("c")).alias("k"), "at")).alias("b"))
    return best.select(*keys, (F.col("b.at") / bins * (F.col("high") - F.col("low")) + F.col("low") + adjust * (F.col("high") - F.col("low"))).alias("threshold"))

"""Descriptive statistics, outliers and correlations of long signals (key columns, i, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered(*keys: str, by: str = "i") -> Window:
    return Window.partitionBy(*keys).orderBy(by)


def demean(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumn("centred", F.col("x") - F.avg("x").over(Window.partitionBy(*keys)))


def zscore(df: DataFrame, *keys: str, epsilon: float = 1e-6) -> DataFrame:
    """(x - mean) / (population deviation + epsilon), by joining the small table of statistics."""
    stats = df.groupBy(*keys).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    return df.join(stats, list(keys)).withColumn("z", (F.col("x") - F.col("_m")) / (F.col("_s") + epsilon)).drop("_m", "_s")


def percentile_clip(df: DataFrame, *keys: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """x within its interpolated percentiles."""
    limits = df.groupBy(*keys).agg(F.percentile("x", F.array(F.lit(low), F.lit(high))).alias("_q"))
    clip = F.least(F.greatest("x", F.col("_q")[0]), F.col("_q")[1])
    return df.join(limits, list(keys)).withColumn("clipped", clip).drop("_q")


def robust_stats(df: DataFrame, *keys: str) -> DataFrame:
    """median and scale = 1.4826 * median |x - median| + 1e-6."""
    mid = df.groupBy(*keys).agg(F.median("x").alias("median"))
    spread = df.join(mid, list(keys)).groupBy(*keys, "median").agg(F.median(F.abs(F.col("x") - F.col("median"))).alias("_mad"))
    return spread.select(*keys, "median", (1.4826 * F.col("_mad") + 1e-6).alias("scale"))


def outliers_iqr(df: DataFrame, *keys: str, k: float = 3.0) -> DataFrame:
    q = df.groupBy(*keys).agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    return df.join(q, list(keys)).withColumn("outlier", (F.col("x") < low - k * (high - low)) | (F.col("x") > high + k * (high - low))).drop("_q")


def outliers_zscore(df: DataFrame, *keys: str, k: float = 3.0) -> DataFrame:
    s = df.groupBy(*keys).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    return df.join(s, list(keys)).withColumn("outlier", F.abs(F.col("x") - F.col("_m")) > k * F.col("_s")).drop("_m", "_s")


def outliers_mad(df: DataFrame, *keys: str, k: float = 3.0) -> DataFrame:
    mid = df.groupBy(*keys).agg(F.median("x").alias("_m"))
    dev = df.join(mid, list(keys))
    mad = dev.groupBy(*keys).agg(F.median(F.abs(F.col("x") - F.col("_m"))).alias("_d"))
    return dev.join(mad, list(keys)).withColumn("outlier", F.abs(0.6745 * (F.col("x") - F.col("_m")) / (F.col("_d") + 1e-12)) > k).drop("_m", "_d")


def snr(df: DataFrame, *keys: str) -> DataFrame:
    """Variance over half the variance of first differences; 1 for ten samples or fewer."""
    step = df.withColumn("_d", F.col("x") - F.lag("x").over(ordered(*keys)))
    ratio = F.var_pop("x") / (F.var_pop("_d") / 2 + 1e-12)
    return step.groupBy(*keys).agg(F.when(F.count("*") <= 10, 1.0).otherwise(ratio).alias("snr"))


def time_gaps(df: DataFrame, *keys: str, factor: float = 2.0) -> DataFrame:
    """Samples after which time jumps by more than factor times the median step."""
    step = df.withColumn("dt", F.lead("t").over(ordered(*keys)) - F.col("t"))
    usual = step.groupBy(*keys).agg(F.median("dt").alias("_m"))
    return step.join(usual, list(keys)).where(F.col("dt") > factor * F.col("_m")).select(*keys, "i", "t", "dt")


def channel_statistics(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"),
        F.median("x").alias("median"), F.count_if(F.isnan("x")).alias("n_nan"), (F.max("t") - F.min("t")).alias("span"),
    )


def order_quantiles(df: DataFrame, *keys: str, quantiles=(0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)) -> DataFrame:
    """Order statistics at the half-even rounded place q (n - 1), without interpolation."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("x")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    each = ranked.withColumn("q", F.explode(F.array(*map(F.lit, quantiles))))
    return each.where(F.col("_r") == F.bround(F.col("q") * (F.col("_n") - 1), 0)).select(*keys, "q", "x")


def weighted_rms(df: DataFrame, *keys: str, weight: str = "w") -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(F.col(weight) * F.col("x") * F.col("x")), F.sum(weight))).alias("rms"))


def correlations(df: DataFrame, channel: str = "channel", by: str = "i", value: str = "x") -> DataFrame:
    """Pearson correlation of every two channels over their common samples; 0 where a channel is constant.

    Channels meet only at equal samples: an equi-join, whose sums are folded before the shuffle.
    """
    a = df.select(F.col(by).alias("_i"), F.col(channel).alias("a"), F.col(value).alias("x"))
    b = df.select(F.col(by).alias("_i"), F.col(channel).alias("b"), F.col(value).alias("y"))
    r = F.corr("x", "y")
    return a.join(b, "_i").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.when(F.isnan(r) | r.isNull(), 0.0).otherwise(r).alias("r"))


def array_profile(df: DataFrame, *keys: str) -> DataFrame:
    """What there is to know of an array: size, range, moments, quartiles, zeros."""
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"), F.count_if(F.col("x") == 0).alias("zeros"),
    )


def validation(df: DataFrame, *keys: str, rate: float | None = None) -> DataFrame:
    """Issues of a series: repeated or falling times, missing values, and a sample rate off by over 5 %."""
    step = df.withColumn("_d", F.col("t") - F.lag("t").over(ordered(*keys)))
    seen = F.lit(rate) if rate is not None else F.lit(None).cast("double")
    return step.groupBy(*keys).agg(
        F.count_if(F.col("_d") == 0).alias("repeated"), F.count_if(F.col("_d") < 0).alias("falling"), F.count_if(F.col("x").isNull() | F.isnan("x")).alias("missing"),
        F.coalesce(F.abs(F.try_divide(F.lit(1.0), F.avg("_d")) - seen) / seen > 0.05, F.lit(False)).alias("rate_off"),
    )


def lower_median(df: DataFrame, *keys: str) -> DataFrame:
    """The lower of two middle elements."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("x"))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return ranked.where(F.col("_r") == F.floor((F.col("_n") + 1) / 2)).select(*keys, F.col("x").alias("median"))


def block_correlations(parts: DataFrame, channel: str = "channel", by: str = "i") -> DataFrame:
    """Mean |correlation| of each channel with the others in each block: channel, block, r. parts: channel, block, i, x."""
    a = parts.select("block", F.col(by).alias("_i"), F.col(channel).alias("a"), "x")
    b = parts.select("block", F.col(by).alias("_i"), F.col(channel).alias("b"), F.col("x").alias("y"))
    c = F.corr("x", "y")
    pairs = a.join(b, ["block", "_i"]).where("a <> b").groupBy("a", "b", "block").agg(F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(c).alias("r"))
    return pairs.groupBy(F.col("a").alias(channel), "block").agg(F.avg(F.abs("r")).alias("r"))

"""Evaluation of scores and masks: counts are partial aggregates, ratios come after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(p: Column, y: Column) -> list[Column]:
    """tp, fp, fn, tn of a boolean prediction and a boolean truth."""
    return [F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")]


def ratios(df: DataFrame) -> DataFrame:
    """precision, recall, f1, iou, accuracy; 0 where nothing is counted."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return df.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp + fn).alias("iou"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def confusion(df: DataFrame, p: Column, y: Column, *keys: str) -> DataFrame:
    return ratios(df.groupBy(*keys).agg(*counts(p, y)))


def threshold_sweep(df: DataFrame, score: str, truth: Column, thresholds: list[float]) -> DataFrame:
    """Ratios at each threshold from one histogram of scores: rows are read and counted once."""
    at = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    hist = df.groupBy(at.alias("_k"), truth.alias("_y")).count()
    each = hist.withColumn("_t", F.explode(F.sequence(F.lit(1), F.lit(len(thresholds)))))
    above = F.col("_k") >= F.col("_t")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    y = F.col("_y")
    got = each.groupBy("_t").agg(n(above & y).alias("tp"), n(above & ~y).alias("fp"), n(~above & y).alias("fn"), n(~above & ~y).alias("tn"))
    return ratios(got.select(F.element_at(F.array(*map(F.lit, thresholds)), F.col("_t")).alias("threshold"), "tp", "fp", "fn", "tn"))


def folds(df: DataFrame, key: str, n: int) -> DataFrame:
    """A fold for each row by the CRC of its key: the same on every engine and at every size."""
    return df.withColumn("fold", F.crc32(F.col(key).cast("string").cast("binary")) % n)


def ensemble(predictions: DataFrame, *keys: str) -> DataFrame:
    """Mean over folds and the entropy of the mean."""
    p = predictions.groupBy(*keys).agg(F.avg("p").alias("p"), F.count("*").alias("n"))
    q = F.least(F.greatest("p", F.lit(1e-12)), F.lit(1 - 1e-12))
    return p.withColumn("entropy", -(q * F.log(q) + (1 - q) * F.log(1 - q)))


def coverage(predictions: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """How many samples there are, and how many are predicted not at all or more than once."""
    n = predictions.groupBy(key).agg(F.count("*").alias("_n"))
    all_ = samples.select(key).distinct().join(n, key, "left")
    return all_.agg(F.count("*").alias("n"), F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_n") > 1).alias("repeated"))


def overlap_losses(df: DataFrame, p: Column, y: Column, *keys: str, smooth: float = 1.0) -> DataFrame:
    """Dice and IoU losses of soft predictions: keys, dice_loss, iou_loss."""
    both, total = F.sum(p * y), F.sum(p) + F.sum(y)
    return df.groupBy(*keys).agg((1 - (2 * both + smooth) / (total + smooth)).alias("dice_loss"), (1 - (both + smooth) / (total - both + smooth)).alias("iou_loss"))

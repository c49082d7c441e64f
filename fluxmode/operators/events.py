"""Runs, gap filling and events: gaps and islands with windows over one key's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(active: DataFrame, max_gap: int, *keys: str, by: str = "t") -> DataFrame:
    """Runs of active rows with gaps of at most max_gap closed: keys, start, stop (inclusive), n (active rows)."""
    order = Window.partitionBy(*keys).orderBy(by)
    new = F.coalesce((F.col(by) - F.lag(by).over(order) - 1 > max_gap).cast("int"), F.lit(1))
    marked = active.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run").agg(F.min(by).alias("start"), F.max(by).alias("stop"), F.count("*").alias("n"))


def column_activity(mask: DataFrame, threshold: float = 0.5, *keys: str) -> DataFrame:
    """Share of a column's bins at or above the threshold. mask: keys, f, t, s."""
    return mask.groupBy(*keys, "t").agg(F.avg((F.col("s") >= threshold).cast("double")).alias("activity"))


def elm_events(mask: DataFrame, *keys: str, threshold: float = 0.5, activity_min: float = 0.1, min_gap: int = 3, min_duration: int = 1) -> DataFrame:
    """Bursts of column activity: keys, start, stop, duration, peak (over all columns within, gaps included)."""
    act = column_activity(mask, threshold, *keys)
    order = Window.partitionBy(*keys).orderBy("t")
    on = F.col("activity") >= activity_min
    prev = F.last(F.when(on, F.col("t")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(on, F.coalesce((F.col("t") - prev - 1 > min_gap).cast("int"), F.lit(1))).otherwise(0)
    runs = act.withColumn("_on", on).withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("run > 0")
    # a run's rows go on to the next run; those after its last active column are cut off
    stop = F.max(F.when(F.col("_on"), F.col("t"))).over(Window.partitionBy(*keys, "run"))
    found = runs.withColumn("_stop", stop).where("t <= _stop").groupBy(*keys, "run").agg(F.min("t").alias("start"), F.max("_stop").alias("stop"), F.max("activity").alias("peak"))
    return found.withColumn("duration", F.col("stop") - F.col("start") + 1).where(F.col("duration") >= min_duration).drop("run")


def elm_summary(events: DataFrame, inputs: DataFrame, hop: int, *keys: str) -> DataFrame:
    """n_events, elm_freq_hz (null without fs) and duty_cycle of every input, also those without events. inputs: keys, n_cols, fs."""
    sums = events.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("duration").alias("d"))
    all_ = inputs.join(sums, list(keys), "left").withColumn("n_events", F.coalesce("n", F.lit(0)))
    freq = F.when((F.col("fs") > 0) & (F.col("n_cols") > 0), F.col("n_events") / (F.col("n_cols") * hop / F.col("fs")))
    duty = F.when(F.col("n_cols") > 0, F.coalesce("d", F.lit(0)) / F.col("n_cols")).otherwise(0.0)
    return all_.select(*keys, "n_events", freq.alias("elm_freq_hz"), duty.alias("duty_cycle"))


def threshold_events(df: DataFrame, limit: float, min_length: int, width: int, *keys: str) -> DataFrame:
    """Runs of at least min_length samples whose causal envelope exceeds limit: start, stop, peak of |x| within."""
    order = Window.partitionBy(*keys).orderBy("i")
    env = df.withColumn("_e", F.max(F.abs("x")).over(order.rowsBetween(-width, 0))).where(F.col("_e") > limit)
    new = F.coalesce((F.col("i") - F.lag("i").over(order) > 1).cast("int"), F.lit(1))
    runs = env.withColumn("_n", new).withColumn("run", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*keys, "run").agg(F.min("i").alias("start"), F.max("i").alias("stop"), F.max(F.abs("x")).alias("peak"))
    return found.where(F.col("stop") - F.col("start") + 1 >= min_length).drop("run")


def onset(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.min("start").alias("onset"))


def mode_events(spectrum: DataFrame, *keys: str, coherence: float, amplitude: float, max_gap: int, min_length: int) -> DataFrame:
    """Events of each mode number n <> 0. spectrum: keys, w (window), f, n (dominant), coh, amp.

    A window is active when any of its bins is significant for n. The peak is the first bin of
    greatest amplitude; coherence is averaged over significant bins.
    """
    good = spectrum.where((F.col("n") != 0) & (F.col("coh") >= coherence) & (F.col("amp") >= amplitude))
    each = good.groupBy(*keys, "n", "w").agg(
        F.max(F.struct("amp", -F.col("w"), -F.col("f"))).alias("top"), F.sum("coh").alias("c"), F.count("*").alias("m"), F.min("f").alias("f0"), F.max("f").alias("f1")
    )
    order = Window.partitionBy(*keys, "n").orderBy("w")
    new = F.coalesce((F.col("w") - F.lag("w").over(order) - 1 > max_gap).cast("int"), F.lit(1))
    runs = each.withColumn("_n", new).withColumn("run", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*keys, "n", "run").agg(
        F.min("w").alias("start"), F.max("w").alias("stop"), F.max("top").alias("top"), (F.sum("c") / F.sum("m")).alias("mean_coherence"), F.min("f0").alias("f_min"), F.max("f1").alias("f_max")
    )
    found = found.where(F.col("stop") - F.col("start") + 1 >= min_length)
    return found.select(*keys, "n", "start", "stop", (-F.col("top")["col3"]).alias("peak_f"), F.col("top")["amp"].alias("peak_amp"), "mean_coherence", "f_min", "f_max")


def overlapping(a: DataFrame, b: DataFrame, bucket: int, *keys: str, how: str = "left_semi") -> DataFrame:
    """Rows of a that overlap (left_semi) or do not overlap (left_anti) an interval of b: an equi-join on buckets of time.

    a and b: keys, start, stop (inclusive); rows of a are told apart by all their columns.
    """
    spread = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))))
    other = spread(b.select(*keys, F.col("start").alias("_s"), F.col("stop").alias("_t"), "start", "stop")).drop("start", "stop")
    hit = spread(a).join(other, [*keys, "_b"]).where((F.col("start") <= F.col("_t")) & (F.col("_s") <= F.col("stop"))).select(*a.columns).distinct()
    same = F.lit(True)
    for c in a.columns:  # null equals null here: unknown columns must not keep a row from being found again
        same = same & F.col(c).eqNullSafe(F.col(f"_hit_{c}"))
    return a.join(hit.select(*(F.col(c).alias(f"_hit_{c}") for c in a.columns)), same, how)


def sessions(events: DataFrame, gap_seconds: float, key: str, time: Column, value: str) -> DataFrame:
    """Runs of a key's events with steps of at most gap_seconds."""
    order = Window.partitionBy(key).orderBy("_t")
    rows = events.withColumn("_t", time)
    new = F.coalesce((F.col("_t") - F.lag("_t").over(order) > gap_seconds).cast("int"), F.lit(1))
    marked = rows.withColumn("_n", new).withColumn("session", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.count("*").alias("n"), (F.max("_t") - F.min("_t")).alias("seconds"), F.sum(value).alias("total"))

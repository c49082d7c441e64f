"""Windows, rolling values, resampling and alignment of long signals (key columns, i, t, x)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import ordered


def blocks(df: DataFrame, size: int, stride: int, *keys: str) -> DataFrame:
    """Each sample once for every full block that holds it: block, j (place in the block). An explode, no range join.

    Where a signal ends is a row a key, met by a join, so that no task needs a whole signal.
    """
    ends = df.groupBy(*(F.col(k).alias(f"_e{i}") for i, k in enumerate(keys))).agg(F.max("i").alias("_end"))
    same = [df[k].eqNullSafe(ends[f"_e{i}"]) for i, k in enumerate(keys)]
    df = (df.join(ends, same) if keys else df.join(F.broadcast(ends))).drop(*(f"_e{i}" for i in range(len(keys))))  # without keys, one row
    last = F.col("_end")
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / stride))
    final = F.least(F.floor(F.col("i") / stride), F.floor((last - size + 1) / stride))
    held = df.withColumn("_a", first).withColumn("_z", final).where("_a <= _z")
    return held.select("*", F.explode(F.sequence("_a", "_z")).alias("block")).withColumn("j", F.col("i") - F.col("block") * stride).drop("_a", "_z", "_end")


def block_statistics(df: DataFrame, size: int, stride: int, *keys: str) -> DataFrame:
    return blocks(df, size, stride, *keys).groupBy(*keys, "block").agg(
        F.count("*").alias("n"), ((F.min("t") + F.max("t")) / 2).alias("centre"), F.avg("x").alias("mean"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")
    )


def fuzzy_frames(lengths: DataFrame, frame: int, step: float, *keys: str) -> DataFrame:
    """Starts of 1 + round((n - frame) / step) frames spread evenly over n samples. lengths: keys, n."""
    n = (1 + F.bround((F.col("n") - frame) / step, 0)).cast("long")
    fits = lengths.where(F.col("n") >= frame).withColumn("frames", n)
    start = F.bround(F.col("k") * (F.col("n") - frame) / F.greatest(F.col("frames") - 1, F.lit(1)), 0).cast("long")
    return fits.select(*keys, "n", "frames", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)).alias("k")).select(*keys, "k", start.alias("start"))


def rolling_max(df: DataFrame, width: int, *keys: str) -> DataFrame:
    """Causal envelope: greatest |x| of the last width + 1 samples."""
    return df.withColumn("envelope", F.max(F.abs("x")).over(ordered(*keys).rowsBetween(-width, 0)))


def rolling_mean(df: DataFrame, width: int, *keys: str) -> DataFrame:
    return df.withColumn("smooth", F.avg("x").over(ordered(*keys).rowsBetween(-(width // 2), width - 1 - width // 2)))


def preemphasis(df: DataFrame, *keys: str, factor: float = 0.99) -> DataFrame:
    return df.withColumn("y", F.col("x") - factor * F.coalesce(F.lag("x").over(ordered(*keys)), F.lit(0.0)))


def cumulative_sum(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumn("total", F.sum("x").over(ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)))


def cumulative_trapezoid(df: DataFrame, *keys: str) -> DataFrame:
    w = ordered(*keys)
    step = df.withColumn("_a", F.coalesce((F.col("x") + F.lag("x").over(w)) / 2, F.lit(0.0)))
    return step.withColumn("area", F.sum("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_a")


def gradient(df: DataFrame, *keys: str) -> DataFrame:
    """Central differences, one-sided at the ends."""
    w = ordered(*keys)
    before, after = F.lag("x").over(w), F.lead("x").over(w)
    return df.withColumn("slope", F.when(before.isNull(), after - F.col("x")).when(after.isNull(), F.col("x") - before).otherwise((after - before) / 2))


def forgetting(df: DataFrame, factor: float, memory: int, *keys: str) -> DataFrame:
    """y_j = factor * y_(j-1) + (1 - factor) * x_j, summed over the last memory samples, beyond which weights are negligible."""
    w = ordered(*keys).rowsBetween(-memory, 0)
    terms = F.collect_list("x").over(w)
    y = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc * factor + (1 - factor) * x)
    return df.withColumn("y", y)


def resampled(df: DataFrame, rate: float, *keys: str) -> DataFrame:
    """Linear interpolation on an even grid of floor(span * rate) + 1 points: each sample fills the grid up to its successor."""
    w = ordered(*keys, by="t")
    ends = df.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_z"))
    seg = df.withColumn("_t1", F.lead("t").over(w)).withColumn("_x1", F.lead("x").over(w)).join(ends, list(keys))
    n = F.floor((F.col("_z") - F.col("_a")) * rate)
    step = (F.col("_z") - F.col("_a")) / F.greatest(n, F.lit(1))
    at = lambda c: F.ceil(F.coalesce(F.try_divide(F.col(c) - F.col("_a"), step), F.lit(0.0)))  # noqa: E731  a series of one time has one point
    first = at("t")
    final = F.when(F.col("_t1").isNull(), n).otherwise(F.least(n, at("_t1") - 1))
    grid = seg.withColumn("_f", first).withColumn("_l", final).where("_f <= _l").withColumn("step", step)
    out = grid.select("*", F.explode(F.sequence("_f", "_l")).alias("k")).withColumn("tk", F.col("_a") + F.col("k") * F.col("step"))
    x = F.when(F.col("_t1").isNull() | (F.col("_t1") == F.col("t")), F.col("x")).otherwise(F.col("x") + (F.col("_x1") - F.col("x")) * (F.col("tk") - F.col("t")) / (F.col("_t1") - F.col("t")))
    return out.select(*keys, F.col("k").cast("long").alias("k"), F.col("tk").alias("t"), x.alias("x"))


def aligned(df: DataFrame, channel: str = "channel", by: str = "i", how: str = "intersection") -> DataFrame:
    """One row a sample with a column map of channels; intersection keeps samples that all channels have."""
    wide = df.groupBy(by).agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.avg("x").alias("mean"))
    if how == "union":
        return wide
    channels = df.select(channel).distinct().agg(F.count("*").alias("channels"))
    return wide.join(F.broadcast(channels), F.col("n") == F.col("channels")).drop("channels")  # one row


def concatenated(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """second after first: its sample numbers go on where those of first end."""
    length = first.groupBy(*keys).agg((F.max("i") + 1).alias("_n"))
    moved = second.join(length, list(keys), "left").withColumn("i", F.col("i") + F.coalesce("_n", F.lit(0))).drop("_n")
    return first.unionByName(moved)


def top_windows(scores: DataFrame, k: int, floor: float, *keys: str) -> DataFrame:
    """The k best windows of each key with a score of at least floor, renumbered densely. scores: keys, window, score."""
    rank = Window.partitionBy(*keys).orderBy(F.desc("score"), "window")
    kept = scores.where(F.col("score") >= floor).withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k)
    return kept.withColumn("new_window", F.row_number().over(Window.partitionBy(*keys).orderBy("window")) - 1).drop("_r")


def neighbours(points: DataFrame, series: DataFrame, bucket: float, *keys: str) -> DataFrame:
    """Each point (t0) with the last sample up to it and the first from it on: columns before, after (structs t, x; null where there is none).

    Of samples at one time the one of least x counts. Points and samples of a key are dealt by time buckets, so a hot key is sorted in
    many tasks. Within a bucket the neighbours are running values; what a bucket lacks comes from the
    ends of the nearest buckets that have samples, found in a table of one row a bucket.
    """
    at = lambda c: F.floor(F.col(c) / bucket)
    rows = series.select(*keys, at("t").alias("_b"), F.col("t").alias("_t"), F.col("x").alias("_x"), F.struct(F.col("t"), F.col("x")).alias("_s"))
    asked = points.select(*points.columns, at("t0").alias("_b"), F.col("t0").alias("_t"), F.lit(True).alias("_ask"))
    rows = rows.unionByName(asked, allowMissingColumns=True)
    held = Window.partitionBy(*keys, "_b").rowsBetween(Window.unboundedPreceding, 0)
    # of samples at one time the one of least x comes last, and before points
    upto = F.last("_s", True).over(held.orderBy("_t", F.col("_ask").asc_nulls_first(), F.col("_x").desc()))
    onward = F.last("_s", True).over(held.orderBy(F.col("_t").desc(), F.col("_ask").asc_nulls_first(), F.col("_x").desc()))
    near = rows.withColumn("_l", upto).withColumn("_r", onward).where("_ask").drop("_ask", "_t", "_x", "_s")
    last = F.max(F.when(F.col("_s").isNotNull(), F.struct(F.col("_t"), (-F.col("_x")).alias("n"), F.col("_s"))))["_s"]
    ends = rows.groupBy(*keys, "_b").agg(F.min("_s").alias("_first"), last.alias("_last"))
    w = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_b", F.last("_last", True).over(w.orderBy("_b")).alias("_before"), F.last("_first", True).over(w.orderBy(F.col("_b").desc())).alias("_after"))
    return near.join(ends, [*keys, "_b"]).select(*points.columns, F.coalesce("_l", "_before").alias("before"), F.coalesce("_r", "_after").alias("after"))


def asof_nearest(points: DataFrame, series: DataFrame, bucket: float, *keys: str) -> DataFrame:
    """For each point the sample at the nearest time, however far (the earliest, then least of equals): columns t, x, d; null without samples."""
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["t"] - F.col("t0")).alias("d"), F.col(c)["t"].alias("t"), F.col(c)["x"].alias("x")))
    best = neighbours(points, series, bucket, *keys).withColumn("_n", F.least(far("before"), far("after")))
    return best.select(*points.columns, "_n.t", "_n.x", "_n.d")


def interpolated(points: DataFrame, series: DataFrame, bucket: float, *keys: str) -> DataFrame:
    """Each point with the series' value at its time, linear between samples and the nearest end's outside: column x, null without samples."""
    a, z = F.col("before"), F.col("after")
    between = a["x"] + (z["x"] - a["x"]) * (F.col("t0") - a["t"]) / (z["t"] - a["t"])
    x = F.when(a.isNull(), z["x"]).when(z.isNull() | (a["t"] == z["t"]), a["x"]).otherwise(between)
    return neighbours(points, series, bucket, *keys).select(*points.columns, x.alias("x"))


def nonempty(df: DataFrame, state: str, *keys: str) -> DataFrame:
    """The windows (keys) in which the boolean column state holds at least once."""
    return df.join(df.where(state).select(*keys).distinct(), list(keys), "left_semi")


def averaged(df: DataFrame, dataset: str, *keys: str) -> DataFrame:
    """Mean of x over datasets at the keys that all datasets have."""
    n = df.select(dataset).distinct().agg(F.count("*").alias("_all"))
    each = df.groupBy(*keys).agg(F.count_distinct(dataset).alias("n"), F.avg("x").alias("x"))
    return each.join(F.broadcast(n), F.col("n") == F.col("_all")).drop("_all")  # one row


def crossings(df: DataFrame, target: float, *keys: str, by: str = "i", last: bool = False, least: float | None = None) -> DataFrame:
    """Where x first (or last) passes target, interpolated linearly: keys, at. Places below least do not count."""
    w = ordered(*keys, by=by)
    seg = df.withColumn("_t", F.lead(by).over(w)).withColumn("_y", F.lead("x").over(w)).where("_y IS NOT NULL")
    rise = (F.col("x") - target) * (F.col("_y") - target)
    hit = seg.where((rise < 0) | (F.col("x") == target) & (F.col("_y") != target))
    place = F.col(by) + (target - F.col("x")) / (F.col("_y") - F.col("x")) * (F.col("_t") - F.col(by))
    found = hit.select(*keys, place.alias("at"))
    if least is not None:
        found = found.where(F.col("at") >= least)
    return found.groupBy(*keys).agg((F.max if last else F.min)("at").alias("at"))


def patches(nodes: DataFrame, column: str, size: float, step: float, count: int, out: str) -> DataFrame:
    """Each node once for every hopping window [k step, k step + size) of the first count that holds it: an explode, no range join."""
    x = F.col(column)
    low = F.greatest(F.lit(0), F.floor((x - size) / step) + 1)
    high = F.least(F.lit(count - 1), F.floor(x / step))
    held = nodes.withColumn("_a", low).withColumn("_z", high).where("_a <= _z")
    return held.withColumn(out, F.explode(F.sequence("_a", "_z"))).drop("_a", "_z")


def preferred(df: DataFrame, order: list[str], source: str, *keys: str) -> DataFrame:
    """The rows of each key's first available source; sources that are not listed do not count."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    ranked = df.withColumn("_r", rank).where("_r > 0")
    best = ranked.groupBy(*keys).agg(F.min("_r").alias("_b"))
    return ranked.join(best, list(keys)).where("_r = _b").drop("_r", "_b")


def scale_length(profiles: DataFrame, place: float, size: float, *keys: str, by: str = "rho") -> DataFrame:
    """L = -f / (df/dr) of each profile at a place, r = size * rho: slopes by weighted differences, f and slope interpolated. profiles: keys, by, x."""
    w = ordered(*keys, by=by)
    step = profiles.withColumn("_r", F.col(by) * size)
    before, after = F.col("_r") - F.lag("_r").over(w), F.lead("_r").over(w) - F.col("_r")
    low, high = (F.col("x") - F.lag("x").over(w)) / before, (F.lead("x").over(w) - F.col("x")) / after
    slope = F.when(before.isNull(), high).when(after.isNull(), low).otherwise((low * after + high * before) / (before + after))
    s = step.withColumn("_s", slope)
    seg = s.select(*keys, by, "x", "_s", *(F.lead(c).over(w).alias(f"{c}1") for c in (by, "x", "_s")))
    share = (F.lit(place) - F.col(by)) / (F.col(f"{by}1") - F.col(by))
    f, g = F.col("x") + share * (F.col("x1") - F.col("x")), F.col("_s") + share * (F.col("_s1") - F.col("_s"))
    return seg.where((F.col(by) <= place) & (F.lit(place) < F.col(f"{by}1"))).select(*keys, f.alias("value"), g.alias("slope"), F.when(g == 0, F.lit(float("inf"))).otherwise(-f / g).alias("length"))


def decimated(df: DataFrame, factor: int, half: int | None = None, ends: str = "weights", *, keys: tuple[str, ...]) -> DataFrame:
    """Every factor-th sample behind a zero-phase low pass (windowed sinc at the new Nyquist frequency): keys, m, y.

    Each sample is added to the outputs whose taps hold it, so a signal is never gathered in one task; at the
    ends the missing samples count as the weights' share of those that are there, or as 0 (ends: weights, zero).
    """
    n = 10 * factor if half is None else half
    taps = [math.sin(math.pi * k / factor) / (math.pi * k) if k else 1 / factor for k in range(-n, n + 1)]
    taps = [t * (0.54 + 0.46 * math.cos(math.pi * k / n)) for t, k in zip(taps, range(-n, n + 1), strict=True)]
    weights = F.array(*(F.lit(t / sum(taps)) for t in taps))
    last = df.groupBy(*keys).agg(F.max("i").alias("_l"))
    held = df.join(last, list(keys)).withColumn("m", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("i") - n) / factor)), F.least(F.floor(F.col("_l") / factor), F.floor((F.col("i") + n) / factor)))))
    w = F.get(weights, (F.col("i") - F.col("m") * factor + n).cast("int"))
    return held.groupBy(*keys, "m").agg((F.sum(w * F.col("x")) / (F.sum(w) if ends == "weights" else F.lit(1.0))).alias("y"))


def noisy(df: DataFrame, level: float, seed: int, *keys: str) -> DataFrame:
    """x plus Gaussian noise of level times the signal's deviation: column y. The noise follows from the seed and the row's place, at any partitioning."""
    s = df.groupBy(*keys).agg(F.stddev_pop("x").alias("_s"))
    uniform = lambda k: (F.pmod(F.xxhash64(*keys, "i", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))
    return df.join(s, list(keys)).withColumn("y", F.col("x") + level * F.col("_s") * normal).drop("_s")

"""Images made ready for models and display: normalised, gated, thresholded; prototypes listed by channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import grids, spectral, stats


def prepared(cells: DataFrame, *keys: str, height: int, magnitude: bool = True, normalisation: str = "zscore", a: float = 1.0, lower: int = 0, upper: int = 0) -> DataFrame:
    """keys, part, f, t, v: complex images as a model takes them. cells: keys, f, t, re, im.

    What is no number counts as 0. magnitude makes one part (0) of each image, else re (0) and im (1) are parts of their own. Each part is
    normalised over its image, zscore (sample deviation) or robust_asinh, and its lowest and highest rows become 0 after that.
    """
    clean = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    re, im = clean("re"), clean("im")
    if magnitude:
        rows = cells.select(*keys, F.lit(0).alias("part"), "f", "t", F.sqrt(re * re + im * im).alias("x"))
    else:
        rows = cells.select(*keys, "f", "t", F.posexplode(F.array(re, im)).alias("part", "x"))
    if normalisation == "robust_asinh":
        found = stats.robust_stats(rows, *keys, "part")
        v = scalars.asinh_norm(F.col("x"), a, F.col("median"), F.col("scale"))
    elif normalisation == "zscore":
        found = rows.groupBy(*keys, "part").agg(F.avg("x").alias("_m"), F.stddev_samp("x").alias("_s"))
        v = (F.col("x") - F.col("_m")) / (F.coalesce("_s", F.lit(0.0)) + 1e-6)
    else:
        raise ValueError(f"no such normalisation: {normalisation}")
    edge = (F.col("f") < lower) | (F.col("f") >= height - upper)
    return rows.join(found, [*keys, "part"]).select(*keys, "part", "f", "t", F.when(edge, 0.0).otherwise(v).alias("v"))


def rising(cells: DataFrame, thresholds: DataFrame, *keys: str, height: int, bottom: int, top: int, min_size: int, first: int = 2, last: int = 1, tile: int = 512) -> DataFrame:
    """keys, f, t of the cells whose slope along t exceeds their image's threshold, without edge rows and columns and small regions.

    cells: keys, f, t, x; thresholds: keys, threshold (images without one give nothing). Slopes are central differences, one-sided at the ends;
    rows below bottom and from height - top on, the first columns and the last ones do not count, nor do 4-connected regions of fewer than min_size cells.
    """
    order = Window.partitionBy(*keys, "f").orderBy("t")
    before, after = F.lag("x").over(order), F.lead("x").over(order)
    slope = F.when(before.isNull(), after - F.col("x")).when(after.isNull(), F.col("x") - before).otherwise((after - before) / 2)
    ends = cells.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_z"))
    limits = ends.join(thresholds, list(keys))
    held = cells.withColumn("_d", slope).join(limits, list(keys))
    inside = F.col("f").between(bottom, height - top - 1) & F.col("t").between(F.col("_a") + first, F.col("_z") - last)
    on = held.where(inside & (F.col("_d") > F.col("threshold"))).select(*keys, "f", "t", F.lit(True).alias("s"))
    return grids.without_small(on, grids.connected_regions(on, *keys, tile=tile), min_size, *keys).select(*keys, "f", "t")


def gated(cells: DataFrame, *keys: str, level: float = 1.5, sigma: float = 2.0, factor: float = 0.9) -> DataFrame:
    """keys, f, t, v: images dimmed where their columns show nothing. cells: keys, f, t, v.

    A cell above its column's mean by `level` deviations opens the gate; the gate is blurred both ways, brought to 0 to 1, and lets
    all of the image through where it is open and 1 - factor of it where it is shut. An image whose gate is the same everywhere has it shut.
    """
    column = cells.groupBy(*keys, "t").agg((F.avg("v") + level * F.stddev_pop("v")).alias("_l"))
    gate = cells.join(column, [*keys, "t"]).select(*keys, "f", "t", (F.col("v") > F.col("_l")).cast("double").alias("v"))
    turned = lambda df: df.select(*keys, F.col("t").alias("f"), F.col("f").alias("t"), "v")
    soft = turned(grids.blurred(turned(grids.blurred(gate, sigma, *keys)), sigma, *keys)).withColumnRenamed("v", "_g")
    ends = soft.groupBy(*keys).agg(F.min("_g").alias("_a"), F.max("_g").alias("_z")) if keys else None
    if keys:
        soft = soft.join(ends, list(keys))
    else:
        soft = soft.join(F.broadcast(soft.agg(F.min("_g").alias("_a"), F.max("_g").alias("_z"))))  # one row
    open_ = F.coalesce(F.try_divide(F.col("_g") - F.col("_a"), F.col("_z") - F.col("_a")), F.lit(0.0))
    return cells.join(soft.select(*keys, "f", "t", open_.alias("_o")), [*keys, "f", "t"]).select(*keys, "f", "t", (F.col("v") * (F.col("_o") * factor + (1 - factor))).alias("v"))


def averaged_spectrogram(df: DataFrame, n_fft: int, overlap: float, fs: float, channel: str, *keys: str) -> DataFrame:
    """keys, block, k, p: power density of each Hann segment, its mean taken off, averaged over the channels."""
    names = (*keys, channel)
    spec = spectral.spectra(spectral.framed(df, n_fft, n_fft - int(n_fft * overlap), *names), n_fft, "hann", True, keys=names)
    scale = fs * float((spectral.window_values("hann", n_fft) ** 2).sum())
    side = F.when((F.col("k") == 0) | ((F.col("k") == n_fft // 2) & F.lit(n_fft % 2 == 0)), 1.0).otherwise(2.0)
    return spectral.power_rows(spec, *names).withColumn("_p", F.col("p") * side / scale).groupBy(*keys, "block", "k").agg(F.avg("_p").alias("p"))


def displayed(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, f, t, v: log(1 + |z| / max |z|) of each image. cells: keys, f, t, re, im."""
    size = cells.select(*keys, "f", "t", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("_v"))
    top = size.groupBy(*keys).agg(F.max("_v").alias("_m"))
    both = size.join(top, list(keys)) if keys else size.join(F.broadcast(top))  # one row
    return both.select(*keys, "f", "t", F.log1p(F.when(F.col("_m") > 0, F.col("_v") / F.col("_m")).otherwise(F.col("_v"))).alias("v"))


def prototype_channels(shapes: DataFrame, places: DataFrame | None = None, share: float = 0.95) -> DataFrame:
    """mode, channel (from 1), r, z, phi, amplitude, phase: of each mode the channels with more than a share of its greatest amplitude.

    shapes: mode, re, im (arrays by channel); places: channel (from 1), r, z, phi; channels without a place are at 0.
    """
    size = F.zip_with("re", "im", lambda a, b: F.sqrt(a.cast("double") ** 2 + b.cast("double") ** 2))
    each = shapes.withColumn("_top", F.array_max(size)).select("mode", "_top", F.posexplode(F.arrays_zip("re", "im")).alias("_k", "z"))
    amplitude = F.sqrt(F.col("z.re").cast("double") ** 2 + F.col("z.im").cast("double") ** 2)
    kept = each.select("mode", (F.col("_k") + 1).alias("channel"), amplitude.alias("amplitude"), F.atan2("z.im", "z.re").alias("phase"), "_top").where(F.col("amplitude") > share * F.col("_top")).drop("_top")
    if places is None:
        return kept.select("mode", "channel", *(F.lit(0.0).alias(c) for c in ("r", "z", "phi")), "amplitude", "phase")
    return kept.join(places, "channel", "left").select("mode", "channel", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("r", "z", "phi")), "amplitude", "phase")


def array_order(channels: DataFrame, row: float = 0.02, middle: float = 5.6287, reach: float = 0.1) -> DataFrame:
    """channels (channel, x, y) with part and place: first those of the row (|x| up to `row`) by y, then those near the middle y by x, then the rest by name."""
    part = F.when(F.abs("x") <= row, 0).when(F.abs(F.col("y") - middle) <= reach, 1).otherwise(2)
    by = F.when(F.col("part") == 0, F.col("y")).when(F.col("part") == 1, F.col("x"))
    order = Window.partitionBy("part").orderBy(by, "channel")
    parts = channels.withColumn("part", part)
    sizes = parts.groupBy("part").agg(F.count("*").alias("_n"))  # three rows
    before = sizes.select(F.col("part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return parts.join(F.broadcast(before), F.col("part") == F.col("_p")).select(*channels.columns, "part", (F.col("_b") + F.row_number().over(order) - 1).alias("place"))

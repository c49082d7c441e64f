"""Where a mode sits among the channels of a profile, and the amplitude of a band over many probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters, frames, spectral


def _arrays(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a signal: keys, ts and x in the order of t."""
    s = F.array_sort(F.collect_list(F.struct("t", "x")))
    return rows.groupBy(*keys).agg(s.alias("_s")).select(*keys, F.transform("_s", lambda v: v["t"].cast("double")).alias("ts"), F.transform("_s", lambda v: v["x"].cast("double")).alias("x"))


def by_amplitude(samples: DataFrame, low: float, high: float, window: tuple[float, float], fs: float, least: float = 0.05, order: int = 4) -> DataFrame:
    """channel, level, metric: rms of each channel's part between two frequencies within the window, over the median of the whole signal.

    Channels whose level is not above least have a metric of 0. samples: channel, t, x; frequencies in units of fs. The whole signal is filtered, the window cut after.
    """
    edges = (low / (fs / 2), min(high / (fs / 2), 0.999))
    level = samples.groupBy("channel").agg(F.median("x").alias("level"))
    centred = _arrays(samples.join(level, "channel").select("channel", "level", "t", (F.col("x") - F.col("level")).alias("x")), "channel", "level")
    y = filters.filtered(centred, "band", edges, order, keys=("channel", "level", "ts"))
    held = F.filter(F.arrays_zip("ts", "y"), lambda v: v["ts"].between(*window))
    rms = F.sqrt(F.aggregate(held, F.lit(0.0), lambda s, v: s + v["y"] * v["y"]) / F.size(held))
    return y.select("channel", "level", F.when(F.col("level") > least, F.coalesce(rms / F.col("level"), F.lit(0.0))).otherwise(0.0).alias("metric"))


def by_coherence(samples: DataFrame, reference: DataFrame, low: float, high: float, window: tuple[float, float], fs: float, segment: int, bucket: float, least: float = 0.05) -> DataFrame:
    """channel, level, metric: mean coherence of each channel with a reference on another time base, over the bins between two frequencies.

    The reference (t, x) is interpolated at the channels' times; both lose their mean over the window, and Hann segments of
    `segment` samples overlap by half. level: the channel's median in the window; where it is not above least, and where no bin lies in the band, the metric is 0.
    """
    held = samples.where(F.col("t").between(*window))
    level = held.groupBy("channel").agg(F.median("x").alias("level"), F.min("i").alias("_first"))
    times = held.select(F.col("t").alias("t0")).distinct()
    at = frames.interpolated(times, reference.select("t", "x"), bucket).select(F.col("t0").alias("t"), F.col("x").alias("_r"))
    both = held.join(at, "t").join(level, "channel").select("channel", (F.col("i") - F.col("_first")).alias("i"), "x", "_r")
    spec = lambda c: spectral.spectra(spectral.framed(both.select("channel", "i", F.col(c).cast("double").alias("x")), segment, segment // 2, "channel"), segment, "hann", True, keys=("channel",))
    f = F.col("k") * fs / segment
    band = spectral.cross(spec("x"), spec("_r"), "channel").where((f >= low) & (f <= high)).groupBy("channel").agg(F.avg("coherence").alias("_m"))
    return level.join(band, "channel", "left").select("channel", "level", F.when(F.col("level") >= least, F.coalesce("_m", F.lit(0.0))).otherwise(0.0).alias("metric"))


def segment_of(samples: int) -> int:
    """The usual length of segments for a window of so many samples: a quarter, 256 at most and 16 at least."""
    return max(16, min(256, samples // 4))


def located(metrics: DataFrame, places: DataFrame, axis: float | None = None, minor: float | None = None) -> DataFrame:
    """metrics with each channel's place, rho = |place - axis| / minor (null without) and peak: whether it is the one of greatest metric (the first of equals)."""
    rows = metrics.join(places, "channel")
    rho = F.abs(F.col("place") - axis) / minor if axis is not None and minor else F.lit(None).cast("double")
    top = rows.agg(F.max(F.struct(F.round("metric", 12).alias("m"), (-F.col("channel")).alias("n"))).alias("_top"))  # one row
    return rows.join(F.broadcast(top)).select(*rows.columns, rho.alias("rho"), (F.col("channel") == -F.col("_top.n")).alias("peak")).drop("_top")


def probe_amplitude(samples: DataFrame, window: tuple[float, float], edges: tuple[float, float], least: int = 10, kind: str = "absolute", order: int = 4) -> DataFrame:
    """k, t, probes, amplitude: the root of the mean square, over probes, of the band's envelope at each sample of a window.

    samples: probe, t, x. Probes with fewer than `least` samples there do not count; the k-th samples of all others are put together as long
    as all have one, at the time of the first probe. edges: the band in shares of half the sample rate; kind as in filters.envelopes.
    """
    rows = _arrays(samples.where(F.col("t").between(*window)), "probe").where(F.size("x") >= least)
    y = filters.envelopes(rows, edges, order, kind, keys=("probe", "ts"))
    each = y.select("probe", F.posexplode(F.arrays_zip("ts", "y")).alias("k", "v"))
    probes = y.agg(F.count("*").alias("_all"))  # one row
    sums = each.groupBy("k").agg(F.min_by("v.ts", "probe").alias("t"), F.count("*").alias("probes"), F.sqrt(F.avg(F.pow("v.y", F.lit(2)))).alias("amplitude"))
    return sums.join(F.broadcast(probes), F.col("probes") == F.col("_all")).drop("_all")



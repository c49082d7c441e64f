"""Element-wise formulas as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_scale(x: Column) -> Column:
    """log(1 + x); negative values are an error."""
    return F.when(x < 0, F.raise_error("log_scale: negative value").cast("double")).otherwise(F.log1p(x))


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def asinh_norm(x: Column, a: float, median: Column, scale: Column) -> Column:
    return F.lit(a) * F.asinh((x - median) / (F.lit(a) * scale))


def clipped(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (c if isinstance(c, Column) else F.lit(c) for c in (low, high))
    return F.least(F.greatest(x, low), high)


def unit_range(x: Column, low: float, high: float) -> Column:
    """Clip, then scale to [0, 1]."""
    return (clipped(x, low, high) - low) / (high - low)


def enhanced(x: Column, low_percent: float, high_percent: float) -> Column:
    """Values under a lower limit become 0, over an upper limit 1."""
    return F.when(x < low_percent / 100, 0.0).when(x > high_percent / 100, 1.0).otherwise(x)


def spectral_gate(x: Column, m0: Column, m1: Column, threshold: float, use0: bool = True, use1: bool = True) -> Column:
    """x where an enabled mask is above the threshold, else 0."""
    open_ = (m0 > threshold) & F.lit(use0) | (m1 > threshold) & F.lit(use1)
    return F.when(open_, x).otherwise(0.0)


def overlay(m0: Column, m1: Column, threshold: float) -> Column:
    """Class of an overlay pixel: the transient mask is drawn last."""
    return F.when(m1 >= threshold, "transient").when(m0 >= threshold, "coherent").otherwise("none")


def column_seconds(col: Column, hop: int, fs: Column) -> Column:
    """Time of a column, unknown without a sample rate."""
    return F.when(fs > 0, col * hop / fs)


def row_khz(row: Column, n_fft: int, fs: Column, offset: int = 1) -> Column:
    return F.when(fs > 0, (row + offset) * fs / n_fft / 1e3)


def milliseconds(t: Column, largest: Column) -> Column:
    """Times whose largest magnitude is below 100 are seconds."""
    return F.when(largest < 100, t * 1e3).otherwise(t)


def c95(n: Column) -> Column:
    """Coherence that noise stays below with 95 %, after averaging n bins."""
    return F.when(n < 2, 0.0).otherwise(F.pow(F.tanh(1.96 / F.sqrt(2.0 * n - 2)), F.lit(2)))


def symmetric_hann(i: Column, n: Column) -> Column:
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / (n - 1))


def periodic_hann(i: Column, n: Column) -> Column:
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / n)


def focal_loss(p: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    pt = F.when(y == 1, p).otherwise(1 - p)
    weight = F.when(y == 1, alpha).otherwise(1 - alpha)
    return -weight * F.pow(1 - pt, F.lit(gamma)) * F.log(clipped(pt, 1e-7, 1.0))


def symmetric_cross_entropy(p: Column, y: Column, alpha: float = 1.0, beta: float = 1.0, floor: float = 1e-4) -> Column:
    q = clipped(p, 1e-7, 1 - 1e-7)
    forward = -(y * F.log(q) + (1 - y) * F.log(1 - q))
    hard = clipped(y.cast("double"), floor, 1.0)
    other = clipped(1.0 - y, floor, 1.0)
    return alpha * forward + beta * -(q * F.log(hard) + (1 - q) * F.log(other))


def smoothed_cross_entropy(p: Column, y: Column, smoothing: float) -> Column:
    """Targets become y (1 - s) + s: 1 stays 1 and 0 becomes s."""
    t = y * (1 - smoothing) + smoothing
    q = clipped(p, 1e-7, 1 - 1e-7)
    return -(t * F.log(q) + (1 - t) * F.log(1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def binary_entropy(p: Column) -> Column:
    q = clipped(p, 1e-12, 1 - 1e-12)
    return -(q * F.log(q) + (1 - q) * F.log(1 - q))


def soft_target(y: Column, p: Column, weight: float) -> Column:
    return (1 - weight) * y + weight * p


def baseline_weight(freq_bins: Column, base: float = 1e6, reference: int = 513) -> Column:
    """Smoothing weight of a baseline: grows with the fourth power of the bins."""
    return base * F.pow(freq_bins / reference, F.lit(4))


def layer_count(freq_bins: Column, time_bins: Column, cap: int = 5) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(cap), F.floor(F.log2(F.least(freq_bins, time_bins) / 4)))).cast("long")


def padded(n: Column, multiple: Column) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("long")


def batch_size(base: int, freq_bins: Column, time_bins: Column, layers: Column) -> Column:
    step = F.pow(F.lit(2.0), layers).cast("long")
    return F.greatest(F.lit(1), F.floor(base * 513 * 516 / (padded(freq_bins, step) * padded(time_bins, step)))).cast("long")


def share_of(n: Column, fraction: float) -> Column:
    """At least one of n, else the fraction cut to an integer."""
    return F.greatest(F.lit(1), F.floor(n * fraction)).cast("long")


def channel_radius(field: Column, axis: Column, freq_ghz: Column) -> Column:
    """Radius at which the second harmonic of the cyclotron frequency is freq_ghz."""
    return 56.0 * field * axis / freq_ghz


def yolo_box(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> list[Column]:
    """Centre and size of a box as shares of an image."""
    return [(x + w / 2) / width, (y + h / 2) / height, w / width, h / height]


def combined_loss(losses: list[Column], weights: list[float]) -> Column:
    """The weighted sum of losses; their numbers must agree."""
    return sum((w * x for x, w in zip(losses, weights, strict=True)), F.lit(0.0))

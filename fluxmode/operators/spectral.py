"""Spectra of framed signals.

Two forms: a relational one, whose twiddle factors are columns and whose sums Spark folds, and an
FFT in Arrow batches for production frame lengths. A frame is one row (keys, block, x array), so frames
of a long signal spread over all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames


def dft_power(df: DataFrame, n: int, bins: int, *keys: str) -> DataFrame:
    """|sum x e^(-2 pi i k j / n)|^2 for k < bins of rows with keys, i, x: the sums of all bins in one pass."""
    angle = lambda k: -2 * math.pi * ((F.col("i") * k) % n) / n
    sums = [f(F.col("x") * g(angle(k))).alias(f"{c}{k}") for k in range(bins) for f, g, c in ((F.sum, F.cos, "c"), (F.sum, F.sin, "s"))]
    wide = df.groupBy(*keys).agg(*sums)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("re"), F.col(f"s{k}").alias("im")) for k in range(bins)))).alias("b")
    return wide.select(*keys, each).select(*keys, "b.k", "b.re", "b.im", (F.col("b.re") ** 2 + F.col("b.im") ** 2).alias("power"))


def dense(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """One row a signal: keys, block 0, x of n samples, sums by i modulo n, 0 where there is none."""
    sums = df.groupBy(*keys, F.pmod(F.col("i"), F.lit(n)).cast("int").alias("_i")).agg(F.sum("x").alias("_x"))
    held = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_x"))).alias("_m"))
    x = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)))
    return held.select(*keys, F.lit(0).cast("long").alias("block"), x.alias("x"))


def framed(df: DataFrame, size: int, stride: int, *keys: str) -> DataFrame:
    """One row a full block: keys, block, x in order."""
    parts = frames.blocks(df, size, stride, *keys)
    x = F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"])
    return parts.groupBy(*keys, "block").agg(x.alias("x"))


def window_values(kind: str, n: int) -> np.ndarray:
    i = np.arange(n)
    if kind == "hann":  # periodic
        return 0.5 - 0.5 * np.cos(2 * np.pi * i / n)
    if kind == "hanning":  # symmetric
        return 0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) if n > 1 else np.ones(n)
    if kind == "hamming":
        return 0.54 - 0.46 * np.cos(2 * np.pi * i / (n - 1)) if n > 1 else np.ones(n)
    if kind == "blackman":
        return 0.42 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) + 0.08 * np.cos(4 * np.pi * i / (n - 1)) if n > 1 else np.ones(n)
    return np.ones(n)


def spectra(blocks: DataFrame, n_fft: int, window: str = "hann", detrend: bool = False, *, keys: tuple[str, ...] = ()) -> DataFrame:
    """re, im arrays (n_fft // 2 + 1 bins) of each frame: one FFT of a whole Arrow batch."""

    def run(batches):
        w = None
        for b in batches:
            x = np.array(b.column(b.num_columns - 1).to_pylist(), float)
            if not x.size:
                continue
            if w is None:
                w = window_values(window, x.shape[1])
            if detrend:
                x = x - x.mean(1, keepdims=True)
            s = np.fft.rfft(x * w, n_fft, axis=1)
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(s.real), pa.list_(pa.float64())), pa.array(list(s.imag), pa.list_(pa.float64()))], [*b.schema.names[:-1], "re", "im"])

    names = [*keys, "block"]
    types = dict(blocks.dtypes)
    return blocks.select(*names, "x").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", re array<double>, im array<double>")


def power_rows(spec: DataFrame, *keys: str) -> DataFrame:
    """keys, block, k, p: a row a bin."""
    z = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    return spec.select(*keys, "block", F.posexplode(z).alias("k", "p"))


def stft_magnitude(df: DataFrame, n_fft: int, hop: int, *keys: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """log(1 + |spectrum|) without the lowest row, clipped to the image's percentiles: keys, f, t, v."""
    spec = spectra(framed(df, n_fft, hop, *keys), n_fft, "hann", keys=keys)
    image = power_rows(spec, *keys).where("k > 0").select(*keys, (F.col("k") - 1).alias("f"), F.col("block").alias("t"), F.log1p(F.sqrt("p")).alias("x"))
    limits = image.groupBy(*keys).agg(F.percentile("x", F.array(F.lit(low), F.lit(high))).alias("_q"))
    return image.join(limits, list(keys)).select(*keys, "f", "t", F.least(F.greatest("x", F.col("_q")[0]), F.col("_q")[1]).alias("v"))


def welch(df: DataFrame, n_fft: int, overlap: float, fs: float, *keys: str) -> DataFrame:
    """Mean power density over Hann segments, constant part removed: keys, k, psd."""
    spec = spectra(framed(df, n_fft, max(1, int(n_fft * (1 - overlap))), *keys), n_fft, "hann", True, keys=keys)
    scale = fs * float(np.square(window_values("hann", n_fft)).sum())
    side = F.when((F.col("k") == 0) | (F.col("k") == n_fft // 2), 1.0).otherwise(2.0)
    return power_rows(spec, *keys).groupBy(*keys, "k").agg((F.avg("p") * F.first(side) / scale).alias("psd"))


def kfold_median(df: DataFrame, size: int, folds: int, *keys: str) -> DataFrame:
    """Median over the sub-folds of each block of their spectra, which a burst in one fold cannot lift: keys, big, k, p."""
    part = size // folds
    spec = spectra(framed(df, part, part, *keys), part, "hann", True, keys=keys)
    return power_rows(spec, *keys).withColumn("big", F.floor(F.col("block") / folds)).groupBy(*keys, "big", "k").agg(F.median("p").alias("p"))


def cross(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Averaged cross spectrum and coherence of two signals' frames: keys, k, re, im, coherence."""
    bins = lambda s, x, y: s.select(*keys, "block", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select(*keys, "block", "k", F.col("z.re").alias(x), F.col("z.im").alias(y))
    both = bins(a, "ar", "ai").join(bins(b, "br", "bi"), [*keys, "block", "k"])
    re, im = F.col("ar") * F.col("br") + F.col("ai") * F.col("bi"), F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")
    g = both.groupBy(*keys, "k").agg(F.avg(re).alias("re"), F.avg(im).alias("im"), F.avg(F.col("ar") ** 2 + F.col("ai") ** 2).alias("_a"), F.avg(F.col("br") ** 2 + F.col("bi") ** 2).alias("_b"))
    coh = (F.col("re") ** 2 + F.col("im") ** 2) / F.greatest(F.col("_a") * F.col("_b"), F.lit(1e-15))
    return g.select(*keys, "k", "re", "im", F.least(coh, F.lit(1.0)).alias("coherence"))


def entropy(power: DataFrame, *keys: str, value: str = "power") -> DataFrame:
    """Natural-log entropy of normalised power."""
    total = power.groupBy(*keys).agg(F.sum(value).alias("_t"))
    p = F.try_divide(F.col(value), F.col("_t"))
    joined = power.join(total, list(keys)) if keys else power.join(F.broadcast(total))  # one row
    return joined.groupBy(*keys).agg((-F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))).alias("entropy"))


def forgetting_coherence(a: DataFrame, b: DataFrame, factor: float, memory: int, *keys: str) -> DataFrame:
    """Coherence of spectra that fade by factor from block to block: keys, block, k, coherence.

    The recurrence P = factor P + (1 - factor) p is a weighted sum of the last memory blocks, beyond
    which weights are negligible; the common factor 1 - factor cancels out.
    """
    bins = lambda s, x, y: s.select(*keys, "block", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select(*keys, "block", "k", F.col("z.re").alias(x), F.col("z.im").alias(y))
    both = bins(a, "ar", "ai").join(bins(b, "br", "bi"), [*keys, "block", "k"])
    p = both.select(
        *keys, "block", "k", (F.col("ar") ** 2 + F.col("ai") ** 2).alias("xx"), (F.col("br") ** 2 + F.col("bi") ** 2).alias("yy"),
        (F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("re"), (F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")).alias("im"),
    )
    w = Window.partitionBy(*keys, "k").orderBy("block").rowsBetween(-memory, 0)
    fade = lambda c: F.aggregate(F.collect_list(c).over(w), F.lit(0.0), lambda acc, v: acc * factor + v)
    g = p.select(*keys, "block", "k", *(fade(c).alias(c) for c in ("xx", "yy", "re", "im")))
    return g.select(*keys, "block", "k", F.least((F.col("re") ** 2 + F.col("im") ** 2) / F.greatest(F.col("xx") * F.col("yy"), F.lit(1e-15)), F.lit(1.0)).alias("coherence"))

"""Mode numbers from a ring of sensors: matched filters over probe spectra."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import similarity


def steering(probes: DataFrame, angles: dict[int, float], numbers: range, *keys: str) -> DataFrame:
    """|sum_c F_c e^(-i n phi_c)| / N for each n: keys, n, amp. probes: channel, keys, re, im; angles in degrees.

    All numbers' sums are taken in one aggregate; its partial sums fold the probes before the shuffle.
    """
    phi = F.element_at(F.create_map(*(x for c, a in angles.items() for x in (F.lit(c), F.lit(math.radians(a))))), F.col("channel"))
    cos, sin = (lambda n: F.cos(n * phi)), (lambda n: F.sin(n * phi))
    sums = []
    for n in numbers:
        sums += [F.sum(F.col("re") * cos(n) + F.col("im") * sin(n)).alias(f"r{n}"), F.sum(F.col("im") * cos(n) - F.col("re") * sin(n)).alias(f"i{n}")]
    wide = probes.groupBy(*keys).agg(F.count("*").alias("_n"), *sums)
    each = F.array(*(F.struct(F.lit(n).alias("n"), (F.sqrt(F.col(f"r{n}") ** 2 + F.col(f"i{n}") ** 2) / F.col("_n")).alias("amp")) for n in numbers))
    return wide.select(*keys, F.explode(each).alias("e")).select(*keys, "e.n", "e.amp")


def dominant(amplitudes: DataFrame, *keys: str) -> DataFrame:
    """The number of greatest amplitude (the least of equals) and its share of all: keys, n, amp, coherence."""
    best = F.max(F.struct(F.col("amp"), (-F.col("n")).alias("m"))).alias("b")
    g = amplitudes.groupBy(*keys).agg(best, F.sum("amp").alias("_t"))
    return g.select(*keys, (-F.col("b.m")).alias("n"), F.col("b.amp").alias("amp"), F.when(F.col("_t") > 1e-30, F.col("b.amp") / F.col("_t")).otherwise(0.0).alias("coherence"))


def mode_rms(amplitudes: DataFrame, df_hz: float, *keys: str) -> DataFrame:
    """sqrt of the trapezoid over frequency of amp^2: keys, n, rms. amplitudes: keys, n, k, amp."""
    w = Window.partitionBy(*keys, "n").orderBy("k")
    step = amplitudes.withColumn("_p", F.col("amp") ** 2)
    step = step.withColumn("_a", (F.col("_p") + F.lag("_p").over(w)) / 2 * df_hz)
    return step.groupBy(*keys, "n").agg(F.sqrt(F.coalesce(F.sum("_a"), F.lit(0.0))).alias("rms"))


def timeslice_fit(phases: DataFrame, angles: dict[int, float], numbers: range, *keys: str) -> DataFrame:
    """chi^2 of each n after removing the circular mean offset, weighted by 1 / sigma^2: keys, n, chi2. phases: keys, channel, phase, w."""
    phi = F.element_at(F.create_map(*(x for c, a in angles.items() for x in (F.lit(c), F.lit(math.radians(a))))), F.col("channel"))
    wrap = lambda x: F.atan2(F.sin(x), F.cos(x))
    each = phases.withColumn("n", F.explode(F.array(*map(F.lit, numbers)))).withColumn("_d", F.col("phase") - F.col("n") * phi)
    mean = each.groupBy(*keys, "n").agg(F.atan2(F.sum(F.col("w") * F.sin("_d")), F.sum(F.col("w") * F.cos("_d"))).alias("_m"))
    return each.join(mean, [*keys, "n"]).groupBy(*keys, "n").agg(F.sum(F.col("w") * wrap(F.col("_d") - F.col("_m")) ** 2).alias("chi2"))


def harmonic_mac(shapes: DataFrame, m_max: int, n_max: int, *keys: str) -> DataFrame:
    """MAC of each shape with exp(i (m x + n y)) for |m| <= m_max, |n| <= n_max: keys, m, n, mac. shapes: keys, x, y, re, im by sensor."""
    grid = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(n).alias("n")) for m in range(-m_max, m_max + 1) for n in range(-n_max, n_max + 1))))
    each = shapes.select("*", grid.alias("g")).withColumn("_p", F.col("g.m") * F.col("x") + F.col("g.n") * F.col("y"))
    c, s = F.cos("_p"), F.sin("_p")
    re, im = F.sum(F.col("re") * c + F.col("im") * s), F.sum(F.col("im") * c - F.col("re") * s)
    power = F.sum(F.col("re") ** 2 + F.col("im") ** 2)
    return each.groupBy(*keys, F.col("g.m").alias("m"), F.col("g.n").alias("n")).agg(F.when(power > 0, (re * re + im * im) / (power * F.count("*"))).otherwise(0.0).alias("mac"))


def prototypes(poles: DataFrame, queries: list[tuple[float, float]], warn: float = 5.0) -> DataFrame:
    """For each (time in ms, frequency in kHz) asked for, the nearest pole: query, the pole's columns, distance, far.

    The queries are a short list, laid beside each pole; a partial aggregate keeps one pole a query and task.
    poles: time (ms), frequency (kHz) and other columns.
    """
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("query"), F.lit(float(t)).alias("t0"), F.lit(float(f)).alias("f0")) for i, (t, f) in enumerate(queries)))).alias("_q")
    each = poles.select("*", asked)
    d = F.sqrt((F.col("time") - F.col("_q.t0")) ** 2 + (F.col("frequency") - F.col("_q.f0")) ** 2)
    others = [c for c in poles.columns if c not in ("time", "frequency")]
    best = each.groupBy(F.col("_q.query").alias("query")).agg(F.min(F.struct(d.alias("distance"), "time", "frequency", *others)).alias("b"))
    return best.select("query", "b.time", "b.frequency", *(f"b.{c}" for c in others), "b.distance", (F.col("b.distance") > warn).alias("far"))


def prototype_traces(references: DataFrame, samples: DataFrame, longest: float, periods: float = 5.0, default: float | None = None) -> DataFrame:
    """The signal around each reference, projected on its shape: reference, time (from the reference's), signal.

    A reference's window is `periods` of its frequency, `longest` at most; default (half of longest) if the frequency is not
    positive. references: reference, time, frequency, re, im (arrays by channel); samples: t, x (array by channel). The projection is
    the real part of the sum of x times the conjugate shape. References and samples meet in time buckets as long as the longest window,
    so each reference lies in two at most. Shapes of another length than the samples give nothing.
    """
    width = F.when(F.col("frequency") > 0, F.least(periods / F.col("frequency"), F.lit(longest))).otherwise(longest / 2 if default is None else default)
    asked = references.select("reference", F.col("time").alias("_c"), F.col("re").cast("array<double>").alias("re"), (width / 2).alias("_h"))
    asked = asked.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_c") - F.col("_h")) / longest), F.floor((F.col("_c") + F.col("_h")) / longest))))
    held = samples.select("t", F.col("x").cast("array<double>").alias("x"), F.floor(F.col("t") / longest).alias("_b")).join(asked, "_b")
    held = held.where((F.abs(F.col("t") - F.col("_c")) <= F.col("_h")) & (F.size("x") == F.size("re")))
    # samples are real: only the shape's real part counts
    signal = F.aggregate(F.zip_with("x", "re", lambda x, s: x * s), F.lit(0.0), lambda total, v: total + v)
    return held.select("reference", (F.col("t") - F.col("_c")).alias("time"), signal.alias("signal"))


def traces(shapes: DataFrame, references: DataFrame, least: float, block: str = "block") -> DataFrame:
    """For each reference and block the shape of greatest MAC with it (the least id of equals), if that reaches least.

    shapes: block, id, re, im. references: reference, re, im; sent to the tasks as a matrix, in parts of checked size.
    """
    z = F.concat(F.col("re").cast("array<double>"), F.col("im").cast("array<double>")).alias("z")
    asked = references.select(F.col("reference").alias("id"), z)
    dim = asked.select(F.max(F.size("z"))).first()[0] or 0
    whole = (F.size("re") == dim // 2) & (F.size("im") == dim // 2)  # a shape of another length has no MAC
    found = similarity.best_by_block(shapes.where(whole).select("id", block, z), asked.where(F.size("z") == dim), least, "mac", "id", "z", block)
    return found.select(F.col("query").alias("reference"), F.col("block").alias(block), "id", F.col("similarity").alias("mac"))


def csm_modes(probes: DataFrame, angles: dict[int, float], numbers: range, n_avg: int = 8, n_src: int = 1, *, frame: str = "w", bin: str = "k") -> DataFrame:
    """Modes from cross-spectral matrices: frame, bin, power, coherence, n, amplitudes and music (dB) in the order of numbers.

    Each matrix averages the outer products of the probes' spectra over the frames within n_avg // 2 of its own. Its
    leading eigenvector is held against unit steering vectors; n is the number of greatest projection (the first
    of equals), and music the projection's distance from the space of the n_src leading eigenvectors. probes: channel, frame, bin, re, im.
    """
    order = sorted(angles)
    z = probes.groupBy(frame, bin).agg(*(F.sum(F.when(F.col("channel") == c, F.col(p))).alias(f"{p}{c}") for c in order for p in ("re", "im")))
    snap = z.select(frame, bin, F.array(*(F.coalesce(f"{p}{c}", F.lit(0.0)) for p in ("re", "im") for c in order)).alias("z"))
    half = n_avg // 2
    # each snapshot goes to the frames it counts for: groups of n_avg + 1 at most, however long the signal
    offset = F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_o")
    sent = snap.select(bin, "z", F.col(frame).alias("_f"), offset).select((F.col("_f") + F.col("_o")).cast(dict(snap.dtypes)[frame]).alias(frame), bin, "_o", "z")
    near = sent.groupBy(frame, bin).agg(F.array_sort(F.collect_list(F.struct("_o", "z"))).alias("_s"), F.max(F.col("_o") == 0).alias("_own")).where("_own").select(frame, bin, F.transform("_s", lambda v: v["z"]).alias("snaps"))
    phi, ns = np.radians([angles[c] for c in order]), list(numbers)
    steering = np.exp(-1j * np.outer(ns, phi)) / math.sqrt(len(order))
    types = dict(near.dtypes)

    def run(batches):
        for b in batches:
            out = []
            for snaps in b.column(2).to_pylist():
                s = np.array(snaps)
                s = s[:, : len(order)] + 1j * s[:, len(order) :]
                values, u = np.linalg.eigh(s.T @ s.conj() / len(s))
                values, u = values[::-1], u[:, ::-1]
                a = np.abs(steering @ u[:, 0])
                music = 10 * np.log10(1 / np.clip(1 - np.square(np.abs(steering @ u[:, :n_src])).sum(1), 1e-10, None))
                total = float(values.sum())
                out.append((total / len(order), float(values[0]) / (total + 1e-30), ns[int(np.argmax(np.round(a, 12)))], a.tolist(), music.tolist()))
            power, coherence, n, a, music = zip(*out, strict=True) if out else ((),) * 5
            cols = [pa.array(power, pa.float64()), pa.array(coherence, pa.float64()), pa.array(n, pa.int32()), pa.array(a, pa.list_(pa.float64())), pa.array(music, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], [frame, bin, "power", "coherence", "n", "amplitudes", "music"])

    return near.mapInArrow(run, f"`{frame}` {types[frame]}, `{bin}` {types[bin]}, power double, coherence double, n int, amplitudes array<double>, music array<double>")

"""Example signals described by a table: tones that sweep and fade, pulses, and noise, made in the tasks.

Each row of a request is a signal: how many samples, at which rate, and what it is made of. Nothing is random but the noise, which follows from
the seed and the sample's number, so a signal is the same however it is partitioned, and one of any length spreads over the cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a signal that one row of the first step stands for.
CHUNK = 1 << 14
PARTS = ("amplitude", "frequency", "sweep", "centre", "width")


def _tones(keys: int):
    """Arrow batches of chunks (keys, noise, seed, rate, first, last, parts) to their samples, at most CHUNK rows a batch: the tones' sum."""

    def run(batches):
        for b in batches:
            rate, first, last = (b.column(keys + 2 + k).to_numpy(zero_copy_only=False) for k in range(3))
            parts = b.column(keys + 5)
            ends = np.cumsum(last - first + 1)
            at = 0
            while at < b.num_rows:  # chunks that fit together, one at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
                n = (last - first + 1)[at:to].astype(np.int64)
                row = np.repeat(np.arange(at, to), n)
                i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
                t, x = i / rate[row], np.zeros(len(row))
                held = parts.slice(at, to - at)
                flat, many = held.flatten(), pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
                unknown = pc.is_null(held).to_numpy(zero_copy_only=False)
                begin = np.cumsum(many) - many
                amplitude, frequency, sweep, centre, width = (np.append(flat.field(c).to_numpy(zero_copy_only=False).astype(float), np.nan) for c in PARTS)
                plain = np.append(pc.is_null(flat.field("width")).to_numpy(zero_copy_only=False), True)
                for k in range(int(many.max(initial=0))):
                    p = np.where(k < many, begin + k, len(flat))[row - at]
                    u = t - centre[p]
                    wave = amplitude[p] * np.sin(2 * math.pi * (frequency[p] * u + sweep[p] * u * u / 2))
                    wave = np.where(plain[p], wave, wave * np.exp(-0.5 * (u / width[p]) ** 2))
                    x += np.where(p < len(flat), wave, 0.0)
                x[unknown[row - at]] = np.nan
                own = [b.column(c).take(pa.array(row)) for c in range(keys + 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(i.astype(np.int64)), pa.array(t), pa.array(x, from_pandas=True)], [*b.schema.names[: keys + 2], "i", "t", "x"])
                at = to

    return run


def example_signals(requests: DataFrame, *keys: str) -> DataFrame:
    """keys, i, t, x. requests: keys, samples, rate, noise (deviation), seed, and parts: an array of structs amplitude, frequency, sweep, centre, width.

    A part's wave at times t is amplitude * sin(2 pi (frequency u + sweep u^2 / 2)), u = t - centre, under exp(-(u / width)^2 / 2); no envelope where width is null.
    """
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("samples") - 1) / CHUNK))).alias("_c")
    held = requests.where("samples > 0 AND rate > 0").select("*", chunk)
    first, last = F.col("_c") * CHUNK, F.least((F.col("_c") + 1) * CHUNK, F.col("samples").cast("long")) - 1
    sent = held.select(*keys, "noise", "seed", F.col("rate").cast("double").alias("rate"), first.alias("_first"), last.alias("_last"), "parts")
    types = ", ".join(f"`{c}` {t}" for c, t in sent.dtypes[: len(keys) + 2])
    each = sent.mapInArrow(_tones(len(keys)), types + ", i long, t double, x double")
    uniform = lambda k: (F.pmod(F.xxhash64("seed", "i", F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = F.when(F.col("noise") > 0, F.col("noise") * F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))).otherwise(0.0)
    return each.select(*keys, "i", "t", (F.col("x") + noise).alias("x"))

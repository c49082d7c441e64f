"""System identification of blocks: autoregressive models, their principal subspaces, and subspace poles.

A block (keys, block, x: array of samples, each an array of channels) is one row and is solved on its
own, so blocks spread over all tasks; what comes back are small arrays of eigenvalues and shares.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from .stats import ordered


def channel_blocks(df: DataFrame, size: int, stride: int, channels: int, *keys: str) -> DataFrame:
    """Full blocks of samples with all channels. df: keys, i, channel (0 to channels - 1), x; missing samples are 0."""
    wide = df.groupBy(*keys, "i").agg(*(F.sum(F.when(F.col("channel") == c, F.col("x")).otherwise(0.0)).alias(f"c{c}") for c in range(channels)))
    row = F.array(*(F.col(f"c{c}") for c in range(channels)))
    parts = frames.blocks(wide.select(*keys, "i", row.alias("x")), size, stride, *keys)
    x = F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"])
    return parts.groupBy(*keys, "block").agg(x.alias("x"))


def ar1(df: DataFrame, *keys: str) -> DataFrame:
    """Order-one model of each centred channel in closed form: coefficient and how much of the level it explains."""
    w = ordered(*keys)
    centred = df.withColumn("_c", F.col("x") - F.avg("x").over(Window.partitionBy(*keys))).withColumn("_p", F.lag("_c").over(w)).where("_p IS NOT NULL")
    g = centred.groupBy(*keys).agg(F.sum(F.col("_c") * F.col("_p")).alias("_a"), F.sum(F.col("_p") ** 2).alias("_b"), F.sum(F.col("_c") ** 2).alias("_y"))
    a = F.when(F.col("_b") > 0, F.col("_a") / F.col("_b")).otherwise(0.0)
    rest = F.greatest(F.col("_y") - a * F.col("_a"), F.lit(0.0)) / F.col("_y")
    return g.select(*keys, a.alias("coefficient"), F.when(F.col("_y") > 0, F.greatest(F.lit(0.0), 1 - F.sqrt(rest))).otherwise(0.0).alias("daf"))


def ar_model(y: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (channels x channels * order), innovation and data covariances of y (samples x channels)."""
    n, m = y.shape
    past = np.hstack([y[order - k - 1 : n - k - 1] for k in range(order)])
    now = y[order:]
    h = now.T @ past @ np.linalg.pinv(past.T @ past)
    rest = now - past @ h.T
    return h, rest.T @ rest / len(now), now.T @ now / len(now)


def companion(h: np.ndarray) -> np.ndarray:
    m, mp = h.shape
    a = np.zeros((mp, mp))
    a[:m] = h
    a[m:, :-m] = np.eye(mp - m)
    return a


def ssi_state(y: np.ndarray, rows: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """State and output matrices from the covariance of future and past block rows."""
    n, m = y.shape
    cols = n - 2 * rows + 1
    hankel = np.vstack([y[i : i + cols].T for i in range(2 * rows)]) / math.sqrt(cols)
    u, s, _ = np.linalg.svd(hankel[rows * m :] @ hankel[: rows * m].T)
    r = min(order, int((s > s[0] * 1e-12).sum()) if len(s) and s[0] > 0 else 0)
    if r == 0:
        return np.zeros((0, 0)), np.zeros((m, 0))
    obs = u[:, :r] * np.sqrt(s[:r])
    return np.linalg.pinv(obs[:-m]) @ obs[m:], obs[:m]


def _per_block(blocks: DataFrame, solve, schema: str, named: bool = False) -> DataFrame:
    """solve: array (and the block's keys, if named) -> list of tuples; one row each, with the block's keys. Blocks are given out one by one."""
    keys = [c for c in blocks.columns if c != "x"]
    types = dict(blocks.dtypes)

    def run(parts):
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                y = np.array([np.asarray(v, float) for v in r[len(keys)]])
                rows += [(*r[: len(keys)], *got) for got in (solve(y, *r[: len(keys)]) if named else solve(y))]
                if len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=[*keys, *names])
                    rows = []
            yield pd.DataFrame(rows, columns=[*keys, *names])

    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return blocks.select(*keys, "x").mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", " + schema)


def ar_assessment(blocks: DataFrame, order: int) -> DataFrame:
    """By block and channel: daf = max(0, 1 - sqrt(Re / Ry)) and participation = M |H column| / sum."""

    def solve(y):
        y = y / np.maximum(np.sqrt(np.square(y).mean(0)), 1e-12)
        h, re, ry = ar_model(y, order)
        m = y.shape[1]
        size = np.sqrt(sum(np.square(h[:, k * m : (k + 1) * m]).sum(0) for k in range(order)))
        daf = np.maximum(0, 1 - np.sqrt(np.maximum(np.diag(re), 0) / np.maximum(np.diag(ry), 1e-12)))
        return [(c, float(daf[c]), float(m * size[c] / max(size.sum(), 1e-12))) for c in range(m)]

    return _per_block(blocks, solve, "channel int, daf double, participation double")


def _poles(a: np.ndarray, fs: float) -> list[tuple[float, float]]:
    """Frequency and damping of the eigenvalues in the upper half plane."""
    z = np.linalg.eigvals(a) if a.size else np.zeros(0)
    z = z[(np.abs(z) > 1e-12) & (z.imag > 1e-14)]
    s = np.log(z.astype(complex)) * fs
    out = [(float(abs(v.imag) / (2 * math.pi)), float(-v.real / max(abs(v), 1e-300))) for v in s]
    return sorted(out)


def arpca_poles(blocks: DataFrame, order: int, reduced: int, fs: float) -> DataFrame:
    """Poles of the autoregressive model on the leading principal subspace of its prediction."""

    def solve(y):
        y = y - y.mean(0)
        h, _, _ = ar_model(y, order)
        n, m = y.shape
        past = np.hstack([y[order - k - 1 : n - k - 1] for k in range(order)])
        _, v = np.linalg.eigh(h @ (past.T @ past) @ h.T)
        top = v[:, ::-1][:, : min(reduced, m)]
        low, _, _ = ar_model(y @ top, order)
        return _poles(companion(low), fs)

    return _per_block(blocks, solve, "frequency double, damping double")


def ssi_poles(blocks: DataFrame, rows: int, order: int, fs: float) -> DataFrame:
    def solve(y):
        return _poles(ssi_state(y - y.mean(0), rows, order)[0], fs) if len(y) > 2 * rows else []

    return _per_block(blocks, solve, "frequency double, damping double")


def stable_poles(low: DataFrame, high: DataFrame, tolerance: float, *keys: str) -> DataFrame:
    """Poles of a lower order that a higher order confirms within a relative tolerance: an equi-join on log-frequency buckets."""
    width = math.log1p(tolerance)
    b = F.floor(F.log("frequency") / width)
    one = low.where("frequency > 0").withColumn("_b", b)
    two = high.where("frequency > 0").withColumn("_b", F.explode(F.array(b - 1, b, b + 1))).select(*keys, "_b", F.col("frequency").alias("other"))
    near = one.join(two, [*keys, "_b"]).where(F.abs(F.log(F.col("frequency") / F.col("other"))) <= width)
    best = F.min(F.abs(F.col("frequency") - F.col("other"))).alias("distance")
    return near.groupBy(*keys, "frequency", "damping").agg(best)


def in_range(poles: DataFrame, low: float, high: float, damping: float) -> DataFrame:
    return poles.where(F.col("frequency").between(low, high) & (F.col("damping") <= damping))


def _inverse_root(c: np.ndarray) -> np.ndarray:
    """The inverse square root of a covariance; directions without variance are left out."""
    w, v = np.linalg.eigh(c)
    keep = w > max(w.max(initial=0.0), 0.0) * 1e-12
    return (v[:, keep] / np.sqrt(w[keep])) @ v[:, keep].T


def canonical_state(y: np.ndarray, future: int, past: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """State, output and Kalman matrices, canonical correlations and innovation covariance of y (samples x channels).

    The states are the leading canonical directions of the past for predicting the future; A + K C carries the gain.
    """
    n, m = y.shape
    cols = n - past - future + 1
    before = np.stack([y[i : i + cols] for i in range(past)], 1).reshape(cols, -1)
    after = np.stack([y[past + i : past + i + cols] for i in range(future)], 1).reshape(cols, -1)
    root = _inverse_root(before.T @ before / cols)
    _, corr, v = np.linalg.svd(_inverse_root(after.T @ after / cols) @ (after.T @ before / cols) @ root, full_matrices=False)
    x = before @ (v[:order] @ root).T
    now = y[past : past + cols]
    c = now.T @ np.linalg.pinv(x.T)
    step = x[1:].T @ np.linalg.pinv(np.hstack((x[:-1], now[:-1])).T)
    rest = now - x @ c.T
    return step[:, :order] + step[:, order:] @ c, c, step[:, order:], corr, rest.T @ rest / cols


def canonical_poles(blocks: DataFrame, future: int, past: int, order: int, fs: float) -> DataFrame:
    """By block: frequency and damping of the poles of the canonical-correlation model, and its leading correlation."""

    def solve(y):
        if len(y) <= future + past:
            return []
        a, _, _, corr, _ = canonical_state(y - y.mean(0), future, past, order)
        return [(*p, float(corr[0])) for p in _poles(a, fs)]

    return _per_block(blocks, solve, "frequency double, damping double, correlation double")


def log_determinant(a: np.ndarray) -> float:
    """Of a symmetric matrix, by Cholesky factors where it is positive definite; -inf if it is singular."""
    try:
        return float(2 * np.log(np.diag(np.linalg.cholesky(a))).sum())
    except np.linalg.LinAlgError:
        return float(np.linalg.slogdet(a)[1])


def mahalanobis(y: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    z = y - mean
    return np.sqrt(np.maximum(0, (z * (z @ np.linalg.pinv(cov))).sum(1)))


def fold_covariances(blocks: DataFrame, folds: int) -> DataFrame:
    """By block and left-out fold of consecutive samples: trace and log determinant of the covariance of the rest, and the fold's
    mean Mahalanobis distance from it. The fold whose absence makes a criterion least holds the outliers."""

    def solve(y):
        n, out = len(y), []
        for k in range(folds):
            a, z = round(k * n / folds), round((k + 1) * n / folds)
            rest = np.concatenate((y[:a], y[z:]))
            if len(rest) <= y.shape[1] or a == z:
                continue
            mean = rest.mean(0)
            cov = (rest - mean).T @ (rest - mean) / len(rest)
            out.append((k, float(np.trace(cov)), log_determinant(cov), float(mahalanobis(y[a:z], mean, cov).mean())))
        return out

    return _per_block(blocks, solve, "fold int, trace double, logdet double, distance double")


def projected_poles(blocks: DataFrame, order: int, reduced: int, draws: int, fs: float, seed: int = 0) -> DataFrame:
    """Poles of autoregressive models of `draws` random orthonormal projections of each block onto `reduced` dimensions: draw, frequency, damping."""

    def solve(y):
        rng = np.random.default_rng(seed)
        out, y = [], y - y.mean(0)
        for k in range(draws):
            q, _ = np.linalg.qr(rng.normal(size=(y.shape[1], reduced)))
            if len(y) > order * (reduced + 1):
                out += [(k, *p) for p in _poles(companion(ar_model(y @ q, order)[0]), fs)]
        return out

    return _per_block(blocks, solve, "draw int, frequency double, damping double")


def component_spectra(blocks: DataFrame, components: int) -> DataFrame:
    """Power spectra of the leading principal components of each block: component, share of the variance, k, p."""

    def solve(y):
        u, s, _ = np.linalg.svd(y - y.mean(0), full_matrices=False)
        power = np.square(np.abs(np.fft.rfft(u[:, :components] * s[:components], axis=0)))
        share = np.square(s) / max(np.square(s).sum(), 1e-300)
        return [(c, float(share[c]), k, float(power[k, c])) for c in range(power.shape[1]) for k in range(len(power))]

    return _per_block(blocks, solve, "component int, share double, k int, p double")


def frequency_shapes(blocks: DataFrame, angles: list[float]) -> DataFrame:
    """Least-squares shape of each block at given angles a sample (radians): mode, channel, re (cosine), im (sine)."""

    def solve(y):
        t = np.arange(len(y))[:, None] * np.array(angles)[None]
        c = np.linalg.lstsq(np.hstack((np.cos(t), np.sin(t))), y, rcond=None)[0]
        return [(j, ch, float(c[j, ch]), float(c[len(angles) + j, ch])) for j in range(len(angles)) for ch in range(y.shape[1])]

    return _per_block(blocks, solve, "mode int, channel int, re double, im double")

"""Modes of blocks: filter diagonalisation in frequency bands, and modes that two model orders agree on, over random projections.

A block (keys, block, x: array of samples, each an array of channels) is one row and is solved on its own, so blocks
spread over all tasks. What comes back are short lists of modes: eigenvalue, how sure it is, and its shape over channels.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sysid import _per_block, canonical_state, ssi_state

#: Eigenvalues whose modulus is outside are no modes: they die within a sample or explode.
RADIUS = (0.5, 1.05)


def padded_dft(m: int, n: int, low: float = 0.0, high: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Angles 2 pi j / m (j / m from low to below high) and the rows exp(-i angle t), t < n, of a DFT padded from n to m samples."""
    if m < n:
        raise ValueError("a padded transform is no shorter than its signal")
    j = np.arange(m)
    angles = 2 * np.pi * j[(j / m >= low) & (j / m < high)] / m
    return angles, np.exp(-1j * np.outer(angles, np.arange(n)))


def filtered_poles(y: np.ndarray, size: int, low: float, high: float, alpha: float = -1.0) -> list[tuple[complex, float]]:
    """(eigenvalue, error) of the poles of y (samples x channels) from low to below high cycles a sample, surest first.

    `size` snapshots, each all channels over the other samples, are combined by the band's rows of a DFT: few
    columns hold what the band holds. The snapshots one sample later are the earlier ones times the poles, which makes a
    small generalised eigenproblem; alpha regularises it (negative: a millionth of the median eigenvalue).
    The error is what a pole's combination leaves unexplained, relative to it.
    """
    n = len(y)
    span = n - size
    if span < 2 or size < 2:
        return []
    held = np.lib.stride_tricks.sliding_window_view(y, span, axis=0).reshape(size + 1, -1)
    _, z = padded_dft(size, size, low, high)
    if not len(z):
        return []
    now, later = held[:-1].T @ z.T, held[1:].T @ z.T
    gram = now.conj().T @ now
    own = np.linalg.eigvalsh(gram)
    if own[-1] <= 0:
        return []
    ridge = max(alpha if alpha >= 0 else float(np.median(own)) * 1e-6, own[-1] * 1e-13)
    values, vectors = np.linalg.eig(np.linalg.solve(gram + ridge * np.eye(len(z)), now.conj().T @ later))
    found = []
    for value, v in zip(values, vectors.T, strict=True):
        if not RADIUS[0] <= abs(value) <= RADIUS[1] or not low <= np.angle(value) / (2 * np.pi) % 1 < high:
            continue
        part = now @ v
        found.append((complex(value), float(np.linalg.norm(later @ v - value * part) / (abs(value) * max(np.linalg.norm(part), 1e-300)))))
    return sorted(found, key=lambda p: (round(p[1], 12), np.angle(p[0])))


def shapes_at(y: np.ndarray, values: list[complex], damped: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares shapes (modes x channels, complex) of y at eigenvalues, and each mode's rms over channels; damped: with their decay, else steady."""
    base = np.array(values) if damped else np.exp(1j * np.angle(values))
    waves = base[None, :] ** np.arange(len(y))[:, None]
    got = np.linalg.lstsq(np.hstack((waves.real, -waves.imag)), y, rcond=None)[0]
    shapes = got[: len(base)] + 1j * got[len(base) :]
    return shapes, np.sqrt(np.square(np.abs(shapes)).sum(1) / y.shape[1])


def _damping(value: complex) -> float:
    s = np.log(complex(value))
    return float(-s.real / max(abs(s), 1e-300))


_FREQUENCY = lambda value, fs: float(np.angle(value) / (2 * np.pi) * fs)


def filter_diagonalised(blocks: DataFrame, size: int, bands: list[tuple[float, float]], fs: float = 1.0, keep: int = 8, error: float = 0.5, alpha: float = -1.0) -> DataFrame:
    """By block and band (in units of fs): the `keep` surest poles with an error of at most `error`, with their place in the list,
    frequency, damping, radius, error, confidence 1 / (1 + error), rms and shape (re, im by channel) fitted to the block together."""

    def solve(y):
        y, out = y - y.mean(0), []
        found = [(b, k, *p) for b, (low, high) in enumerate(bands) for k, p in enumerate([p for p in filtered_poles(y, size, low / fs, high / fs, alpha) if p[1] <= error][:keep])]
        if found:
            shapes, rms = shapes_at(y, [p[2] for p in found])
            out = [(b, k, _FREQUENCY(v, fs), _damping(v), abs(v), e, 1 / (1 + e), float(rms[i]), shapes[i].real.tolist(), shapes[i].imag.tolist()) for i, (b, k, v, e) in enumerate(found)]
        return out

    return _per_block(blocks, solve, "band int, place int, frequency double, damping double, radius double, error double, confidence double, rms double, re array<double>, im array<double>")


def confirmed_poles(blocks: DataFrame, sizes: tuple[int, int], bands: list[tuple[float, float]], fs: float = 1.0, most: int = 8, closeness: float = 0.95, confidence: float = 0.6) -> DataFrame:
    """Poles of filter diagonalisation with one number of snapshots that another number finds, too: of the `most` surest of each, those
    with both confidences above the least whose nearest is closer than 1 - closeness; frequency, damping, the other's frequency, distance, confidences."""
    if sizes[0] == sizes[1]:
        raise ValueError("two different numbers of snapshots")

    def solve(y):
        y, out = y - y.mean(0), []
        for b, (low, high) in enumerate(bands):
            one, two = ([(v, 1 / (1 + e)) for v, e in filtered_poles(y, d, low / fs, high / fs)[:most]] for d in sizes)
            for v, c in one:
                if not two or c <= confidence:
                    continue
                w, other = min(two, key=lambda p: abs(p[0] - v))
                if abs(w - v) < 1 - closeness and other > confidence:
                    out.append((b, _FREQUENCY(v, fs), _damping(v), _FREQUENCY(w, fs), float(abs(w - v)), c, other))
        return out

    return _per_block(blocks, solve, "band int, frequency double, damping double, other double, distance double, confidence double, other_confidence double")


def principal_state(y: np.ndarray, past: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """State and output matrices of the linear predictor on the leading principal components of the last `past` samples."""
    n = len(y)
    z = np.hstack([y[past - 1 - k : n - 1 - k] for k in range(past)])
    _, v = np.linalg.eigh(z.T @ z)
    x = z @ v[:, ::-1][:, : min(order, z.shape[1])]
    return np.linalg.lstsq(x[:-1], x[1:], rcond=None)[0].T, np.linalg.lstsq(x, y[past:], rcond=None)[0].T


def agreeing_modes(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], mac: float, closeness: float) -> list[tuple[complex, float, float]]:
    """(eigenvalue, MAC, closeness) of the modes of model one (state, output) in the upper half plane whose best shape match
    and nearest eigenvalue in model two are the same mode, both above their least. Closeness is 1 - |difference| / |eigenvalue|, 0 at least."""
    (a, c), (b, d) = one, two
    if not a.size or not b.size:
        return []
    lam, v = np.linalg.eig(a)
    mu, w = np.linalg.eig(b)
    p, q = c @ v, d @ w
    size = np.square(np.abs(p)).sum(0)[:, None] * np.square(np.abs(q)).sum(0)[None]
    match = np.square(np.abs(p.conj().T @ q)) / np.where(size > 0, size, 1)
    near = np.maximum(1 - np.abs(lam[:, None] - mu[None]) / np.maximum(np.abs(lam[:, None]), 1e-300), 0)
    # conjugate modes have conjugate shapes, which real shapes cannot tell apart: of equal matches the nearer one counts
    best = np.lexsort((near, np.round(match, 9)), axis=1)[:, -1] if len(mu) else []
    return [(complex(lam[i]), float(match[i, j]), float(near[i, j])) for i, j in enumerate(best) if lam[i].imag > 1e-12 and match[i, j] >= mac and near[i, j] >= closeness and j == near[i].argmax()]


def projection(channels: int, reduced: int, seed: int, *names) -> np.ndarray | None:
    """A random matrix (channels x |reduced|) of a block and draw: orthonormal columns if reduced is negative, Gaussian if positive, none at 0."""
    if abs(reduced) > channels:
        raise ValueError("a projection has no more dimensions than channels")
    if reduced == 0:
        return None
    g = np.random.default_rng([seed, zlib.crc32(repr(names).encode())]).normal(size=(channels, abs(reduced)))
    return np.linalg.qr(g)[0] if reduced < 0 else g


def projected_modes(blocks: DataFrame, orders: tuple[int, int], past: int, future: int = 0, kind: str = "principal", reduced: int = 0, draws: int = 1, mac: float = 0.9, closeness: float = 0.9, fs: float = 1.0, seed: int = 0) -> DataFrame:
    """Modes of each block that models of two orders agree on, for `draws` random projections of its channels.

    kind: principal (the linear predictor on principal components of the past), covariance or canonical (subspace identification
    from covariances or canonical correlations, with `future` block rows). Every block and draw has a projection of its own,
    which follows from the seed and the block's keys. Columns: draw, place (by frequency), frequency, radius, damping, mac, closeness, rms, re, im: shapes and
    rms are fitted to the unprojected block at the frequencies of the draw's modes together.
    """

    def model(x, order):
        if kind == "principal":
            return principal_state(x, past, order)
        return ssi_state(x, min(past, future), order) if kind == "covariance" else canonical_state(x, future, past, order)[:2]

    if kind not in ("principal", "covariance", "canonical"):
        raise ValueError(f"no such model: {kind}")

    def solve(y, *names):
        y, out = y - y.mean(0), []
        if len(y) <= past + future + 2:
            return out
        for draw in range(draws):
            p = projection(y.shape[1], reduced, seed, *names, draw)
            x = y if p is None else y @ p
            found = sorted(agreeing_modes(model(x, orders[0]), model(x, orders[1]), mac, closeness), key=lambda m: np.angle(m[0]))
            if found:
                shapes, rms = shapes_at(y, [m[0] for m in found], damped=False)
                out += [(draw, k, _FREQUENCY(v, fs), abs(v), _damping(v), m, c, float(rms[k]), shapes[k].real.tolist(), shapes[k].imag.tolist()) for k, (v, m, c) in enumerate(found)]
        return out

    return _per_block(blocks, solve, "draw int, place int, frequency double, radius double, damping double, mac double, closeness double, rms double, re array<double>, im array<double>", named=True)


def recurring(modes: DataFrame, tolerance: float, least: int, *keys: str) -> DataFrame:
    """Modes of which at least `least` draws of the block have one within a relative tolerance of the frequency: columns draws, nearest over them.

    An equi-join on log-frequency buckets. Modes of one list come out each for itself.
    """
    width = float(np.log1p(tolerance))
    b = F.floor(F.log("frequency") / width)
    one = modes.where("frequency > 0").withColumn("_b", b)
    two = modes.where("frequency > 0").select(*keys, F.explode(F.array(b - 1, b, b + 1)).alias("_b"), F.col("draw").alias("_d"), F.col("frequency").alias("_f"))
    near = one.join(two, [*keys, "_b"]).where(F.abs(F.log(F.col("frequency") / F.col("_f"))) <= width)
    of = near.groupBy(*keys, "draw", "place").agg(F.count_distinct("_d").alias("draws"), F.min(F.when(F.col("_d") != F.col("draw"), F.abs(F.col("frequency") - F.col("_f")))).alias("nearest"))
    return modes.join(of.where(F.col("draws") >= least), [*keys, "draw", "place"])


def harvested(modes: DataFrame, size: int, stride: int, fs: float, *others: str) -> DataFrame:
    """One row a mode with its block's centre: time_ms, radius, frequency, rms, re, im, and the other columns named."""
    centre = (F.col("block") * stride + (size - 1) / 2) / fs
    return modes.select(*others, "block", (1e3 * centre).alias("time_ms"), "radius", "frequency", "rms", "re", "im")


def robust_covariance(blocks: DataFrame, folds: int = 10, criterion: str = "logdet") -> DataFrame:
    """By block: the fold of consecutive samples whose absence makes the criterion least, and what follows without it.

    Criteria: logdet and trace of the others' covariance, or mahalanobis, the fold's mean distance from the others with its sign turned.
    Columns: fold, score, kept (samples), mean (by channel), covariance (row by row), distances (each kept and left-out sample from that mean).
    Folds without samples, and those that leave no more samples than channels, are no choice; of equals the first is taken.
    """
    if criterion not in ("logdet", "trace", "mahalanobis"):
        raise ValueError(f"no such criterion: {criterion}")
    from .sysid import log_determinant, mahalanobis

    def solve(y):
        n, best = len(y), None
        for k in range(folds):
            a, z = round(k * n / folds), round((k + 1) * n / folds)
            rest = np.concatenate((y[:a], y[z:]))
            if a == z or len(rest) <= y.shape[1]:
                continue
            mean = rest.mean(0)
            cov = (rest - mean).T @ (rest - mean) / len(rest)
            score = log_determinant(cov) if criterion == "logdet" else float(np.trace(cov)) if criterion == "trace" else -float(mahalanobis(y[a:z], mean, cov).mean())
            if best is None or score < best[1]:
                best = (k, score, len(rest), mean, cov)
        if best is None:
            return []
        return [(*best[:3], best[3].tolist(), best[4].ravel().tolist(), mahalanobis(y, best[3], best[4]).tolist())]

    return _per_block(blocks, solve, "fold int, score double, kept int, mean array<double>, covariance array<double>, distances array<double>")


def covariance_spectra(blocks: DataFrame, relative: float = 1e-5) -> DataFrame:
    """By block: the covariance's eigenvalues from the greatest down, and whether it is positive definite: the least above `relative` of the greatest."""

    def solve(y):
        z = y - y.mean(0)
        values = np.linalg.eigvalsh(z.T @ z / max(len(z), 1))[::-1]
        return [(values.tolist(), bool(values[-1] > relative * max(values[0], 0.0)))] if len(y) else []

    return _per_block(blocks, solve, "eigenvalues array<double>, definite boolean")


def innovations(y: np.ndarray, a: np.ndarray, c: np.ndarray, k: np.ndarray, skip: int) -> np.ndarray:
    """What one-step predictions of a state model with gain k leave of y, from sample `skip` on; the state starts at 0 there."""
    x, out = np.zeros(len(a)), np.zeros((max(len(y) - skip, 0), y.shape[1]))
    for i in range(len(out)):
        out[i] = y[skip + i] - c @ x
        x = a @ x + k @ out[i]
    return out


def residuals(blocks: DataFrame, future: int, past: int, order: int) -> DataFrame:
    """By block and channel: rms of the canonical model's one-step residuals, and their share of the data's rms."""

    def solve(y):
        if len(y) <= future + past:
            return []
        y = y - y.mean(0)
        a, c, k, _, _ = canonical_state(y, future, past, order)
        rest = np.sqrt(np.square(innovations(y, a, c, k, past)).mean(0))
        size = np.sqrt(np.square(y[past:]).mean(0))
        return [(ch, float(rest[ch]), float(rest[ch] / max(size[ch], 1e-300))) for ch in range(y.shape[1])]

    return _per_block(blocks, solve, "channel int, rms double, share double")


def autocorrelation_peaks(df: DataFrame, lags: int, share: float, most: int, fs: float = 1.0, *keys: str) -> DataFrame:
    """keys, lag, frequency (fs / lag), value: the `most` greatest peaks of each signal's autocorrelation up to a lag, of at least a share of that at lag 0.

    A peak is above both its neighbours. Samples (keys, i, x) meet the ones `lag` after them by an equi-join for all lags at once.
    """
    later = df.select(*keys, F.col("i"), F.col("x").alias("_y"))
    early = df.select(*keys, "x", F.posexplode(F.sequence(F.col("i"), F.col("i") + lags + 1)).alias("lag", "i"))
    acf = early.join(later, [*keys, "i"]).groupBy(*keys, "lag").agg(F.sum(F.col("x") * F.col("_y")).alias("value"))
    order = Window.partitionBy(*keys).orderBy("lag")
    near = acf.withColumns({"_b": F.lag("value").over(order), "_a": F.lead("value").over(order), "_0": F.first("value").over(order)})
    peaks = near.where((F.col("lag") > 0) & (F.col("lag") <= lags) & (F.col("value") > F.col("_b")) & (F.col("value") > F.col("_a")) & (F.col("value") >= share * F.col("_0")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "lag"))
    return peaks.withColumn("_r", rank).where(F.col("_r") <= most).select(*keys, "lag", (fs / F.col("lag")).alias("frequency"), "value")

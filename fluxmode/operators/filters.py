"""Filters of whole signals: one row a signal (key columns and an array x), worked on in Arrow batches.

A recursive filter is applied by its impulse response, cut where it has died away, so a signal costs
one FFT product. Signals are the unit of parallelism; long ones are framed first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def butterworth(order: int, kind: str, edges: float | tuple[float, float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections (b, a) of a digital Butterworth filter; kind low, high, band or stop, edges in shares of half the sample rate."""
    return _digital(np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)), 1.0, kind, edges)


def chebyshev(order: int, ripple: float, kind: str, edges: float | tuple[float, float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections of a digital Chebyshev filter of the first kind, whose pass band ripples by so many decibels."""
    loss = np.sqrt(10 ** (ripple / 10) - 1)
    width, angles = np.arcsinh(1 / loss) / order, np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    poles = -np.sinh(width) * np.sin(angles) + 1j * np.cosh(width) * np.cos(angles)
    # at frequency 0 an even order is at the foot of a ripple
    return _digital(poles, np.real(np.prod(-poles)) / (np.sqrt(1 + loss**2) if order % 2 == 0 else 1.0), kind, edges)


def _digital(poles: np.ndarray, level: float, kind: str, edges: float | tuple[float, float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections of the digital filter of an analogue prototype level / prod(s - poles)."""
    order = len(poles)
    warped = 4 * np.tan(np.pi * np.atleast_1d(np.asarray(edges, float)) / 2)
    zeros, gain = np.zeros(0), 1.0
    if kind == "low":
        poles, gain = poles * warped[0], warped[0] ** order
    elif kind == "high":
        poles, zeros, gain = warped[0] / poles, np.zeros(order), np.real(1 / np.prod(-poles))
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2 if kind == "band" else width / 2 / poles
        gain = width**order if kind == "band" else np.real(1 / np.prod(-poles))
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles = np.concatenate((half + root, half - root))
        zeros = np.zeros(order) if kind == "band" else np.concatenate((np.full(order, 1j * centre), np.full(order, -1j * centre)))
    gain = level * gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    digital, roots = (4 + poles) / (4 - poles), np.concatenate(((4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))))
    # conjugate poles share a section, and so do zeros
    upper = [p for p in digital if p.imag > 1e-12]
    real = sorted((p.real for p in digital if abs(p.imag) <= 1e-12), key=abs)
    pairs = [(p, p.conjugate()) for p in upper] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    left = sorted(roots, key=lambda z: (round(z.real, 9), round(abs(z.imag), 9)))
    if any(abs(z.imag) > 1e-12 for z in left):
        left = [z for pair in zip([z for z in left if z.imag > 0], [z for z in left if z.imag < 0], strict=True) for z in pair]
    else:
        left = [z for pair in zip(left, left[::-1], strict=True) for z in pair][: len(left)]
    out = []
    for pair in pairs:
        own, left = left[: len(pair)], left[len(pair) :]
        out.append((np.real(np.poly(own)), np.real(np.poly(pair))))
    out[0] = (out[0][0] * gain, out[0][1])
    return out


def impulse_response(sections: list[tuple[np.ndarray, np.ndarray]], tail: float = 1e-12, longest: int = 1 << 20) -> np.ndarray:
    """The response to one 1, cut where the slowest pole has died away to tail."""
    slow = max(abs(np.roots(a)).max(initial=0.0) for _, a in sections)
    n = int(min(longest, 64 + (0 if slow <= 0 else 2 * np.log(tail) / np.log(min(slow, 1 - 1e-9)))))
    h = np.zeros(n)
    h[0] = 1.0
    for b, a in sections:
        y, b = np.zeros(n), np.pad(b, (0, 3 - len(b)))
        a = np.pad(a, (0, 3 - len(a)))
        y1 = y2 = x1 = x2 = 0.0
        for i, x in enumerate(h):
            now = b[0] * x + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
            y[i], x2, x1, y2, y1 = now, x1, x, y1, now
        h = y
    return h


def _product(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = 1 << int(len(x) + len(h) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]


def _settled(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Filtered as if the first value had held for ever before."""
    return _product(x - x[0], h) + x[0] * h.sum()


def both_ways(x: np.ndarray, h: np.ndarray, pad: int) -> np.ndarray:
    """Forward and backward over x, lengthened by its odd reflection at both ends."""
    pad = min(pad, len(x) - 1)
    if pad > 0:
        x = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    y = _settled(_settled(x, h)[::-1], h)[::-1]
    return y[pad : len(y) - pad] if pad > 0 else y


def _mapped(df: DataFrame, f) -> DataFrame:
    """df with its last column, the array x, replaced by f(x); null and empty arrays stay."""

    def run(batches):
        for b in batches:
            x = [None if v is None else f(np.array(v, float)) if len(v) else np.zeros(0) for v in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*b.schema.names[:-1], "y"])

    types = ", ".join(f"`{c}` {t}" for c, t in df.dtypes[:-1])
    return df.mapInArrow(run, types + ", y array<double>")


def filtered(signals: DataFrame, kind: str, edges: float | tuple[float, float], order: int = 2, causal: bool = False, *, keys: tuple[str, ...]) -> DataFrame:
    """keys, y: each signal through a Butterworth filter, by default forward and backward. signals: keys, x (array)."""
    sections = butterworth(order, kind, edges)
    h = impulse_response(sections)
    pad = 3 * (2 * len(sections) + 1)
    return _mapped(signals.select(*keys, "x"), lambda x: _product(x, h) if causal else both_ways(x, h, pad))


def decimated(signals: DataFrame, factor: int, order: int = 8, ripple: float = 0.05, share: float = 0.8, *, keys: tuple[str, ...]) -> DataFrame:
    """keys, y: every factor-th sample of each signal behind a Chebyshev low pass at a share of the new Nyquist frequency, forward and backward."""
    sections = chebyshev(order, ripple, "low", share / factor)
    h, pad = impulse_response(sections), 3 * (2 * len(sections) + 1)
    return _mapped(signals.select(*keys, "x"), lambda x: both_ways(x, h, pad)[::factor])


def envelopes(signals: DataFrame, edges: tuple[float, float], order: int = 4, kind: str = "absolute", *, keys: tuple[str, ...]) -> DataFrame:
    """keys, y: amplitude of each signal within a band (shares of half the sample rate, the upper one 0.99 at most).

    kind: absolute, the size of the filtered signal, or analytic, that of its analytic signal. A band that is empty or begins at 0 leaves the signal's own size.
    """
    low, high = edges[0], min(edges[1], 0.99)
    whole = low >= high or low <= 0
    sections = [] if whole else butterworth(order, "band", (low, high))
    h, pad = None if whole else impulse_response(sections), 3 * (2 * len(sections) + 1)

    def of(x):
        y = x if whole else both_ways(x, h, pad)
        if kind == "analytic":
            n = len(y)
            once = np.zeros(n)
            once[0], once[1 : (n + 1) // 2] = 1, 2
            if n % 2 == 0:
                once[n // 2] = 1
            y = np.fft.ifft(np.fft.fft(y) * once)
        return np.abs(y)

    return _mapped(signals.select(*keys, "x"), of)


def baseline(x: np.ndarray, weight: float, rounds: int = 50, ratio: float = 1e-3) -> np.ndarray:
    """Smooth line under the peaks of x: asymmetrically reweighted penalised least squares, five-band solve."""
    n = len(x)
    if n < 3:
        return x.copy()
    # bands of weight * D'D with D the second difference
    d = np.zeros((3, n))
    for k, c in enumerate((1.0, -2.0, 1.0)):
        for m, e in enumerate((1.0, -2.0, 1.0)):
            if m >= k:
                d[m - k, k : k + n - 2] += c * e
    w, d = np.ones(n), weight * d
    for _ in range(rounds):
        z = _five_band(d[0] + w, d[1], d[2], w * x)
        rest = x - z
        low = rest[rest < 0]
        if len(low) < 2 or low.std() == 0:
            break
        new = 1 / (1 + np.exp(np.clip(2 * (rest - (2 * low.std() - low.mean())) / low.std(), -500, 500)))
        if np.linalg.norm(w - new) / np.linalg.norm(w) < ratio:
            break
        w = new
    return z


def _five_band(main: np.ndarray, one: np.ndarray, two: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves a symmetric system of five bands; one[i], two[i] couple i with i + 1, i + 2."""
    n = len(main)
    d, e, g, z = main.tolist(), [0.0] * n, [0.0] * n, right.tolist()
    for i in range(n):
        if i > 0:
            d[i] -= e[i - 1] ** 2 * d[i - 1]
            z[i] -= e[i - 1] * z[i - 1]
        if i > 1:
            d[i] -= g[i - 2] ** 2 * d[i - 2]
            z[i] -= g[i - 2] * z[i - 2]
        e[i] = (one[i] - (e[i - 1] * d[i - 1] * g[i - 1] if i > 0 else 0.0)) / d[i]
        g[i] = two[i] / d[i]
    for i in range(n - 1, -1, -1):
        z[i] = z[i] / d[i] - (e[i] * z[i + 1] if i + 1 < n else 0.0) - (g[i] * z[i + 2] if i + 2 < n else 0.0)
    return np.array(z)


def baselines(signals: DataFrame, weight: float, *, keys: tuple[str, ...]) -> DataFrame:
    """keys, y: the baseline of each signal (a column of a spectrogram, say)."""
    return _mapped(signals.select(*keys, "x"), lambda x: baseline(x, weight))

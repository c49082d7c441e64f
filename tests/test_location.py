"""Traces, mode location, probe amplitudes and decimation against numpy."""

import math
import os

import numpy as np
import pytest

from fluxmode.operators import filters, frames, location, modes
from test_registered import SF, grid, run, through  # noqa: F401  grid is a fixture

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
RNG = np.random.default_rng(9)


def reflected(sections, x, pad=27):
    """Forward and backward by the difference equations, over the odd reflection."""
    x = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    return through(sections, through(sections, x)[::-1])[::-1][pad:-pad]


def response(sections, f):
    z = np.exp(-1j * np.pi * f)
    return np.prod([np.polyval(b[::-1], z) / np.polyval(a[::-1], z) for b, a in sections])


@pytest.mark.parametrize("order,ripple", [(8, 0.05), (5, 1.0), (1, 0.5), (4, 3.0)])
def test_chebyshev_ripples_and_falls(order, ripple):
    s = filters.chebyshev(order, ripple, "low", 0.2)
    inside = [abs(response(s, f)) for f in np.linspace(0, 0.2, 400)]
    low = 10 ** (-ripple / 20)
    assert max(inside) < 1 + 1e-9 and abs(min(inside) - low) < 1e-6 and abs(abs(response(s, 0.2)) - low) < 1e-9
    assert abs(abs(response(s, 0)) - (low if order % 2 == 0 else 1)) < 1e-9
    # the known size of its response: 1 / sqrt(1 + loss^2 T_n^2)
    loss = math.sqrt(10 ** (ripple / 10) - 1)
    for f in (0.25, 0.4, 0.8):
        w = math.tan(math.pi * f / 2) / math.tan(math.pi * 0.2 / 2)
        assert abs(abs(response(s, f)) - 1 / math.sqrt(1 + (loss * math.cosh(order * math.acosh(w))) ** 2)) < 1e-9
    b = filters.chebyshev(order, ripple, "band", (0.2, 0.4))
    assert abs(abs(response(b, 0.2)) - low) < 1e-6 and abs(abs(response(b, 0.4)) - low) < 1e-6 and abs(response(b, 0.0)) < 1e-9


@needs_tables
def test_decimate_iir(spark, grid):  # noqa: F811
    got = {}
    for r in run(spark, "decimate_iir"):
        got.setdefault(r["f"], {})[r["m"]] = r["y"]
    sections = filters.chebyshev(8, 0.05, "low", 0.2)
    for f, row in enumerate(grid):
        assert np.allclose([got[f][m] for m in range(180)], reflected(sections, row)[::4], atol=1e-6 * max(1, np.abs(row).max()))


@needs_tables
def test_mode_location(spark, grid):  # noqa: F811
    got = {r["channel"]: r for r in run(spark, "mode_location")}
    sections, want = filters.butterworth(4, "band", (0.06, 0.14)), {}
    for f, row in enumerate(grid):
        x = row + 1.0
        level = np.median(x)
        y = reflected(sections, x - level)[100:601]
        want[f] = math.sqrt((y**2).mean()) / level
        assert abs(got[f]["metric"] - want[f]) < 1e-6 * max(1, want[f]) and abs(got[f]["rho"] - abs(1.2 + 0.05 * f - 1.5) / 0.5) < 1e-12
    assert [f for f, r in got.items() if r["peak"]] == [max(want, key=want.get)]


def profile(spark, amplitudes, phase=0.0, n=2000):
    t = np.arange(n) / 1000.0
    x = [1.0 + a * np.sin(2 * np.pi * 50 * t + phase * c) + 0.02 * RNG.normal(size=n) for c, a in enumerate(amplitudes)]
    rows = [(c, i, float(t[i]), float(x[c][i])) for c in range(len(amplitudes)) for i in range(n)]
    return spark.createDataFrame(rows, "channel int, i long, t double, x double"), t


def test_location_finds_the_planted_channel(spark):
    samples, t = profile(spark, [0.02, 0.1, 0.4, 0.2])
    places = spark.createDataFrame([(c, 1.5 + 0.1 * c) for c in range(4)], "channel int, place double")
    got = {r["channel"]: r for r in location.located(location.by_amplitude(samples, 40.0, 60.0, (0.5, 1.5), 1000.0), places, 1.6, 0.5).collect()}
    assert got[2]["peak"] and sum(r["peak"] for r in got.values()) == 1 and abs(got[2]["metric"] - 0.4 / math.sqrt(2)) < 0.02 and abs(got[2]["rho"] - 0.2) < 1e-9
    # a strong channel that does not follow the reference loses against a weak one that does
    other = samples.withColumn("x", samples["x"] + (samples["channel"] == 0).cast("int") * 3.0 * (samples["i"] % 7 == 3).cast("int"))
    s = np.arange(0, 2.0, 0.0017)
    ref = spark.createDataFrame([(float(a), float(np.sin(2 * np.pi * 50 * a))) for a in s], "t double, x double")
    found = {r["channel"]: r for r in location.located(location.by_coherence(other, ref, 45.0, 55.0, (0.5, 1.5), 1000.0, location.segment_of(1001), 0.25), places).collect()}
    assert found[2]["metric"] > 0.95 and found[0]["metric"] < found[1]["metric"] and found[2]["rho"] is None
    assert all(r["metric"] == 0 for r in location.by_coherence(samples, ref, 45.0, 55.0, (0.5, 1.5), 1000.0, 250, 0.25, least=5.0).collect())
    assert [location.segment_of(n) for n in (10, 400, 5000)] == [16, 100, 256]


def test_interpolated_equals_numpy(spark):
    s = np.sort(RNG.uniform(0, 100, 60))
    y = RNG.normal(size=60)
    p = np.concatenate((RNG.uniform(-20, 120, 200), s[:5]))
    got = frames.interpolated(spark.createDataFrame([(1, float(a)) for a in p], "k int, t0 double"), spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(s, y, strict=True)], "k int, t double, x double"), 3.0, "k").collect()
    assert np.allclose([r["x"] for r in sorted(got, key=lambda r: r["t0"])], np.interp(np.sort(p), s, y))


@pytest.mark.parametrize("kind", ["absolute", "analytic"])
def test_probe_amplitude(spark, kind):
    n, rows, env = {0: 300, 1: 280, 2: 5, 3: 300}, [], []
    sections = filters.butterworth(4, "band", (0.1, 0.4))
    for p, m in n.items():
        x = RNG.normal(size=m)
        rows += [(p, i / 10.0 + p * 1e-3, float(v)) for i, v in enumerate(x)]
        if m > 10:
            y = reflected(sections, x)
            if kind == "analytic":
                h = np.zeros(m)
                h[0], h[1 : (m + 1) // 2] = 1, 2
                h[m // 2] = 1 if m % 2 == 0 else h[m // 2]
                y = np.fft.ifft(np.fft.fft(y) * h)
            env.append(np.abs(y)[:280])
    got = sorted(location.probe_amplitude(spark.createDataFrame(rows, "probe int, t double, x double"), (-1.0, 100.0), (0.1, 0.4), kind=kind).collect())
    assert len(got) == 280 and all(r["probes"] == 3 and abs(r["t"] - r["k"] / 10) < 1e-9 for r in got)
    assert np.allclose([r["amplitude"] for r in got], np.sqrt((np.array(env) ** 2).mean(0)), atol=1e-6)


def test_envelope_of_a_degenerate_band(spark):
    x = spark.createDataFrame([(0, [1.0, -2.0, 3.0])], "k int, x array<double>")
    assert filters.envelopes(x, (0.0, 0.5), keys=("k",)).first()["y"] == [1.0, 2.0, 3.0]


@needs_tables
def test_registered_probe_amplitude(spark, grid):  # noqa: F811
    got = sorted(run(spark, "probe_amplitude"), key=lambda r: r["k"])
    sections = filters.butterworth(4, "band", (0.1, 0.4))
    env = np.abs([reflected(sections, row[50:651] + 1.0) for row in grid])
    assert np.allclose([r["amplitude"] for r in got], np.sqrt((env**2).mean(0)), rtol=1e-6) and [r["t"] for r in got] == list(range(50, 651))


def test_prototype_traces_windows(spark):
    t = np.arange(0, 2, 0.001)
    samples = spark.createDataFrame([(float(a), [float(np.sin(a)), float(a)]) for a in t], "t double, x array<double>")
    refs = [(1, 0.5, 100.0, [1.0, 0.0], [0.0, 1.0]), (2, 1.0, 10.0, [0.0, 2.0], [0.0, 0.0]), (3, 1.95, 0.0, [1.0, 1.0], [0.0, 0.0]), (4, 9.0, 5.0, [1.0, 1.0], [0.0, 0.0]), (5, 0.5, 5.0, [1.0], [0.0])]
    got = {}
    for r in modes.prototype_traces(spark.createDataFrame(refs, "reference int, time double, frequency double, re array<double>, im array<double>"), samples, 0.1).collect():
        got.setdefault(r["reference"], []).append((r["time"], r["signal"]))
    for k, c, f, re, _ in refs:
        w = min(5 / f, 0.1) if f > 0 else 0.05
        held = t[np.abs(t - c) <= w / 2] if len(re) == 2 else []
        assert len(got.get(k, [])) == len(held)
        if len(held):
            assert np.allclose(sorted(got[k]), [(a - c, np.sin(a) * re[0] + a * re[1]) for a in held])

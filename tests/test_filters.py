"""Filters, baselines, scorers and small window operators against plain recurrences and dense solves."""

import numpy as np
import pytest

from fluxmode.operators import filters, frames, grids, metrics, scoring


def recurrence(x, sections):
    for b, a in sections:
        y = np.zeros(len(x))
        for i in range(len(x)):
            y[i] = sum(b[j] * x[i - j] for j in range(len(b)) if i >= j) - sum(a[j] * y[i - j] for j in range(1, len(a)) if i >= j)
        x = y
    return x


@pytest.mark.parametrize("kind,edges", [("low", 0.2), ("high", 0.3), ("band", (0.1, 0.3)), ("stop", (0.1, 0.3))])
@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_butterworth(kind, edges, order):
    sections = filters.butterworth(order, kind, edges)

    def gain(share):
        z = np.exp(1j * np.pi * share)
        return abs(np.prod([np.polyval(b, z) / np.polyval(a, z) * z ** (len(a) - len(b)) for b, a in sections]))

    for edge in np.atleast_1d(edges):  # half the power at each edge
        assert gain(edge) == pytest.approx(0.5**0.5, abs=1e-6)
    assert gain(0.0) == pytest.approx({"low": 1, "high": 0, "band": 0, "stop": 1}[kind], abs=1e-6)
    assert gain(1.0) == pytest.approx({"low": 0, "high": 1, "band": 0, "stop": 1}[kind], abs=1e-6)
    x = np.random.default_rng(1).normal(size=400)
    assert np.allclose(filters._product(x, filters.impulse_response(sections)), recurrence(x, sections), atol=1e-9)


def test_both_ways_keeps_phase_and_constants():
    h = filters.impulse_response(filters.butterworth(2, "low", 0.2))
    assert np.allclose(filters.both_ways(np.full(100, 3.0), h, 9), 3.0)
    t = np.arange(2000)
    slow = np.sin(2 * np.pi * t / 400)
    assert np.abs(filters.both_ways(slow + np.sin(2 * np.pi * t / 3), h, 9) - slow)[50:-50].max() < 0.02
    assert len(filters.both_ways(np.array([1.0]), h, 9)) == 1


def test_filtered_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, []), (3, None)], "k int, x array<double>")
    got = {r["k"]: r["y"] for r in filters.filtered(df, "low", 0.5, 1, keys=("k",)).collect()}
    assert len(got[1]) == 4 and got[2] == [] and got[3] is None


def test_five_band_solve_and_baseline():
    rng = np.random.default_rng(3)
    n, weight = 60, 50.0
    w, d = rng.random(n) + 0.1, np.diff(np.eye(n), 2, axis=0)
    full = np.diag(w) + weight * d.T @ d
    x = rng.normal(size=n)
    one, two = np.append(np.diag(full, 1), 0), np.append(np.diag(full, 2), [0, 0])
    assert np.allclose(filters._five_band(np.diag(full).copy(), one, two, x), np.linalg.solve(full, x))
    line, peaks = np.linspace(1, 2, 200), np.zeros(200)
    peaks[[40, 90, 150]] = 30
    noise = rng.normal(0, 0.05, 200)
    assert np.abs(filters.baseline(line + noise + peaks, 1e5) - line).max() < 0.15
    assert filters.baseline(np.array([5.0, 6.0]), 1.0).tolist() == [5.0, 6.0]


def test_scorer_isolates_failures(spark):
    def make(model):
        def score(x):
            if x[0] < 0:
                raise ValueError("negative")
            return x * model["gain"]

        return score

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [-1.0]), (3, None)], "k int, x array<double>")
    got = {r["k"]: (r["y"], r["error"]) for r in scoring.scored(df, make, {"gain": 2.0}, keys=("k",)).collect()}
    assert got == {1: ([2.0, 4.0], None), 2: (None, "ValueError: negative"), 3: (None, None)}


def test_blur_keeps_mass(spark):
    rows = [(0, t, float(t == 5)) for t in range(20)] + [(1, t, 4.0) for t in range(20)]
    got = {(r["f"], r["t"]): r["v"] for r in grids.blurred(spark.createDataFrame(rows, "f int, t int, v double"), 1.0).collect()}
    assert len(got) == 40 and sum(got[0, t] for t in range(20)) == pytest.approx(1.0)
    assert all(got[1, t] == pytest.approx(4.0) for t in range(20))
    assert got[0, 4] == pytest.approx(got[0, 6])


def test_crossings(spark):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate([0.0, 2.0, 2.0, 0.0, 1.0, 3.0])], "k int, i int, x double")
    assert frames.crossings(df, 1.0, "k").first()["at"] == pytest.approx(0.5)
    assert frames.crossings(df, 1.0, "k", last=True).first()["at"] == pytest.approx(4.0)
    assert frames.crossings(df, 1.0, "k", least=1.0).first()["at"] == pytest.approx(2.5)
    assert frames.crossings(df, 9.0, "k").count() == 0


def test_coverage_counts_faults(spark):
    samples = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    got = metrics.coverage(spark.createDataFrame([(1,), (1,), (2,)], "id int"), samples, "id").first()
    assert (got["n"], got["missing"], got["repeated"]) == (3, 1, 1)

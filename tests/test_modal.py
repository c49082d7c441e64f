"""Modes of planted signals, and the registered results of modal queries against numpy over the same rows."""

import math
import os

import numpy as np
import pytest

from fluxmode import registry
from fluxmode.operators import modal
from fluxmode.plans import modal_queries

from test_registered import SF, blocks, close, run  # noqa: F401  blocks is a fixture

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
T = np.arange(240)
RNG = np.random.default_rng(5)


def planted(values, shapes, noise=0.0, n=240):
    """samples x channels of decaying waves with complex shapes."""
    t = np.arange(n)
    y = sum(np.real(np.array(s)[None] * (v**t)[:, None]) for v, s in zip(values, shapes, strict=True))
    return y + noise * RNG.normal(size=y.shape)


def as_blocks(spark, arrays):
    return spark.createDataFrame([(0, b, y.tolist()) for b, y in enumerate(arrays)], "input int, block long, x array<array<double>>")


PAIR = [np.exp(2j * np.pi * 0.1 - 0.01), np.exp(2j * np.pi * 0.112 - 0.02)]
SHAPES = [[1, 1j, -1, 0.5], [0.4, 0.7 - 0.2j, 0.3j, -0.6]]


def test_filter_diagonalisation_finds_a_damped_pair(spark):
    y = planted(PAIR, SHAPES, 1e-6)
    got = [r.asDict() for r in modal.filter_diagonalised(as_blocks(spark, [y]), 100, [(0.05, 0.16), (0.2, 0.4)], error=1e-3).collect()]
    found = sorted((r["frequency"], r["radius"]) for r in got if r["band"] == 0)
    assert len(found) == 2 and not [r for r in got if r["band"] == 1]
    for (f, radius), v in zip(found, PAIR, strict=True):
        assert abs(f - np.angle(v) / (2 * np.pi)) < 1e-5 and abs(radius - abs(v)) < 1e-4
    for r in got:
        want = np.array(SHAPES[0 if r["frequency"] < 0.106 else 1])
        assert np.abs(np.array(r["re"]) + 1j * np.array(r["im"]) - want).max() < 1e-3
        assert close(r["rms"], math.sqrt((np.abs(want) ** 2).sum() / 4), 1e-3) and r["confidence"] > 0.99


def test_filter_diagonalisation_in_noise(spark):
    y = planted(PAIR[:1], SHAPES[:1], 0.02)
    got = modal.filter_diagonalised(as_blocks(spark, [y]), 100, [(0.05, 0.2)], fs=1000.0 / 5, error=1.0, keep=1)
    assert got.count() == 0  # the band is in units of fs
    r = modal.filter_diagonalised(as_blocks(spark, [y]), 100, [(10.0, 40.0)], fs=200.0, error=1.0, keep=1).first()
    assert abs(r["frequency"] - 20.0) < 0.2 and abs(r["radius"] - math.exp(-0.01)) < 1e-2


def test_confirmed_poles(spark):
    y = planted(PAIR, SHAPES, 1e-5)
    got = modal.confirmed_poles(as_blocks(spark, [y, RNG.normal(size=(240, 4)), np.zeros((240, 4)), y[:20]]), (100, 80), [(0.05, 0.16)], closeness=0.999, confidence=0.98).collect()
    assert [r["block"] for r in got] == [0, 0] and all(r["distance"] < 1e-3 for r in got)
    assert np.allclose(sorted(r["frequency"] for r in got), [0.1, 0.112], atol=1e-4)
    with pytest.raises(ValueError):
        modal.confirmed_poles(as_blocks(spark, [y]), (80, 80), [(0.0, 0.5)])


def test_padded_dft():
    angles, rows = modal.padded_dft(64, 40)
    x = RNG.normal(size=40)
    assert np.allclose(rows @ x, np.fft.fft(x, 64)) and np.allclose(angles, 2 * np.pi * np.arange(64) / 64)
    assert len(modal.padded_dft(64, 40, 0.25, 0.5)[0]) == 16
    with pytest.raises(ValueError):
        modal.padded_dft(39, 40)


@pytest.mark.parametrize("kind,reduced", [("principal", -3), ("covariance", 3), ("canonical", 0), ("covariance", -2)])
def test_projected_modes_find_planted_ones(spark, kind, reduced):
    values = [np.exp(2j * np.pi * 0.07 - 0.001), np.exp(2j * np.pi * 0.21 - 0.001)]
    y = planted(values, SHAPES, 0.01)
    got = modal.projected_modes(as_blocks(spark, [y, y]), (6, 8), past=10, future=10, kind=kind, reduced=reduced, draws=2, mac=0.95, closeness=0.95).collect()
    by = {}
    for r in got:
        by.setdefault((r["block"], r["draw"]), []).append(r)
    assert len(by) == 4
    for rows in by.values():
        near = [min(rows, key=lambda r: abs(r["frequency"] - f)) for f in (0.07, 0.21)]
        assert all(abs(r["frequency"] - f) < 2e-3 and abs(r["radius"] - math.exp(-0.001)) < 0.02 for r, f in zip(near, (0.07, 0.21), strict=True))
        for r, shape in zip(near, SHAPES, strict=True):
            z = np.array(r["re"]) + 1j * np.array(r["im"])
            assert abs(np.vdot(z, shape)) ** 2 / (np.vdot(z, z).real * np.vdot(shape, shape).real) > 0.98


def test_projections_follow_from_block_and_seed():
    a = modal.projection(6, -3, 1, 0, 5, 0)
    assert np.allclose(a.T @ a, np.eye(3)) and np.array_equal(a, modal.projection(6, -3, 1, 0, 5, 0))
    assert not np.allclose(a, modal.projection(6, -3, 1, 0, 6, 0)) and not np.allclose(a, modal.projection(6, -3, 2, 0, 5, 0))
    assert modal.projection(6, 0, 1) is None and modal.projection(6, 2, 1).shape == (6, 2)
    with pytest.raises(ValueError):
        modal.projection(2, 3, 0)


def test_agreeing_modes_need_both_criteria():
    def model(values, shapes):
        a = np.zeros((2 * len(values), 2 * len(values)))
        c = np.zeros((len(shapes[0]), 2 * len(values)))
        for k, (v, s) in enumerate(zip(values, shapes, strict=True)):
            a[2 * k : 2 * k + 2, 2 * k : 2 * k + 2] = [[v.real, v.imag], [-v.imag, v.real]]
            c[:, 2 * k], c[:, 2 * k + 1] = np.real(s), np.imag(s)
        return a, c

    one = model(PAIR, SHAPES)
    assert len(modal.agreeing_modes(one, one, 0.99, 0.99)) == 2
    swapped = model(PAIR, SHAPES[::-1])
    assert modal.agreeing_modes(one, swapped, 0.5, 0.99) == []  # the best shape and the nearest eigenvalue are different modes
    moved = model([PAIR[0] * 1.002, PAIR[1] * np.exp(0.5j)], SHAPES)
    got = modal.agreeing_modes(one, moved, 0.9, 0.99)
    assert len(got) == 1 and close(abs(got[0][0] - PAIR[0]), 0, 1e-9) and close(got[0][2], 1 - 0.002, 1e-6)


def test_recurring_and_harvested(spark):
    rows = [(0, 3, d, k, f, 0.9, 1.0, [1.0], [0.0]) for d, k, f in [(0, 0, 10.0), (0, 1, 50.0), (1, 0, 10.2), (2, 0, 9.9), (2, 1, 80.0), (1, 1, 51.0)]]
    df = spark.createDataFrame(rows, "input int, block long, draw int, place int, frequency double, radius double, rms double, re array<double>, im array<double>")
    got = modal.recurring(df, 0.05, 2, "input", "block").collect()
    assert sorted((r["frequency"], r["draws"], round(r["nearest"], 6)) for r in got) == [(9.9, 3, 0.1), (10.0, 3, 0.1), (10.2, 3, 0.2), (50.0, 2, 1.0), (51.0, 2, 1.0)]
    assert modal.harvested(df, 240, 120, 1000.0).first()["time_ms"] == (360 + 119.5)


@needs_tables
@pytest.mark.parametrize("criterion", ["logdet", "trace", "mahalanobis"])
def test_robust_covariance(spark, blocks, criterion):  # noqa: F811
    from fluxmode.plans.grid_queries import _sensors

    got = {r["block"]: r for r in modal.robust_covariance(_sensors(spark, SF), 5, criterion).collect()}
    assert set(got) == set(blocks)
    for b, y in blocks.items():
        options = []
        for k in range(5):
            a, z = round(k * len(y) / 5), round((k + 1) * len(y) / 5)
            rest = np.delete(y, np.s_[a:z], 0)
            if len(rest) <= 6 or a == z:
                continue
            cov = np.cov(rest.T, bias=True)
            away = lambda x: np.sqrt(np.einsum("ij,jk,ik->i", x - rest.mean(0), np.linalg.pinv(cov), x - rest.mean(0)))  # noqa: B023, E731
            options.append(({"logdet": lambda: np.linalg.slogdet(cov)[1], "trace": lambda: np.trace(cov), "mahalanobis": lambda: -away(y[a:z]).mean()}[criterion](), k, rest, cov, away(y)))  # noqa: B023
        r = got[b]
        best = min(options, key=lambda o: o[0])
        assert close(r["score"], best[0], 1e-6) and r["fold"] == best[1] and r["kept"] == len(best[2])
        assert np.allclose(r["mean"], best[2].mean(0)) and np.allclose(np.reshape(r["covariance"], (6, 6)), best[3]) and np.allclose(r["distances"], best[4], atol=1e-6)


def test_robust_covariance_leaves_the_outliers_out(spark):
    y = RNG.normal(size=(100, 3))
    y[40:60] += 30 * RNG.normal(size=(20, 3))
    for criterion in ("logdet", "trace", "mahalanobis"):
        assert modal.robust_covariance(as_blocks(spark, [y]), 5, criterion).first()["fold"] == 2
    assert modal.robust_covariance(as_blocks(spark, [y[:3]]), 5).count() == 0
    with pytest.raises(ValueError):
        modal.robust_covariance(as_blocks(spark, [y]), 5, "other")


@needs_tables
def test_registered_modal_queries(spark, blocks):  # noqa: F811
    got = run(spark, "filter_diagonalisation")
    want = [(b, band, k, v) for b, y in blocks.items() for band, (lo, hi) in enumerate(modal_queries.BANDS) for k, (v, e) in enumerate([p for p in modal.filtered_poles(y - y.mean(0), 80, lo, hi) if p[1] <= 2.0][:8])]
    assert {(r["block"], r["band"], r["place"]) for r in got} == {w[:3] for w in want} and len(got) == len(want) > 0
    for name in ("projected_modes", "projected_modes_recurring", "canonical_modes", "filter_diagonalisation_confirmed", "robust_covariance"):
        rows = run(spark, name)
        assert rows == run(spark, name), name  # the same draws each time
    assert {r["block"] for r in run(spark, "robust_covariance")} == set(blocks) and len(run(spark, "projected_modes")) > 0


@needs_tables
def test_spectra_and_residuals(spark, blocks):  # noqa: F811
    got = {r["block"]: r for r in run(spark, "covariance_spectra")}
    rest = {}
    for r in run(spark, "innovation_residuals"):
        rest.setdefault(r["block"], {})[r["channel"]] = r
    for b, y in blocks.items():
        values = np.linalg.eigvalsh(np.cov(y.T, bias=True))[::-1]
        assert np.allclose(got[b]["eigenvalues"], values) and got[b]["definite"] == bool(values[-1] > 1e-5 * values[0])
        assert len(rest[b]) == 6 and all(0 < r["rms"] and r["share"] < 3 for r in rest[b].values())


def test_residuals_of_a_known_model(spark):
    a, c, k = np.array([[0.8, 0.3], [-0.3, 0.8]]), np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]]), 0.3 * np.ones((2, 3))
    e = RNG.normal(size=(3000, 3))
    x, y = np.zeros(2), np.zeros((3000, 3))
    for i in range(3000):
        y[i] = c @ x + e[i]
        x = a @ x + k @ e[i]
    assert np.allclose(modal.innovations(y, a, c, k, 0), e)
    got = modal.residuals(as_blocks(spark, [y, y[:5]]), 6, 6, 2).collect()
    assert len(got) == 3 and all(abs(r["rms"] - 1) < 0.05 and r["share"] < 0.8 for r in got)
    flat = modal.covariance_spectra(as_blocks(spark, [np.outer(np.arange(9.0), [1.0, 2.0])])).first()
    assert not flat["definite"] and abs(flat["eigenvalues"][0] - 5 * np.var(np.arange(9.0))) < 1e-9

"""Registered results of queries that SQL does not express, against numpy over the same rows; other tests of the operators beside them."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxmode import registry
from fluxmode.functions import vectors
from fluxmode.operators import filters, frames, modes, params, spectral_clusters, sysid
from fluxmode.plans import grid_queries
from fluxmode.sources import examples, standins

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def grid(spark):
    out = np.zeros((standins.N_ROWS, standins.N_HOURS))
    for row in standins.grid(spark, SF).collect():
        out[row["f"], row["t"]] = row["v"]
    return out


@pytest.fixture(scope="module")
def blocks(spark):
    """block: samples x channels, made here from the events."""
    x = {}
    for e in standins.table(spark, SF, "events").select("user_id", F.unix_seconds("ts").alias("s"), "value").collect():
        i = (e["s"] - standins.EPOCH) // 3600
        x.setdefault(i, np.zeros(6))[e["user_id"] % 6] += e["value"]
    last = max(x)
    return {b: np.array([x[i] for i in range(120 * b, 120 * b + 240) if i in x]) for b in range((last - 239) // 120 + 1)}


def run(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]


def close(a, b, tol=1e-6):
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


def through(sections, x):
    """The difference equations, sample by sample, from the steady state of the first value."""
    for b, a in sections:
        b, a = np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))
        y0 = x[0] * b.sum() / a.sum()
        x1 = x2 = x[0]
        y1 = y2 = y0
        y = np.zeros(len(x))
        for i, v in enumerate(x):
            y[i] = b[0] * v + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
            x2, x1, y2, y1 = x1, v, y1, y[i]
        x = y
    return x


def both_ways(sections, x, pad):
    long = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    return through(sections, through(sections, long)[::-1])[::-1][pad : pad + len(x)]


def test_butterworth_and_band(spark, grid):
    low = filters.butterworth(2, "low", 0.2)
    want = [both_ways(low, row, 3 * (2 * len(low) + 1)) for row in grid]
    got = run(spark, "butterworth_filter")
    assert len(got) == grid.size and all(close(r["y"], want[r["f"]][r["t"]], 1e-5) for r in got)
    band = filters.butterworth(4, "band", (0.05, 0.25))
    got = {r["f"]: r["rms"] for r in run(spark, "band_rms")}
    assert all(close(got[f], math.sqrt(np.square(both_ways(band, row, 3 * (2 * len(band) + 1))).mean()), 1e-4) for f, row in enumerate(grid))


def test_baseline_columns(spark, grid):
    """Each line solves its own reweighted system: the residual of the normal equations is 0 at the weights it implies."""
    got = np.zeros_like(grid)
    for r in run(spark, "baseline_columns"):
        got[r["f"], r["t"]] = r["y"]
    d = np.diff(np.eye(len(grid)), 2, axis=0)
    for t in range(0, grid.shape[1], 60):
        x, w = grid[:, t], np.ones(len(grid))
        for _ in range(50):
            z = np.linalg.solve(np.diag(w) + 100.0 * d.T @ d, w * x)
            low = (x - z)[x < z]
            if len(low) < 2 or low.std() == 0:
                break
            new = 1 / (1 + np.exp(np.clip(2 * (x - z - (2 * low.std() - low.mean())) / low.std(), -500, 500)))
            if np.linalg.norm(w - new) / np.linalg.norm(w) < 1e-3:
                break
            w = new
        assert np.allclose(got[:, t], z, atol=1e-3)


def least_squares(y, order):
    past = np.hstack([y[order - k - 1 : len(y) - k - 1] for k in range(order)])
    return past, y[order:], np.linalg.lstsq(past, y[order:], rcond=None)[0].T


def test_ar_assess(spark, blocks):
    got = {(r["block"], r["channel"]): r for r in run(spark, "ar_assess")}
    assert len(got) == 6 * len(blocks)
    for b, y in blocks.items():
        y = y / np.maximum(np.sqrt(np.square(y).mean(0)), 1e-12)
        past, now, h = least_squares(y, 4)
        rest = np.square(now - past @ h.T).mean(0)
        size = np.sqrt(np.square(h).sum(0).reshape(4, 6).sum(0))
        for c in range(6):
            assert close(got[b, c]["daf"], max(0, 1 - math.sqrt(rest[c] / np.square(now[:, c]).mean())), 1e-5)
            assert close(got[b, c]["participation"], 6 * size[c] / size.sum(), 1e-5)


def poles(a, fs=1.0):
    z = np.linalg.eigvals(a)
    s = np.log(z[z.imag > 1e-14].astype(complex)) * fs
    return sorted((abs(v.imag) / (2 * np.pi), -v.real / abs(v)) for v in s)


def same_poles(got, want):
    assert len(got) == len(want)
    for (f, d), (g, e) in zip(sorted(got), want, strict=True):
        assert close(f, g, 1e-5) and close(d, e, 1e-5)


def test_arpca_models(spark, blocks):
    got = run(spark, "arpca_models")
    for b, y in blocks.items():
        y = y - y.mean(0)
        past, _, h = least_squares(y, 6)
        _, v = np.linalg.eigh((past @ h.T).T @ (past @ h.T))
        z = y @ v[:, ::-1][:, :3]
        _, _, low = least_squares(z, 6)
        a = np.vstack((low, np.eye(15, 18)))
        same_poles([(r["frequency"], r["damping"]) for r in got if r["block"] == b], poles(a))


def covariance_poles(y, rows, order):
    n, m = y.shape
    cols = n - 2 * rows + 1
    past, after = (np.vstack([y[i : i + cols].T for i in span]) for span in (range(rows), range(rows, 2 * rows)))
    u, s, _ = np.linalg.svd(after @ past.T / cols)
    obs = u[:, :order] * np.sqrt(s[:order])
    return poles(np.linalg.lstsq(obs[:-m], obs[m:], rcond=None)[0])


def test_ssi_and_stable_poles(spark, blocks):
    got, stable = run(spark, "ssi_poles"), run(spark, "stable_poles")
    for b, y in blocks.items():
        y = y - y.mean(0)
        same_poles([(r["frequency"], r["damping"]) for r in got if r["block"] == b], covariance_poles(y, 8, 8))
        low, high = covariance_poles(y, 8, 6), [f for f, _ in covariance_poles(y, 8, 10)]
        want = {(round(f, 6), round(min(abs(f - g) for g in high), 6)) for f, _ in low if f > 0 and any(g > 0 and abs(math.log(f / g)) <= math.log1p(0.05) for g in high)}
        assert {(round(r["frequency"], 6), round(r["distance"], 6)) for r in stable if r["block"] == b} == want


def test_canonical_poles(spark, blocks):
    got = run(spark, "cca_poles")
    for b, y in blocks.items():
        y = y - y.mean(0)
        cols = len(y) - 11
        past, after = (np.hstack([y[i : i + cols] for i in span]) for span in (range(6), range(6, 12)))
        # canonical directions by orthonormal bases of both spaces
        (qp, rp), (qf, _) = np.linalg.qr(past), np.linalg.qr(after)
        _, corr, v = np.linalg.svd(qf.T @ qp)
        x = past @ np.linalg.solve(rp, v[:4].T)
        now = y[6 : 6 + cols]
        c = np.linalg.lstsq(x, now, rcond=None)[0].T
        step = np.linalg.lstsq(np.hstack((x[:-1], now[:-1])), x[1:], rcond=None)[0].T
        own = [r for r in got if r["block"] == b]
        same_poles([(r["frequency"], r["damping"]) for r in own], poles(step[:, :4] + step[:, 4:] @ c))
        assert all(close(r["correlation"], corr[0], 1e-6) for r in own)


def test_canonical_model_finds_the_mode(spark):
    rng = np.random.default_rng(1)
    t = np.arange(2000) / 100
    x = np.exp(-0.02 * 2 * np.pi * 5 * t) * np.cos(2 * np.pi * 5 * t)
    y = np.c_[x, 0.5 * x] + 1e-3 * rng.normal(size=(2000, 2))
    a, c, k, corr, rest = sysid.canonical_state(y, 10, 10, 2)
    assert any(abs(f - 5) < 0.05 for f, _ in poles(a, 100.0)) and c.shape == (2, 2) == k.shape and corr[0] <= 1 + 1e-9 and (np.linalg.eigvalsh(rest) >= -1e-12).all()


def test_fold_covariances(spark, blocks):
    got = {(r["block"], r["fold"]): r for r in run(spark, "fold_covariances")}
    for b, y in blocks.items():
        for k in range(5):
            a, z = round(k * len(y) / 5), round((k + 1) * len(y) / 5)
            rest = np.delete(y, np.s_[a:z], 0)
            cov = np.cov(rest.T, bias=True)
            d = [math.sqrt(v @ np.linalg.solve(cov, v)) for v in y[a:z] - rest.mean(0)]
            r = got[b, k]
            assert close(r["trace"], np.trace(cov)) and close(r["logdet"], math.log(np.linalg.det(cov))) and close(r["distance"], np.mean(d))
    assert sysid.log_determinant(np.zeros((2, 2))) == -math.inf


def test_projections_and_components(spark, blocks):
    got, spectra = run(spark, "projected_poles"), run(spark, "component_spectra")
    for b, y in blocks.items():
        y, rng = y - y.mean(0), np.random.default_rng(0)
        for k in range(3):
            q, _ = np.linalg.qr(rng.normal(size=(6, 2)))
            _, _, h = least_squares(y @ q, 4)
            same_poles([(r["frequency"], r["damping"]) for r in got if r["block"] == b and r["draw"] == k], poles(np.vstack((h, np.eye(6, 8)))))
        w, v = np.linalg.eigh(y.T @ y)
        for c in range(2):
            p = np.square(np.abs(np.fft.rfft(y @ v[:, -1 - c])))
            own = {r["k"]: r for r in spectra if r["block"] == b and r["component"] == c}
            assert len(own) == len(p) and all(close(own[k]["p"], p[k], 1e-5) and close(own[k]["share"], w[-1 - c] / w.sum()) for k in own)


def test_frequency_shapes(spark, blocks):
    got = {(r["block"], r["mode"], r["channel"]): (r["re"], r["im"]) for r in run(spark, "frequency_shapes")}
    for b, y in blocks.items():
        t = np.arange(len(y))
        basis = np.c_[np.cos(0.2618 * t), np.cos(t), np.sin(0.2618 * t), np.sin(t)]
        c = np.linalg.solve(basis.T @ basis, basis.T @ y)
        assert all(close(got[b, j, ch][0], c[j, ch]) and close(got[b, j, ch][1], c[2 + j, ch]) for j in range(2) for ch in range(6))


def test_csm_modes(spark):
    z = {}
    for r in grid_queries._probes(spark, SF).collect():
        z.setdefault((r["w"], r["k"]), np.zeros(6, complex))[r["channel"]] = r["re"] + 1j * r["im"]
    frames_ = sorted({w for w, _ in z})
    steer = np.exp(-1j * np.outer(range(-5, 6), np.radians(list(grid_queries.ANGLES.values())))) / math.sqrt(6)
    got = run(spark, "csm_modes")
    assert len(got) == len(z)
    for r in got:
        at = [w for w in frames_ if (w, r["k"]) in z]
        i = at.index(r["w"])
        s = np.array([z[w, r["k"]] for w in at[max(0, i - 2) : i + 3]])
        csm = np.einsum("sa,sb->ab", s, s.conj()) / len(s)
        values, u = np.linalg.eigh(csm)
        a = np.abs(steer @ u[:, -1])
        assert close(r["power"], np.trace(csm).real / 6) and close(r["coherence"], values[-1] / values.sum(), 1e-6)
        assert np.allclose(r["amplitudes"], a, atol=1e-6) and a[r["n"] + 5] >= a.max() - 1e-6
        assert np.allclose(r["music"], 10 * np.log10(1 / np.clip(1 - a**2, 1e-10, None)), atol=1e-3)


def test_csm_finds_a_planted_mode(spark):
    rng = np.random.default_rng(2)
    rows = []
    for w in range(12):
        phase = rng.uniform(0, 2 * np.pi)
        for c, phi in grid_queries.ANGLES.items():
            v = np.exp(1j * (3 * math.radians(phi) + phase)) + 0.1 * (rng.normal() + 1j * rng.normal())
            rows.append((c, w, 1, float(v.real), float(v.imag)))
    got = modes.csm_modes(spark.createDataFrame(rows, "channel int, w int, k int, re double, im double"), grid_queries.ANGLES, range(-5, 6)).collect()
    assert len(got) == 12 and all(r["n"] == 3 and r["coherence"] > 0.8 and int(np.argmax(r["music"])) == 8 for r in got)


def test_noise(spark):
    got = run(spark, "noise_added")
    by = {}
    for r in got:
        by.setdefault(r["channel"], []).append((r["x"], r["y"]))
    z = np.concatenate([(np.array(v)[:, 1] - np.array(v)[:, 0]) / (0.1 * np.array(v)[:, 0].std()) for v in by.values() if np.std([a for a, _ in v]) > 0])
    assert abs(z.mean()) < 5 / math.sqrt(len(z)) and abs(z.std() - 1) < 0.1 and abs((np.abs(z) < 1).mean() - 0.683) < 0.06
    again = {(r["channel"], r["i"]): r["y"] for r in frames.noisy(standins.signal(spark, SF).repartition(3), 0.1, 7, "channel").collect()}
    assert all(close(again[r["channel"], r["i"]], r["y"], 1e-9) for r in got)


def test_example_signals(spark, monkeypatch):
    monkeypatch.setattr(examples, "CHUNK", 100)
    schema = "k int, samples int, rate double, noise double, seed int, parts array<struct<amplitude:double,frequency:double,sweep:double,centre:double,width:double>>"
    asked = [(1, 1000, 500.0, 0.0, 3, [(2.0, 20.0, 5.0, 0.3, None), (1.0, 90.0, 0.0, 1.0, 0.1)]), (2, 4000, 100.0, 1.5, 3, []), (3, 4000, 100.0, 1.5, 4, []), (4, 0, 100.0, 1.0, 1, [])]
    df = spark.createDataFrame(asked, schema)
    got = {}
    for row in examples.example_signals(df, "k").orderBy("k", "i").collect():
        got.setdefault(row["k"], []).append((row["i"], row["x"]))
    assert set(got) == {1, 2, 3} and all([i for i, _ in v] == list(range(len(v))) for v in got.values()) and len(got[1]) == 1000
    t = np.arange(1000) / 500.0
    want = 2 * np.sin(2 * np.pi * (20 * (t - 0.3) + 2.5 * (t - 0.3) ** 2)) + np.sin(2 * np.pi * 90 * (t - 1)) * np.exp(-0.5 * ((t - 1) / 0.1) ** 2)
    assert np.allclose([x for _, x in got[1]], want)
    noise = np.array([x for _, x in got[2]])
    assert abs(noise.std() - 1.5) < 0.1 and abs(noise.mean()) < 0.1 and abs(np.corrcoef(noise, [x for _, x in got[3]])[0, 1]) < 0.06
    assert sorted(map(tuple, examples.example_signals(df.repartition(3), "k").where("k = 2").select("i", "x").collect())) == got[2]


def test_cdf_threshold_against_numpy(spark):
    rng = np.random.default_rng(4)
    data = {g: np.round(rng.exponential(size=400) ** (g + 1), 2) for g in range(4)}
    rows = [(g, float(v)) for g, x in data.items() for v in x]
    got = {r["g"]: r["threshold"] for r in params.cdf_threshold(spark.createDataFrame(rows, "g int, x double"), "g", adjust=0.1).collect()}
    for g, x in data.items():
        x = np.sort(np.maximum(x, np.median(x)))
        u = (x - x[0]) / (x[-1] - x[0]) * 100
        at = np.linspace(0, 100, 100)
        y = np.interp(at, u, np.arange(400) / 399 * 200)
        d = np.abs(y - y[0] - (y[-1] - y[0]) / 100 * at)
        assert close(got[g], at[np.argmax(np.round(d, 9))] / 100 * (x[-1] - x[0]) + x[0] + 0.1 * (x[-1] - x[0]))


def test_scale_length_and_decimation(spark):
    rho = np.sort(np.random.default_rng(0).uniform(0, 1, 60))
    f = np.exp(-3 * rho)
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(rho, f, strict=True)], "k int, rho double, x double")
    got = frames.scale_length(df, 0.5, 0.6, "k").first()
    slope = np.gradient(f, rho * 0.6)
    assert close(got["length"], -np.interp(0.5, rho, f) / np.interp(0.5, rho, slope)) and abs(got["length"] - 0.2) < 0.01
    i = np.arange(4000)
    x = np.sin(2 * np.pi * 0.01 * i) + np.sin(2 * np.pi * 0.4 * i)
    df = spark.createDataFrame([(0, int(k), float(v)) for k, v in enumerate(x)], "k int, i long, x double")
    y = np.array([r["y"] for r in frames.decimated(df, 5, keys=("k",)).orderBy("m").collect()])
    assert len(y) == 800 and np.abs(y - np.sin(2 * np.pi * 0.01 * i[::5]))[20:-20].max() < 0.01


def test_prototypes_and_fit(spark):
    poles_ = spark.createDataFrame([(1, 10.0, 5.0), (2, 11.0, 6.0), (3, 90.0, 1.0)], "id long, time double, frequency double")
    got = {r["query"]: (r["id"], r["far"]) for r in modes.prototypes(poles_, [(10.6, 5.6), (60.0, 1.0)]).collect()}
    assert got == {0: (2, False), 1: (3, True)}
    rng = np.random.default_rng(7)
    b = rng.normal(size=4) + 1j * rng.normal(size=4)
    a = (2 - 3j) * b
    row = spark.createDataFrame([(*(v.tolist() for v in (a.real, a.imag, b.real, b.imag)), [0.0] * 4)], "ar array<double>, ai array<double>, br array<double>, bi array<double>, o array<double>")
    cols = [F.col(c) for c in ("ar", "ai", "br", "bi", "o")]
    r = row.select(*vectors.scalar_fit(*cols[:4]), *vectors.scalar_fit(*cols[:2], cols[4], cols[4])).first()
    assert np.allclose(list(r), [2, -3, 0, 0])


@pytest.mark.parametrize("kind", ["ng", "standard"])
def test_spectral_clusters(spark, kind):
    """Three dense groups with loose ties; eigenvalues as of the whole matrix."""
    rng = np.random.default_rng(5)
    label = np.arange(45) % 3
    w = np.where(label[:, None] == label[None], 1.0, 0.02) * rng.uniform(0.5, 1.5, (45, 45))
    w = np.triu(w, 1) + np.triu(w, 1).T
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(45) for j in range(45) if i != j], "a long, b long, w double")
    got = {r["id"]: r["cluster"] for r in spectral_clusters.clusters(edges, 3, kind).collect()}
    assert len({got[i] for i in range(3)}) == 3 and all(got[i] == got[i % 3] for i in range(45))
    d = w.sum(1)
    lap = np.diag(d) - w if kind == "standard" else np.eye(45) - w / np.sqrt(np.outer(d, d))
    _, values = spectral_clusters.embedding(edges, 3, kind)
    assert np.allclose(values, np.linalg.eigvalsh(lap)[:3], atol=1e-4)

"""Hand-made cases and numpy references for the operators."""

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxmode.operators import events, frames, grids, metrics, modes, params, similarity, spectral, stats, sysid
from fluxmode.plans import catalogue, staging
from fluxmode.sources import readers, sinks
from fluxmode.streaming import streams


def mask_of(spark, bursts, columns=50, rows=10, upto=10):
    on = {t for a, z in bursts for t in range(a, z + 1)}
    return spark.createDataFrame([(0, f, t, 1.0 if t in on and f < upto else 0.0) for f in range(rows) for t in range(columns)], "input int, f int, t int, s double")


def found(df):
    return sorted((r["start"], r["stop"]) for r in df.collect())


@pytest.mark.parametrize(("bursts", "gap", "least", "expected"), [
    ([(10, 12), (15, 17)], 3, 1, [(10, 17)]),
    ([(10, 12), (30, 32)], 3, 1, [(10, 12), (30, 32)]),
    ([(5, 5), (20, 24)], 1, 2, [(20, 24)]),
    ([], 3, 1, []),
])
def test_bursts(spark, bursts, gap, least, expected):
    assert found(events.elm_events(mask_of(spark, bursts), "input", min_gap=gap, min_duration=least)) == expected


def test_half_height_burst_has_half_activity(spark):
    (row,) = events.elm_events(mask_of(spark, [(10, 12)], upto=5), "input").collect()
    assert row["peak"] == 0.5 and row["duration"] == 3


def test_summary(spark):
    ev = events.elm_events(mask_of(spark, [(10, 12), (30, 32)], columns=100), "input")
    inputs = spark.createDataFrame([(0, 100, 200000.0), (1, 100, None)], "input int, n_cols int, fs double")
    a, b = events.elm_summary(ev, inputs, 256, "input").orderBy("input").collect()
    assert a["n_events"] == 2 and a["elm_freq_hz"] == pytest.approx(2 / (100 * 256 / 200000)) and a["duty_cycle"] == pytest.approx(0.06)
    assert b["n_events"] == 0 and b["elm_freq_hz"] is None and b["duty_cycle"] == 0


def test_islands_close_gaps_but_not_ends(spark):
    active = spark.createDataFrame([(0, t) for t in (1, 2, 5)], "k int, t int")
    assert found(events.islands(active, 0, "k")) == [(1, 2), (5, 5)]
    assert found(events.islands(active, 2, "k")) == [(1, 5)]


def test_overlaps(spark):
    a = spark.createDataFrame([(0, 0, 10), (0, 500, 510), (1, 0, 10)], "k int, start int, stop int")
    b = spark.createDataFrame([(0, 10, 20)], "k int, start int, stop int")
    assert events.overlapping(a, b, 64, "k").collect() == [(0, 0, 10)]
    assert sorted(events.overlapping(a, b, 64, "k", how="left_anti").collect()) == [(0, 500, 510), (1, 0, 10)]


def signal(spark, x, **more):
    return spark.createDataFrame([(0, i, float(i), float(v)) for i, v in enumerate(x)], "key int, i long, t double, x double")


def test_statistics_against_numpy(spark):
    x = np.random.default_rng(3).normal(size=500)
    x[7] = 40.0
    s = signal(spark, x)
    (row,) = stats.robust_stats(s, "key").collect()
    mid = np.median(x)
    assert row["median"] == pytest.approx(mid) and row["scale"] == pytest.approx(1.4826 * np.median(abs(x - mid)) + 1e-6)
    clipped = [r["clipped"] for r in stats.percentile_clip(s, "key").orderBy("i").collect()]
    assert clipped == pytest.approx(np.clip(x, *np.percentile(x, [1, 99])).tolist())
    assert stats.snr(s, "key").first()["snr"] == pytest.approx(x.var() / (np.diff(x).var() / 2 + 1e-12))
    assert stats.snr(signal(spark, [1, 2, 3]), "key").first()["snr"] == 1.0
    assert [r["i"] for r in stats.outliers_mad(s, "key", k=10.0).where("outlier").collect()] == [7]


def test_frames_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=40)
    got = {r["block"]: r for r in frames.block_statistics(signal(spark, x), 16, 8, "key").collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert got[2]["mean"] == pytest.approx(x[16:32].mean())
    grad = [r["slope"] for r in frames.gradient(signal(spark, x), "key").orderBy("i").collect()]
    assert grad == pytest.approx(np.gradient(x).tolist())
    again = [r["x"] for r in frames.resampled(signal(spark, x), 2.0, "key").orderBy("k").collect()]
    assert sorted(again) == pytest.approx(sorted(np.interp(np.linspace(0, 39, 79), np.arange(40), x).tolist()))


def test_short_and_empty_signals(spark):
    none = spark.createDataFrame([], "key int, i long, t double, x double")
    assert frames.block_statistics(none, 16, 8, "key").count() == 0
    assert frames.block_statistics(signal(spark, [1.0]), 16, 8, "key").count() == 0
    assert stats.robust_stats(none, "key").count() == 0
    assert frames.resampled(signal(spark, [1.0]), 2.0, "key").count() == 1


def flood(cells):
    """Labels by walking: the least t * 2^32 + f of each 4-connected region."""
    left, out = set(cells), {}
    while left:
        todo, region = [left.pop()], []
        while todo:
            f, t = todo.pop()
            region.append((f, t))
            for n in ((f + 1, t), (f - 1, t), (f, t + 1), (f, t - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        low = min(t * (1 << 32) + f for f, t in region)
        out |= dict.fromkeys(region, low)
    return out


@pytest.mark.parametrize("share", [0.45, 0.65])
def test_regions_against_flood_fill(spark, share):
    on = np.random.default_rng(11).random((12, 60)) < share
    cells = [(int(f), int(t)) for f, t in zip(*np.nonzero(on), strict=True)]
    mask = spark.createDataFrame([(0, f, t, True) for f, t in cells], "input int, f long, t long, s boolean")
    got = grids.connected_regions(mask, "input", tile=7)
    expected = flood(cells)
    assert {(r["f"], r["t"]): r["label"] for r in got.collect()} == expected
    sizes = np.unique(list(expected.values()), return_counts=True)
    large = set(sizes[0][sizes[1] >= 3].tolist())
    assert {r["label"] for r in grids.without_small(mask, got, 3, "input").collect()} == large


def test_knee(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=20000)
    x[:200] = rng.normal(8, 0.5, 200)
    df = spark.createDataFrame([(0, float(v)) for v in x] + [(1, -1.0)] * 10, "g int, x double")
    a, b = params.knee_threshold(df, "g").orderBy("g").collect()
    assert 1 < a["threshold"] < 8 and not a["used_fallback"]
    assert b["used_fallback"] and b["threshold"] == float("inf")


def test_spectra_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=256)
    s = signal(spark, x)
    spec = spectral.spectra(spectral.framed(s, 64, 32, "key"), 64, "hann", keys=("key",))
    rows = {r["block"]: np.array(r["re"]) + 1j * np.array(r["im"]) for r in spec.collect()}
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    assert sorted(rows) == list(range(7))
    for b, z in rows.items():
        assert np.allclose(z, np.fft.rfft(x[32 * b : 32 * b + 64] * w))
    power = [r["power"] for r in spectral.dft_power(s, 256, 20, "key").orderBy("k").collect()]
    assert sorted(power) == pytest.approx(sorted((abs(np.fft.rfft(x)[:20]) ** 2).tolist()))


def test_relational_and_batched_spectra_agree(spark):
    x = np.sin(2 * np.pi * 9 * np.arange(128) / 128)
    bins = spectral.power_rows(spectral.spectra(spectral.framed(signal(spark, x), 128, 128, "key"), 128, "none", keys=("key",)), "key")
    assert bins.orderBy(F.desc("p")).first()["k"] == 9


def test_mode_number_of_a_rotating_tone(spark):
    angles = {0: 0, 1: 40, 2: 90, 3: 140, 4: 200, 5: 250}
    rows = [(0, c, float(np.cos(np.radians(2 * a))), float(np.sin(np.radians(2 * a)))) for c, a in angles.items()]
    probes = spark.createDataFrame(rows, "w int, channel int, re double, im double")
    amp = modes.steering(probes, angles, range(-4, 5), "w")
    best = modes.dominant(amp, "w").first()
    assert abs(best["n"]) == 2 and best["amp"] == pytest.approx(1.0)


def test_system_identification_recovers_a_pole(spark):
    rng, n = np.random.default_rng(0), 2000
    lam = np.exp((-0.02 * 2 * np.pi * 5 + 2j * np.pi * 5 * np.sqrt(1 - 0.02**2)) / 100)
    z, out = 0j, []
    for _ in range(n):
        z = lam * z + rng.normal()
        out.append((z.real + 0.01 * rng.normal(), 0.5 * z.imag + 0.01 * rng.normal()))
    rows = [(0, i, c, float(v[c])) for i, v in enumerate(out) for c in (0, 1)]
    df = spark.createDataFrame(rows, "input int, i long, channel int, x double")
    poles = sysid.ssi_poles(sysid.channel_blocks(df, n, n, 2, "input"), 10, 2, 100.0).collect()
    assert any(abs(p["frequency"] - 5) < 0.2 and abs(p["damping"] - 0.02) < 0.02 for p in poles)


def test_searches_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = similarity.nearest(df, df.where("vec_id % 100 = 0"), 5)
    for q in (0, 100, 200):
        s = unit @ unit[q]
        s[q] = -2
        assert [r["id"] for r in got.where(F.col("query") == q).orderBy("rank").collect()] == np.argsort(-s)[:5].tolist()
    near = {q: set(np.argsort(-(unit @ unit[q]) + 9 * (np.arange(300) == q))[:3].tolist()) for q in range(300)}
    pairs = {(r["query"], r["id"]) for r in similarity.mutual(similarity.reciprocal(df, df.where("vec_id % 10 = 0"), 3)).collect()}
    assert pairs == {(a, b) for a in range(0, 300, 10) for b in near[a] if a in near[b]} and pairs


def test_searches_in_parts(spark, monkeypatch):
    """Many parts of queries, tiles and batches, and equal similarities: the least id first."""
    x = np.random.default_rng(5).integers(0, 2, (200, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    d = -np.sqrt(np.square(x[:, None] - x[None]).sum(2))
    np.fill_diagonal(d, -np.inf)
    monkeypatch.setattr(similarity, "MAX_QUERY_BYTES", 1000)
    monkeypatch.setattr(similarity, "TILE", 700)
    got = similarity.nearest(df, df.where("vec_id < 40"), 6, "euclidean").collect()
    for q in range(40):
        assert [r["id"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(200), -d[q]))[:6].tolist()
    near = {(r["query"], r["id"]) for r in similarity.within(df, df.where("vec_id < 40"), -1.0, "euclidean").collect()}
    assert near == {(q, int(i)) for q in range(40) for i in np.flatnonzero(d[q] >= -1)}


def test_medoids_against_numpy(spark):
    rng = np.random.default_rng(9)
    x, label = rng.normal(size=(400, 6)) * rng.exponential(size=(400, 1)), rng.integers(0, 3, 400)
    x[label == 2] = x[label == 2][0]  # all alike: the least id
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True))], "vec_id long, label int, embedding array<double>").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    z = unit[:, :3] + 1j * unit[:, 3:]
    for metric, d in (("euclidean", np.sqrt(np.square(x[:, None] - x[None]).sum(2))), ("cosine", 1 - unit @ unit.T), ("mac", 1 - np.abs(z.conj() @ z.T) ** 2)):
        for r in similarity.medoids(df, metric=metric, batch=7).collect():
            own = np.flatnonzero(label == r["label"])
            cost = d[np.ix_(own, own)].sum(1)
            assert abs(r["cost"] - cost.min()) < 1e-6 and r["medoid"] == own[np.argmin(np.round(cost, 7))]
    assert similarity.medoids(df.limit(0)).count() == 0


def test_asof_nearest(spark):
    rng = np.random.default_rng(3)
    series = [(int(c), float(t), float(x)) for c, t, x in zip(rng.integers(0, 4, 300), rng.integers(0, 5000, 300) / 2, rng.integers(0, 9, 300), strict=True)]
    points = [(k, int(c), float(t)) for k, (c, t) in enumerate(zip(rng.integers(0, 6, 200), rng.integers(-400, 6000, 200) / 2, strict=True))]
    got = frames.asof_nearest(spark.createDataFrame(points, "k int, channel int, t0 double"), spark.createDataFrame(series, "channel int, t double, x double"), 50.0, "channel")
    got = {r["k"]: (r["d"], r["t"], r["x"]) for r in got.collect()}
    assert got == {k: min(((abs(t - t0), t, x) for ch, t, x in series if ch == c), default=(None, None, None)) for k, c, t0 in points}


def test_kmeans_against_numpy(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 1, (100, 4)) for m in (-2, 0, 2)])
    c, cost = x[[0, 100, 200]].copy(), None
    start = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster int, centre array<double>")
    for _ in range(10):
        d = np.square(x[:, None] - c[None]).sum(2)
        total = d.min(1).sum()
        if cost is not None and total >= cost:
            break
        cost, c = total, np.array([x[d.argmin(1) == k].mean(0) for k in range(3)])
    expected = np.square(x[:, None] - c[None]).sum(2).argmin(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = similarity.kmeans(df, start, 4).orderBy("vec_id").collect()
    assert [r["cluster"] for r in got] == expected.tolist()
    assert similarity.kmeans(df.limit(0), start, 4).count() == 0


def test_kmeans_settles(spark):
    x = np.random.default_rng(6).uniform(0, 1, (600, 2))
    c, n = x[:8].copy(), 0
    start = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster int, centre array<double>")
    at = None
    while True:
        new = np.square(x[:, None] - c[None]).sum(2).argmin(1)
        if at is not None and (new == at).all():
            break
        at, n = new, n + 1
        c = np.array([x[at == k].mean(0) for k in range(8)])
    assert n > 20
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert [r["cluster"] for r in similarity.kmeans(df, start, 2).orderBy("vec_id").collect()] == at.tolist()
    with pytest.raises(RuntimeError):
        similarity.kmeans(df, start, 2, rounds=10)


def test_folds_are_even_and_stable(spark):
    rows = metrics.folds(spark.range(5000), "id", 5)
    assert rows.collect() == metrics.folds(spark.range(5000).repartition(7), "id", 5).orderBy("id").collect()
    assert all(800 < r["count"] < 1200 for r in rows.groupBy("fold").count().collect())


def test_catalogue_queries(spark):
    made = "shot long, start long, stop long, f_low double, f_high double, n long, detector string"
    df = spark.createDataFrame([(1, 0, 10, 20.0, 40.0, 2, "mode"), (1, 100, 110, 20.0, 40.0, 2, "mode"), (1, 5, 6, None, None, None, "elm"), (2, 0, 1, 90.0, 99.0, 2, "mode")], made)
    rows = catalogue.record(df, **{c: F.col(c) for c in df.columns})
    assert rows.columns == list(catalogue.COLUMNS)
    assert [r["start"] for r in catalogue.find(rows, n=2, band=(30.0, 35.0), without="elm").collect()] == [100]


def test_stale_stages(spark):
    state = spark.createDataFrame([("a", "complete", 5), ("b", "complete", 3), ("c", "complete", 9), ("d", "failed", 1)], "step string, status string, ran_at int")
    order = spark.createDataFrame([("b", "a"), ("c", "a")], "step string, upstream string")
    assert {r["step"]: r["status"] for r in staging.stale(state, order).collect()} == {"a": "complete", "b": "stale", "c": "complete", "d": "failed"}
    assert staging.params_hash({"a": 1, "b": 2}) == staging.params_hash({"b": 2, "a": 1})


def test_readers(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "line.npy", np.arange(4.0))
    (tmp_path / "bad.npy").write_bytes(b"not an array")
    arrays = readers.npy(spark, str(tmp_path))
    assert sorted((r["f"], r["t"], r["v"]) for r in readers.images(arrays).collect()) == [(f, t, a[f, t]) for f in range(2) for t in range(3)]
    assert [r["x"] for r in readers.signals(arrays).orderBy("i").collect()] == [0.0, 1.0, 2.0, 3.0]
    assert arrays.where("error IS NOT NULL").count() == 1
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(struct.pack("<3h", 0, 16384, -32768))
    (tmp_path / "s.wav").write_bytes(buf.getvalue())
    assert readers.sound(spark, str(tmp_path)).first()["data"] == [0.0, 0.5, -1.0]
    (tmp_path / "t.csv").write_text("t,a,b\n0,1,2\n1,3,\n")
    rows = readers.series(spark, str(tmp_path / "t.csv")).where("x IS NOT NULL").collect()
    assert sorted((r["channel"], r["t"], r["x"]) for r in rows) == [("a", 0.0, 1.0), ("a", 1.0, 3.0), ("b", 0.0, 2.0)]
    formats = {r["path"].rsplit("/", 1)[1]: r["format"] for r in readers.detected(spark, str(tmp_path)).collect()}
    assert formats["a.npy"] == "npy" and formats["s.wav"] == "wav" and formats["t.csv"] == "unknown"


def test_sinks(spark, tmp_path):
    ev = events.elm_events(mask_of(spark, [(10, 12)]), "input")
    rows = sinks.event_rows(ev, 256, None)
    assert rows.columns == ["input", "event", "start_col", "end_col", "duration_cols", "t_start_s", "t_end_s", "duration_s", "peak_activity"]
    sinks.write_text(rows, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True).first()
    assert back["start_col"] == "10" and back["t_start_s"] is None
    sinks.write_bundle(rows, str(tmp_path / "bundle"), "events-1", "shot-7", threshold=0.5)
    assert spark.read.parquet(str(tmp_path / "bundle")).first()["source"] == "shot-7"


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.range(300).selectExpr("id % 3 AS user_id", "timestamp_seconds(1704067200 + id * 20) AS ts", "cast(id % 7 AS double) AS value")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = streams.tumbling(streams.source(spark, str(tmp_path / "in")), "10 minutes", "10 minutes", "user_id")
    got = streams.drained(stream, spark, "tumbled", str(tmp_path / "c1"), "complete")
    expected = rows.groupBy(F.window("ts", "10 minutes").start.alias("start"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert sorted(got.collect()) == sorted(expected.collect())
    last = streams.drained(streams.forgetting(streams.source(spark, str(tmp_path / "in")), 0.5, "user_id"), spark, "forgot", str(tmp_path / "c2"))
    for r in last.collect():
        y = 0.0
        for i in range(r["key"], 300, 3):
            y = 0.5 * y + 0.5 * (i % 7)
        assert r["y"] == pytest.approx(y) and r["n"] == 100

"""What must not grow with the input: plans, ties among many copies, passes over all rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxmode.operators import modes, similarity, spectral_clusters
from fluxmode.sources import examples


def shapes(spark, x, block):
    h = x.shape[1] // 2
    return spark.createDataFrame([(int(b), i, v[:h].tolist(), v[h:].tolist()) for i, (b, v) in enumerate(zip(block, x, strict=True))], "block int, id long, re array<double>, im array<double>")


def test_traces_of_many_references(spark, monkeypatch):
    """references are no part of the plan, whatever their number; copies have one MAC, and the least id stays."""
    rng = np.random.default_rng(1)
    x = np.tile(rng.normal(size=(90, 8)), (3, 1))
    block = np.tile(np.arange(90) % 4, 3)
    df = shapes(spark, x, block).repartition(5)
    refs = lambda n: df.where(f"id < {n}").select(F.col("id").alias("reference"), "re", "im")
    size = lambda n: len(modes.traces(df, refs(n), 0.2)._jdf.queryExecution().optimizedPlan().toString())
    assert size(60) < size(2) + 100
    z = x[:, :4] + 1j * x[:, 4:]
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    mac = np.round(np.abs(z[:60].conj() @ z.T) ** 2, 10)
    want = {(q, b, int(np.flatnonzero((block == b) & (mac[q] == mac[q, block == b].max()))[0])) for q in range(60) for b in range(4) if mac[q, block == b].max() >= 0.2}
    for most in (similarity.MAX_QUERY_BYTES, 1000):
        monkeypatch.setattr(similarity, "MAX_QUERY_BYTES", most)
        monkeypatch.setattr(similarity, "TILE", 200)
        got = modes.traces(df, refs(60), 0.2).collect()
        assert {(r["reference"], r["block"], r["id"]) for r in got} == want and len(got) == len(want)
        assert all(abs(r["mac"] - mac[r["reference"], r["id"]]) < 1e-9 for r in got)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "mac"])
def test_equal_rows_by_least_id(spark, metric):
    """small tiles, and copies of one vector have one similarity wherever they stand."""
    x = np.tile(np.random.default_rng(2).normal(size=(50, 64)), (20, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    assert similarity.TILE <= 1 << 20
    for r in similarity.nearest(df, df.where("vec_id < 50"), 6, metric).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("n")).collect():
        assert [p["id"] for p in r["n"]] == [r["query"] + 50 * c for c in range(1, 7)]


@pytest.mark.parametrize("kind", ["random", "copies"])
def test_a_search_holds_a_few_tiles(kind):
    """what a task holds at once does not grow with its rows or with the queries."""
    x = np.random.default_rng(6).normal(size=(10000, 64))
    x = x[np.arange(len(x)) % 50] if kind == "copies" else x
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(list(x))], ["id", "v"])
    peaks = []
    for n, times in ((600, 1), (2400, 2)):

        class Sent:
            value = (np.arange(n), x[:n])

        tracemalloc.start()
        assert sum(b.num_rows for b in similarity._best(Sent, 10, "euclidean")(iter([batch] * times))) == 10 * n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 60e6 and peaks[1] < 1.3 * peaks[0]


def test_rounds_of_kmeans_shuffle_nothing(spark):
    """a round is one job of one stage over kept blocks; single and double precision vectors in many blocks."""
    rng = np.random.default_rng(3)
    for kind, x in (("float", rng.normal(size=(700, 4)).astype("f4").astype(float)), ("double", rng.normal(size=(700, 4)))):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(3)
        start = spark.createDataFrame(list(enumerate(x[:4].tolist())), "cluster int, centre array<double>")
        c, cost, rounds = x[:4], np.inf, 0
        while True:
            d = np.square(x[:, None] - c[None]).sum(2)
            if d.min(1).sum() >= cost:
                break
            cost, rounds = d.min(1).sum(), rounds + 1
            c = np.array([x[d.argmin(1) == k].mean(0) for k in range(4)])
        sc = spark.sparkContext
        sc.setJobGroup(f"kmeans-{kind}", "rounds")
        got = similarity.kmeans(df, start, 4)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(f"kmeans-{kind}")]
        sc.setJobGroup("", "")
        assert [r["cluster"] for r in got.orderBy("vec_id").collect()] == d.argmin(1).tolist()
        assert rounds > 10 and sum(len(j.stageIds) for j in jobs) <= rounds + 10


def test_medoids_take_a_fixed_number_of_passes(spark, monkeypatch):
    """bounds that prune nothing do not add a pass for each `batch` members; copies, ids that come twice, and sums in parts."""
    rng = np.random.default_rng(4)
    jobs, sc = [], spark.sparkContext
    for n, most in ((60, similarity.MAX_QUERY_BYTES), (900, similarity.MAX_QUERY_BYTES), (900, 4000)):
        monkeypatch.setattr(similarity, "MAX_QUERY_BYTES", most)
        x = rng.normal(size=(n, 5)).astype("f4").astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x[n // 2 :] = x[: n - n // 2][::-1]  # copies
        label, ids = np.arange(n) % 3 % 2, np.arange(n) // 2 * 3 % 1000
        df = spark.createDataFrame([(int(i), int(c), v.tolist()) for i, c, v in zip(ids, label, x, strict=True)], "vec_id long, label int, embedding array<double>").repartition(3).persist()
        sc.setJobGroup(f"medoids-{n}-{most}", "passes")
        got = {r["label"]: r for r in similarity.medoids(df, batch=4).collect()}
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"medoids-{n}-{most}")))
        sc.setJobGroup("", "")
        assert set(got) == {0, 1}
        for c, r in got.items():
            own = label == c
            cost = np.sqrt(np.square(x[own][:, None] - x[own][None]).sum(2)).sum(1)
            assert abs(r["cost"] - cost.min()) < 1e-9 * n and r["medoid"] == ids[own][cost < cost.min() + 1e-8].min()
    assert jobs[1] <= jobs[0] + 6


@pytest.mark.parametrize("spread", [0.05, 0.3, 3.0])
def test_bounds_of_summed_distances(spread):
    """the bound from moments is below the sum and near it; with outliers and rows all alike too."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 12)) * np.exp(spread * rng.normal(size=(800, 1)))
    for u in (x - x.mean(0), np.zeros((300, 12)), np.concatenate((x, x[:1] * 1e6))):

        class Sent:
            value = ({7: (len(u), np.zeros(12))}, {7})

        batch = pa.RecordBatch.from_arrays([pa.array([7] * len(u)), pa.array(range(len(u))), pa.array(u.tolist())], ["c", "id", "v"])
        sums = np.concatenate([b.column(3)[0].values.to_numpy() for b in similarity._moments(Sent)(iter([batch.slice(0, 200), batch.slice(200)]))])
        top = np.square(u).sum(1).max()
        true, low = np.sqrt(np.square(u[:, None] - u[None]).sum(2)).sum(1), similarity._least_sum(u, top, sums)
        assert (low <= true * (1 + 1e-12)).all()
        if spread < 0.1 and len(u) == 800:
            assert (low > 0.95 * true).all()  # n |x - mean| is 0.7 of it


@pytest.mark.parametrize("kind", ["ng", "standard"])
def test_twins_are_one_node(spark, kind, monkeypatch):
    """the leaves of hubs are one node each; eigenvalues are those of the whole graph, and the spaces that they span too."""
    hubs, leaves = 3, 14
    w = np.zeros((hubs * (leaves + 1),) * 2)
    for h in range(hubs):
        for i in range(leaves - h):
            w[h, hubs + h * leaves + i] = 1.0 + h
        for g in range(h):
            w[h, g] = 0.05 * (1 + h + g)
    w = w + w.T
    w = w[np.ix_(w.sum(1) > 0, w.sum(1) > 0)]
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "a long, b long, w double").repartition(3)
    d = w.sum(1)
    lap = np.diag(d) - w if kind == "standard" else np.eye(len(w)) - w / np.sqrt(np.outer(d, d))
    true, u = np.linalg.eigh(lap)
    sizes, inner = [], spectral_clusters._iterated
    monkeypatch.setattr(spectral_clusters, "_iterated", lambda *a: (sizes.append(a[3]), inner(*a))[1])
    found, values = spectral_clusters.embedding(edges, hubs, kind)
    assert sizes == [2 * hubs] and np.allclose(values, true[:hubs], atol=1e-5)
    v = np.array([r["v"] for r in found.orderBy("id").collect()])
    assert v.shape == (len(w), hubs) and np.allclose(v @ v.T, u[:, :hubs] @ u[:, :hubs].T, atol=1e-3)
    assert np.allclose(spectral_clusters.embedding(edges, 8, kind, vectors=False)[1], true[:8], atol=1e-5)


def test_signals_are_made_in_batches(spark, monkeypatch):
    """tones are summed over whole batches, not by a lambda a sample; signals of other numbers of parts share a batch."""
    monkeypatch.setattr(examples, "CHUNK", 50)
    part = "array<struct<amplitude:double,frequency:double,sweep:double,centre:double,width:double>>"
    rows = [(1, 30, 10.0, 0.0, 0, [(2.0, 1.0, 0.5, 0.1, None)]), (2, 120, 10.0, 0.0, 0, [(1.0, 2.0, 0.0, 0.0, None), (3.0, 1.5, 0.0, 2.0, 0.5)]), (3, 7, 5.0, 0.0, 0, []), (4, 3, 5.0, 0.0, 0, None)]
    made = examples.example_signals(spark.createDataFrame(rows, f"k int, samples int, rate double, noise double, seed int, parts {part}").coalesce(1), "k")
    assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in made.orderBy("k", "i").collect():
        got.setdefault(r["k"], []).append((r["i"], r["t"], r["x"]))
    for k, samples, rate, _, _, parts in rows:
        assert [i for i, _, _ in got[k]] == list(range(samples))
        for i, t, x in got[k]:
            want = None if parts is None else sum(a * np.sin(2 * np.pi * (f * (i / rate - c) + s * (i / rate - c) ** 2 / 2)) * (1 if w is None else np.exp(-0.5 * ((i / rate - c) / w) ** 2)) for a, f, s, c, w in parts)
            assert t == i / rate and (x is None if want is None else abs(x - want) < 1e-9)

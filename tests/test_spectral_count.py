"""The number of clusters from eigenvalues, and the best of several starts, on planted graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxmode.operators import spectral_clusters


def planted(spark, sizes, inside, between, seed=5):
    rng = np.random.default_rng(seed)
    label = np.repeat(np.arange(len(sizes)), sizes)
    n = len(label)
    w = np.where(label[:, None] == label[None], inside, between) * rng.uniform(0.5, 1.5, (n, n))
    w = np.triu(w, 1) + np.triu(w, 1).T
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if i != j and w[i, j] > 0], "a long, b long, w double")
    return w, label, edges.coalesce(2)


def dense_count(w, kind):
    d = w.sum(1)
    lap = np.diag(d) - w if kind == "standard" else np.eye(len(w)) - w / np.sqrt(np.outer(d, d))
    return max(2, int(np.argmax(np.diff(np.linalg.eigvalsh(lap)[: len(w) // 2]))) + 1)


@pytest.mark.parametrize("kind,sizes", [("ng", (12, 9, 15)), ("standard", (10, 10, 10))])
def test_count_is_that_of_all_eigenvalues(spark, kind, sizes):
    w, label, edges = planted(spark, sizes, 1.0, 0.02)
    assert spectral_clusters.count_by_gap(edges, kind, first=4 if kind == "ng" else 8) == dense_count(w, kind) == len(sizes)


def test_blocks_grow_until_the_gap_is_sure(spark):
    """Seven groups are more than a first block of three shows."""
    w, label, edges = planted(spark, (4,) * 7, 1.0, 0.01)
    assert spectral_clusters.count_by_gap(edges, "ng", first=3) == dense_count(w, "ng") == 7


def test_small_graphs(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "a long, b long, w double")
    assert spectral_clusters.count_by_gap(edges) == 2


def test_clusters_without_a_number(spark):
    _, label, edges = planted(spark, (10, 12, 9), 1.0, 0.02)
    got = {r["id"]: r["cluster"] for r in spectral_clusters.clusters(edges, trials=2).collect()}
    assert len(set(got.values())) == 3 and all((got[i] == got[j]) == (label[i] == label[j]) for i in got for j in got)


def test_starts_differ_by_seed(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(50)], "id long, v array<double>")
    first = lambda s: spectral_clusters.farthest_first(rows, 2, s).where(F.col("cluster") == 0).first()["centre"]
    assert first(0) == [0.0, 0.0] and len({tuple(first(s)) for s in range(6)}) > 2

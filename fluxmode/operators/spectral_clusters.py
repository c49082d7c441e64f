"""Spectral clustering of a sparse similarity graph: eigenvectors by subspace iteration, then k-means on their rows.

The graph is a table of edges and the eigenvectors are a table of one row a node, so no matrix is held
anywhere: a multiplication is a join of edges and rows and a sum by node. The driver gets matrices of
the subspace's size only, and no table of nodes is broadcast through it. Nodes with the same neighbours at the same weights
(twins, as the leaves of a hub) are one node of a smaller graph, which has the same eigenvectors but for differences of twins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import settled
from .similarity import kmeans

#: Multiplications between two orthonormalisations, and the change of eigenvalues that ends the rounds.
STEPS, TOLERANCE = 4, 1e-6


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("degree"))


def _twins(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, twin: the least node with the same neighbours at the same weights. Lists of neighbours are known by 128 bits, which add up in any order."""
    each = edges.where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"))
    bits = lambda k: F.sum(F.xxhash64("b", "w", F.lit(k)).cast("decimal(20,0)")).alias(f"h{k}")
    known = settled(each.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("h"), bits(0), bits(1)), "neighbours")
    least = known.groupBy("h", "h0", "h1").agg(F.min("id").alias("twin"))
    marked = known.hint("merge").join(least.hint("merge"), ["h", "h0", "h1"]).select("id", "twin")
    return settled(nodes.hint("merge").join(marked.hint("merge"), "id", "left").select("id", "degree", F.coalesce("twin", "id").alias("twin")), "twins")


def embedding(edges: DataFrame, k: int, kind: str = "ng", spare: int = 5, most: int = 200, tolerance: float = TOLERANCE, vectors: bool = True) -> tuple[DataFrame | None, np.ndarray]:
    """(id, degree, v: array of k) of the k least eigenvectors of the graph's Laplacian, and their eigenvalues; vectors: whether they are asked for.

    edges: a, b, w in both directions, weights positive, no loops. kind: standard (D - W), shi or ng (both normalised:
    I - D^-1/2 W D^-1/2). The greatest eigenvectors of the shifted complement are iterated; an error tells if
    `most` rounds did not settle them.

    m twins have m - 1 eigenvectors that are differences between them, of eigenvalue 1 (normalised) or of their degree; the others are those
    of the graph of one node for all twins. Where differences are among the k least and vectors are asked for, the graph is taken as it is.
    """
    nodes = settled(degrees(edges), "degrees")
    n, top = nodes.agg(F.count("*"), F.max("degree")).first()
    twins = _twins(edges, nodes)
    classes = settled(twins.groupBy(F.col("twin").alias("id")).agg(F.count("*").alias("m"), F.max("degree").alias("degree")), "classes")
    few = classes.count()
    if few < n:
        # of m twins the differences' eigenvalue comes m - 1 times; the k least are enough
        if kind == "standard":
            low = [r for r in classes.where("m > 1").orderBy("degree").limit(k).collect()]
            differences = np.repeat([float(r["degree"]) for r in low], [min(r["m"] - 1, k) for r in low])[:k]
        else:
            differences = np.ones(min(n - few, k))
        a = twins.select(F.col("id").alias("a"), F.col("twin").alias("_ta"))
        b = twins.select(F.col("id").alias("b"), F.col("twin").alias("_tb"))
        # every twin has the same links, so one of them stands for all
        own = edges.where("a <> b").hint("merge").join(a.where("a = _ta").hint("merge"), "a").groupBy("a", "b").agg(F.sum("w").alias("w"))
        links = own.hint("merge").join(b.hint("merge"), "b").groupBy("a", F.col("_tb").alias("b")).agg(F.max("w").alias("w"))
        lead, values = _iterated(classes, settled(links, "class-links"), min(k, few), few, top, kind, spare, most, tolerance)
        merged = np.sort(np.concatenate((values, differences)))[:k]
        if not vectors:
            return None, merged
        if len(values) == k and values[-1] < differences[0] - 1e-6:
            spread = lead.select(F.col("id").alias("twin"), F.transform("v", lambda x: x / F.sqrt("m")).alias("v"))
            return twins.hint("merge").join(spread.hint("merge"), "twin").select("id", "degree", "v"), merged
    whole = nodes.withColumn("m", F.lit(1).cast("long"))
    lead, values = _iterated(whole, edges.where("a <> b").select("a", "b", "w"), k, n, top, kind, spare, most, tolerance)
    return lead.select("id", "degree", "v"), values


def _iterated(nodes: DataFrame, links: DataFrame, k: int, n: int, top: float, kind: str, spare: int, most: int, tolerance: float) -> tuple[DataFrame, np.ndarray]:
    """(id, degree, m, v) and eigenvalues by subspace iteration. nodes: id, degree, m (how many twins it stands for)."""
    size = int(min(k + spare, n))
    one = nodes.select(F.col("id").alias("a"), F.col("degree").alias("_d"), F.col("m").alias("_m"))
    end = nodes.select(F.col("id").alias("b"), F.col("degree").alias("_e"), F.col("m").alias("_n"))
    # the complement's spectrum lies in [0, 1]: (I + S) / 2, or I - L / (2 max degree)
    pull = 0.5 if kind != "standard" else 1 / (2 * top)
    share = F.col("w") * F.sqrt(F.col("_m") * F.col("_n")) * pull
    share = share / F.sqrt(F.col("_d") * F.col("_e")) if kind != "standard" else share
    stay = F.lit(0.5) if kind != "standard" else 1 - F.col("degree") / (2 * top)
    pulls = links.hint("merge").join(one.hint("merge"), "a").hint("merge").join(end.hint("merge"), "b").select("a", "b", share.alias("s"))
    matrix = settled(pulls.union(nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), stay.alias("s"))), "matrix")
    start = F.array(*(F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1 << 30)) / float(1 << 30) - 0.5 for j in range(size)))
    y = nodes.select("id", "degree", start.alias("v"))

    def multiplied(y: DataFrame) -> DataFrame:
        sums = F.array(*(F.sum(F.col("s") * F.get("v", F.lit(j))) for j in range(size)))
        return matrix.hint("merge").join(y.select(F.col("id").alias("b"), "v").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.lit(0.0).alias("degree"), sums.alias("v"))

    values = None
    for _ in range(most):
        for _ in range(STEPS):
            y = settled(multiplied(y), "subspace")
        w, u = np.linalg.eigh(_products(y.select("v", F.col("v").alias("z")), size))
        y = settled(_turned(y, u / np.sqrt(np.maximum(w, w.max() * 1e-14))), "subspace")  # orthonormal
        z = multiplied(y).select("id", F.col("v").alias("z"))
        h = _products(y.hint("merge").join(z.hint("merge"), "id").select("v", "z"), size)
        new, turn = np.linalg.eigh((h + h.T) / 2)
        new, turn = new[::-1][:k], turn[:, ::-1]
        if values is not None and np.abs(new - values).max() < tolerance:
            break
        values = new
    else:
        raise RuntimeError("eigenvectors did not settle")
    lead = _turned(y, turn[:, :k]).select("id", "v").hint("merge").join(nodes.hint("merge"), "id").select("id", "degree", "m", "v")
    return lead, 2 * (1 - new) if kind != "standard" else 2 * top * (1 - new)


def _products(pairs: DataFrame, size: int) -> np.ndarray:
    """The sum over rows (v, z) of outer products, a matrix of the subspace's size; tasks add up their own."""

    def run(batches):
        total = np.zeros((size, size))
        for b in batches:
            v, z = (np.array(c.to_pylist(), float).reshape(-1, size) for c in b.columns)
            total += v.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["i", "x"])

    got = pairs.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # size^2 rows
    return np.array([r["x"] for r in got]).reshape(size, size)


def _turned(df: DataFrame, m: np.ndarray) -> DataFrame:
    """Each row's v times a small matrix."""

    def run(batches):
        for b in batches:
            v = np.array(b.column(2).to_pylist(), float).reshape(b.num_rows, -1) @ m if b.num_rows else np.zeros((0, m.shape[1]))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(list(v), pa.list_(pa.float64()))], ["id", "degree", "v"])

    return df.mapInArrow(run, df.schema)


def features(vectors: DataFrame, kind: str = "ng") -> DataFrame:
    """Rows for k-means: of ng scaled to length 1, of shi divided by the root of the degree, of standard as they are."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    by = norm if kind == "ng" else F.sqrt("degree") if kind == "shi" else F.lit(1.0)
    return vectors.select("id", F.transform("v", lambda x: F.coalesce(F.try_divide(x, by), F.lit(0.0))).alias("v"))


def count_by_gap(edges: DataFrame, kind: str = "ng", first: int = 8, tolerance: float = 1e-3) -> int:
    """The number of clusters: where the sorted eigenvalues' first half has its widest gap, two at least.

    Eigenvalues are found in blocks of twice the size until the gap is sure: all eigenvalues sum to the Laplacian's trace, and those behind a later gap
    are at least as large as the last one found and the gap, which bounds how wide it can be.
    """
    n, degree = degrees(edges).agg(F.count("*"), F.sum("degree")).first()
    half, trace = n // 2, float(degree if kind == "standard" else n) if n else 0.0
    if half < 2:
        return 2
    size = min(first, half)
    while True:
        values = embedding(edges, size, kind, tolerance=tolerance, vectors=False)[1]
        gaps = np.diff(values[:half])
        later = (trace - values.sum() - (n - size) * values[-1]) / (n - half + 1)
        if size >= half or (len(gaps) and later <= gaps.max()):
            return max(2, int(np.argmax(np.round(gaps, 9))) + 1)
        size = min(2 * size, half)


def farthest_first(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k starting centres: the row of least id (of least hashed id, from another seed), then each time the row farthest from all before (the least id of equals)."""
    rows = settled(rows, "features")
    order = [F.xxhash64("id", F.lit(seed)), "id"] if seed else ["id"]
    chosen = [rows.orderBy(*order).first()["v"]]
    while len(chosen) < k:
        near = F.array_min(F.array(*(F.aggregate(F.zip_with("v", F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) for c in chosen)))
        chosen.append(rows.agg(F.max(F.struct(F.round(near, 9).alias("d"), (-F.col("id")).alias("i"), "v"))["v"]).first()[0])
    return rows.sparkSession.createDataFrame(list(enumerate(chosen)), "cluster int, centre array<double>")


def clusters(edges: DataFrame, k: int | None = None, kind: str = "ng", trials: int = 1) -> DataFrame:
    """id, cluster for every node of the graph; ids are whole numbers. Without k it is the one of count_by_gap; of several
    trials, k-means from other starts each, the first of least cost counts."""
    k = count_by_gap(edges, kind) if k is None else k
    if k < 2:
        raise ValueError("at least two clusters")
    found, _ = embedding(edges, k, kind)
    rows = settled(features(found, kind), "features")
    best = None
    for seed in range(trials):
        got = settled(kmeans(rows, farthest_first(rows, k, seed), k, id_col="id", vec="v"), "trial")
        cost = got.agg(F.sum("d2")).first()[0]
        if best is None or cost < best[0] * (1 - 1e-9):
            best = (cost, got)
    return best[1].select("id", "cluster")

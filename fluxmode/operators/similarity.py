"""Neighbours and clusters of vectors, real or complex.

Searches compare a stated query set with all rows: the queries (bounded: their bytes are checked) go to
the tasks as one matrix, each Arrow batch is one matrix product, and only a task's best k per query
leave it.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..plans.staging import settled

#: Bytes of query vectors that go to every task (more are searched in rounds of this size), similarities held at once, pairs compared exactly at once.
MAX_QUERY_BYTES, TILE, PAIRS = 16 << 20, 1 << 19, 1 << 14
#: Vectors of a packed block of k-means, bytes of moments that go to every task (of the largest clusters; the others have plainer bounds).
BLOCK, MAX_MOMENTS = 1 << 12, 32 << 20


def _parts(rows: DataFrame, queries: DataFrame, scan, schema: str, id_col: str, vec: str, *more: str) -> DataFrame:
    """scan(sent queries) over all rows, for parts of the queries that fit MAX_QUERY_BYTES; more parts than one are stored in turn."""
    dim = queries.select(F.max(F.size(vec))).first()[0] or 0
    parts = max(1, -(-queries.count() * dim * 8 // MAX_QUERY_BYTES))
    found = None
    for part in range(parts):
        some = queries.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == part).select(id_col, vec).toArrow().combine_chunks()
        ids = some[id_col].to_numpy()
        asked = _matrix(pa.concat_arrays(some[vec].chunks)) if len(ids) else np.zeros((0, dim))
        sent = rows.sparkSession.sparkContext.broadcast((ids, asked))
        got = rows.select(F.col(id_col).cast("long"), vec, *more).mapInArrow(scan(sent), schema)
        if parts > 1:
            got = settled(got, "searched")
            sent.unpersist()
        found = got if found is None else found.union(got)
    return found


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query, id, rank, similarity of the k most similar other rows; of equals the least id first. A task hands on k rows a query."""
    found = _parts(rows, queries, lambda sent: _best(sent, k, metric), "query long, id long, similarity double", id_col, vec)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "id", "rank", "similarity")


def _similarities(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        normed = lambda z: z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
        return normed(q) @ normed(x).T
    if metric == "mac":  # halves of a vector are its real and imaginary parts
        h = x.shape[1] // 2
        c, d = q[:, :h] + 1j * q[:, h:], x[:, :h] + 1j * x[:, h:]
        return np.abs(c.conj() @ d.T) ** 2 / np.maximum(np.outer(np.square(np.abs(c)).sum(1), np.square(np.abs(d)).sum(1)), 1e-300)
    return -np.sqrt(np.maximum(0, np.square(q).sum(1)[:, None] + np.square(x).sum(1)[None] - 2 * q @ x.T))


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Similarities of pairs, summed in order of the dimensions: equal vectors get equal ones, wherever they stand. A matrix product does not promise that."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        a, b = q[i[at : at + PAIRS]], x[j[at : at + PAIRS]]
        ordered = lambda u, v: sum((u[:, d] * v[:, d] for d in range(u.shape[1])), np.zeros(len(u)))
        if metric == "euclidean":
            got = -np.sqrt(ordered(a - b, a - b))
        elif metric == "cosine":
            got = ordered(a, b) / np.maximum(np.sqrt(ordered(a, a)), 1e-300) / np.maximum(np.sqrt(ordered(b, b)), 1e-300)
        else:
            h = a.shape[1] // 2
            ar, ai, br, bi = a[:, :h], a[:, h:], b[:, :h], b[:, h:]
            re, im = ordered(ar, br) + ordered(ai, bi), ordered(ar, bi) - ordered(ai, br)
            got = (re * re + im * im) / np.maximum((ordered(ar, ar) + ordered(ai, ai)) * (ordered(br, br) + ordered(bi, bi)), 1e-300)
        out[at : at + PAIRS] = got
    return out


def _tiles(sent, batches, metric: str, itself: bool = False):
    """Places of some queries, a batch, its vectors, and their similarities (a row and itself at -inf, unless it counts), at most TILE at once."""
    ids, q = sent.value
    for b in batches:
        x, own = _matrix(b.column(1)), b.column(0).to_numpy()
        step = max(1, TILE // max(1, len(own)))
        for at in range(0, len(ids) if len(own) else 0, step):
            s = _similarities(q[at : at + step], x, metric)
            if not itself:
                s[ids[at : at + step, None] == own[None]] = -np.inf
            yield np.arange(at, at + len(s)), b, x, s


def _slack(q: np.ndarray, x: np.ndarray, metric: str) -> float:
    """How far a matrix product's similarity may be from the exact one; distances near 0 lose half of their digits."""
    return 1e-6 * math.sqrt(max(np.square(q).sum(1).max(initial=0), np.square(x).sum(1).max(initial=0))) if metric == "euclidean" else 1e-11


def _best(sent, k: int, metric: str):
    """The k best of a task's rows for each query."""

    def run(batches):
        ids, q = sent.value
        held, names = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for at, b, x, s in _tiles(sent, batches, metric):
            own, slack = b.column(0).to_numpy(), _slack(q[at], x, metric)
            floor = held[at].min(1) - slack
            if np.count_nonzero(s >= floor[:, None]) > 8 * k * len(at) and s.shape[1] > k:
                floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, -k] - 2 * slack)
            i, j = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
            if not len(i):
                continue
            some, row = np.unique(i, return_inverse=True)  # the queries that may get other rows
            was, col = np.nonzero(held[at[some]] > -np.inf)
            value = np.concatenate((held[at[some]][was, col], _exact(q[at], x, i, j, metric)))
            who, i = np.concatenate((names[at[some]][was, col], own[j])), np.concatenate((was, row))
            order = np.lexsort((who, -value, i))
            i, value, who = i[order], value[order], who[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)  # among the row's best, equals by id
            i, value, who, place = i[place < k], value[place < k], who[place < k], place[place < k]
            held[at[some]] = -np.inf
            held[at[some][i], place], names[at[some][i], place] = value, who
        i, j = np.nonzero(held > -np.inf)
        for at in range(0, len(i), 1 << 16):
            p, c = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(names[p, c]), pa.array(held[p, c])], ["query", "id", "similarity"])

    return run


def best_by_block(rows: DataFrame, queries: DataFrame, least: float, metric: str, id_col: str, vec: str, block: str) -> DataFrame:
    """query, block, id, similarity (12 digits): the most similar row of each block (the least id of equals) for each query, from least on."""
    kinds = dict(rows.dtypes)

    def scan(sent):
        def run(batches):
            ids, q = sent.value
            for at, b, x, s in _tiles(sent, batches, metric, itself=True):
                coded = b.column(2).dictionary_encode("encode")
                code = coded.indices.to_numpy()
                order, slack = np.argsort(code, kind="stable"), _slack(q[at], x, metric)
                first = np.flatnonzero(np.diff(code[order], prepend=-1))
                s = s[:, order]
                top = np.maximum(np.fmax.reduceat(s, first, axis=1) - 2 * slack - 1e-12, least - slack - 1e-12)
                i, j = np.nonzero(s >= np.repeat(top, np.diff(first, append=len(order)), axis=1))
                j = order[j]
                value, who = np.round(_exact(q[at], x, i, j, metric), 12), b.column(0).to_numpy()[j]
                good = value >= least
                i, j, value, who = i[good], j[good], value[good], who[good]
                turn = np.lexsort((who, -value, code[j], i))
                i, j, value, who = i[turn], j[turn], value[turn], who[turn]
                lead = (np.diff(i, prepend=-1) != 0) | (np.diff(code[j], prepend=-1) != 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[i[lead]]]), coded.dictionary.take(pa.array(code[j[lead]])), pa.array(who[lead]), pa.array(value[lead])], ["query", "block", "id", "similarity"])

        return run

    each = _parts(rows, queries, scan, f"query {dict(queries.dtypes)[id_col]}, block {kinds[block]}, id long, similarity double", id_col, vec, block)
    best = each.groupBy("query", "block").agg(F.max(F.struct("similarity", (-F.col("id")).alias("n"))).alias("b"))
    return best.select("query", "block", (-F.col("b.n")).alias("id"), "b.similarity")


def within(rows: DataFrame, queries: DataFrame, floor: float, metric: str = "cosine", id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query, id, similarity of all other rows that are at least floor similar, none left out."""

    def scan(sent):
        def run(batches):
            for at, b, _, s in _tiles(sent, batches, metric):
                i, j = np.nonzero((s >= floor) & (s > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(sent.value[0][at[i]]), pa.array(b.column(0).to_numpy()[j]), pa.array(s[i, j])], ["query", "id", "similarity"])

        return run

    return _parts(rows, queries, scan, "query long, id long, similarity double", id_col, vec)


def reciprocal(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query, id, rank, similarity of the k nearest rows of each query, and back: whether the query is among that row's k nearest.

    The rows found, at most k a query, are searched for in turn; no other row's neighbours matter.
    """
    found = settled(nearest(rows, queries, k, metric, id_col, vec), "neighbours")
    asked = rows.join(found.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
    back = nearest(rows, asked, k, metric, id_col, vec).select(F.col("query").alias("id"), F.col("id").alias("query"), F.lit(True).alias("_back"))
    return found.join(back, ["query", "id"], "left").select("query", "id", "rank", "similarity", F.coalesce("_back", F.lit(False)).alias("back"))


def boosted(neighbours: DataFrame, factor: float = 2.0) -> DataFrame:
    """Similarities of neighbours that have each other (of reciprocal) raised by factor from either end, so by its square."""
    return neighbours.withColumn("similarity", F.col("similarity") * F.when(F.col("back"), factor**2).otherwise(1.0))


def gaussian(similarity_of_distance: Column, sigma: float) -> Column:
    """exp(-d^2 / 2 sigma^2) of a negated distance, as a euclidean search gives it."""
    return F.exp(-similarity_of_distance * similarity_of_distance / (2 * sigma * sigma))


def mutual(neighbours: DataFrame) -> DataFrame:
    """Neighbours that have each other (of reciprocal): query, id."""
    return neighbours.where("back").select("query", "id")


def assign(rows: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The nearest centroid of each row (the least number of equals). centroids: cluster, centre; a few rows, as an array literal."""
    few = centroids.orderBy("cluster").collect()  # k rows
    each = F.array(*(F.struct(vectors.squared_distance(F.col(vec), F.array(*map(F.lit, map(float, r["centre"])))).alias("d"), F.lit(r["cluster"]).alias("cluster")) for r in few))
    best = F.array_min(each)
    return rows.select(id_col, vec, best["cluster"].alias("cluster"), best["d"].alias("d2"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows, without an object a number."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _distances(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each row's nearest centre (the first of equals) and its squared distance: one matrix product."""
    d = np.maximum(0, np.square(x).sum(1)[:, None] - 2 * x @ c.T + np.square(c).sum(1)[None])
    at = d.argmin(1)
    return at, d[np.arange(len(at)), at]


def _nearest_centre(sent):
    """Arrow batches to rows' clusters."""

    def run(batches):
        names, c = sent.value
        for b in batches:
            if b.num_rows:
                at, low = _distances(_matrix(b.column(1)), c)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[at]), pa.array(low)], ["id", "cluster", "d2"])

    return run


def _packed(dim: int):
    """Arrow batches of vectors to blocks: the bytes of up to BLOCK rows in one binary value, in single precision where that loses nothing."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = _matrix(b.column(0).slice(at, BLOCK))
                if x.shape[1] != dim:
                    raise ValueError(f"vectors have {dim} numbers")
                y = x.astype(np.float32)
                same = bool((y == x).all())
                yield pa.RecordBatch.from_arrays([pa.array([same]), pa.array([(y if same else x).tobytes()], pa.binary())], ["single", "x"])

    return run


def _block_sums(c: np.ndarray, dim: int):
    """Blocks of a partition to its members, cost and sums by cluster: one matrix."""

    def run(blocks):
        total = np.zeros((len(c), dim + 2))
        for single, raw in blocks:
            x = np.frombuffer(raw, np.float32 if single else np.float64).reshape(-1, dim).astype(float)
            at, low = _distances(x, c)
            member = (at[None] == np.arange(len(c))[:, None]).astype(float)
            total[:, 0] += member.sum(1)
            total[:, 1] += member @ low
            total[:, 2:] += member @ x
        yield total

    return run


def kmeans(rows: DataFrame, start: DataFrame, dim: int, rounds: int | None = None, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Lloyd rounds from given centroids until the cost no longer falls. A cluster that empties keeps no centroid.

    A round is one pass over blocks of packed vectors that the executors keep (in memory, else on their disks): a job without
    a shuffle, whose tasks add up their blocks; k sums a task reach the driver. The cost falls in each round, so the rounds end
    by themselves; where rounds bounds them and is reached, an error is raised.
    """
    sc, few = rows.sparkSession.sparkContext, start.orderBy("cluster").collect()  # k rows
    slim = settled(rows.select(F.col(id_col).cast("long").alias("id"), vec), "kmeans-rows")
    blocks = slim.select(vec).mapInArrow(_packed(dim), "single boolean, x binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    names, c = np.array([r["cluster"] for r in few], np.int32), np.array([r["centre"] for r in few], float).reshape(len(few), dim)
    cost = None
    for _ in itertools.count() if rounds is None else range(rounds):
        got = sum(blocks.mapPartitions(_block_sums(c, dim)).collect(), np.zeros((len(c), dim + 2)))  # a matrix of k rows a task
        held, now = got[:, 0] > 0, got[:, 1].sum()
        if not held.any() or cost is not None and now >= cost:
            break
        cost, names, c = now, names[held], got[held, 2:] / got[held, :1]
    else:
        blocks.unpersist()
        raise RuntimeError("k-means did not settle")
    blocks.unpersist()
    return slim.mapInArrow(_nearest_centre(sc.broadcast((names, c))), "id long, cluster int, d2 double").withColumnRenamed("id", id_col)


def medoids(rows: DataFrame, cluster: str = "label", id_col: str = "vec_id", vec: str = "embedding", metric: str = "euclidean", batch: int = 32) -> DataFrame:
    """The member of least summed distance to its cluster (the least id of equals), and that sum: cluster, medoid, cost.

    Distances are euclidean, cosine (1 - cosine) or mac (1 - MAC; halves of a vector are its real and imaginary
    parts). Sums of the last two follow from one sum a cluster: of unit vectors, or of their outer products. For
    euclidean ones, one pass gives each member a lower bound of its sum (n |x - mean|, and in large clusters one from moments
    to the third); those whose bound exceeds the least of `batch` sums are out, and all others' sums are taken. Equal to
    6 digits counts as equal then.
    """
    slim = rows.select(F.col(cluster).alias("c"), F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"))
    if metric == "euclidean":
        return _euclidean_medoids(slim, batch).select(F.col("c").alias(cluster), F.col("id").alias("medoid"), "cost")
    dim, slim = rows.select(F.max(F.size(vec))).first()[0] or 0, slim.withColumn("v", F.col("v").cast("array<double>"))
    unit = slim.withColumn("u", F.transform("v", lambda x: F.coalesce(F.try_divide(x, F.sqrt(vectors.norm2(F.col("v")))), F.lit(0.0))))
    sent = None
    if metric == "cosine":
        sums = unit.groupBy("c").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("u", F.lit(i))) for i in range(dim))).alias("s"))
        cost = F.col("n") - vectors.dot(F.col("u"), F.col("s"))
        scored = unit.join(sums, "c").select("c", "id", cost.alias("cost"))
    else:
        parts = unit.select("c", "u").mapInArrow(_outer_sums, f"c {dict(unit.dtypes)['c']}, n long, s array<double>")
        cells = parts.select("c", "n", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        each = cells.groupBy("c").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("s")).collect()  # a row a cluster
        sent = rows.sparkSession.sparkContext.broadcast({r["c"]: (r["n"], np.array(r["s"])) for r in each})

        def score(batches):
            for b in batches:
                out = []
                for c, u in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    (n, s), z, h = sent.value[c], np.array(u), len(u) // 2
                    z, g = z[:h] + 1j * z[h:], (s[: h * h] + 1j * s[h * h :]).reshape(h, h)
                    out.append(float(n - (z.conj() @ g @ z).real))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["c", "id", "cost"])

        scored = unit.select("c", "id", "u").mapInArrow(score, f"c {dict(unit.dtypes)['c']}, id long, cost double")
    best = F.min(F.struct(F.round("cost", 9).alias("r"), "id", "cost")).alias("b")
    return scored.groupBy("c").agg(best).select(F.col("c").alias(cluster), F.col("b.id").alias("medoid"), "b.cost")


def _outer_sums(batches):
    """Each batch's members and sum of outer products by cluster: real parts, then imaginary ones."""
    for b in batches:
        keys = b.column(0).to_pylist()
        u = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
        z = u[:, : u.shape[1] // 2] + 1j * u[:, u.shape[1] // 2 :]
        names = sorted(set(keys), key=repr)
        own = [np.array([k == c for k in keys]) for c in names]
        g = [z[m].T @ z[m].conj() for m in own]
        yield pa.RecordBatch.from_arrays([pa.array(names, b.column(0).type), pa.array([int(m.sum()) for m in own]), pa.array([np.concatenate((x.real.ravel(), x.imag.ravel())) for x in g], pa.list_(pa.float64()))], ["c", "n", "s"])


def _euclidean_medoids(slim: DataFrame, batch: int) -> DataFrame:
    """c, id, cost. slim: c, id, v."""
    sc, kind = slim.sparkSession.sparkContext, dict(slim.dtypes)["c"]
    slim = settled(slim, "medoid-rows")
    dim = slim.select(F.max(F.size("v"))).first()[0] or 0
    means = slim.groupBy("c").agg(F.count("*").alias("n"), F.array(*(F.avg(F.get("v", F.lit(i))) for i in range(dim))).alias("m")).collect()  # a row a cluster
    most = MAX_MOMENTS // (8 * (4 + 3 * dim + 2 * dim**2 + dim**2 * (dim + 1) // 2))
    large = {r["c"] for r in sorted(means, key=lambda r: -r["n"])[:most] if r["n"] > dim**2}
    given = sc.broadcast(({r["c"]: (r["n"], np.array(r["m"], float)) for r in means}, large))
    kinds = f"c {kind}, part int, top double, x array<double>"
    sums: dict = {}
    for r in slim.mapInArrow(_moments(given), kinds).groupBy("c", "part").applyInArrow(_added, kinds).orderBy("part").toArrow().to_batches():  # MAX_MOMENTS at most, and a row a cluster
        for c, top, x in zip(r["c"].to_pylist(), r["top"].to_pylist(), r["x"], strict=True):
            sums.setdefault(c, [top, []])[1].append(x.values.to_numpy())
    slack = {r["c"]: 1e-6 * r["n"] * math.sqrt(sums[r["c"]][0]) for r in means}  # how far a sum of distances by matrix products may be from the true one
    known = sc.broadcast({c: (top, np.concatenate(x)) for c, (top, x) in sums.items()})
    state = settled(slim.mapInArrow(_bounds(given, known), f"c {kind}, id long, v {dict(slim.dtypes)['v']}, low double"), "medoid-bounds")

    def least(costs: DataFrame) -> dict:
        return {r["c"]: r["x"] for r in costs.groupBy("c").agg(F.min("cost").alias("x")).collect()}  # a row a cluster

    first = state.groupBy("c", F.pmod(F.xxhash64("id"), F.lit(batch))).agg(F.min(F.struct("low", "id", "v")).alias("b")).select("c", "b.id", "b.v")
    best = least(_summed(slim, first, given))
    costs = _summed(slim, state.mapInArrow(_not_above(sc.broadcast({c: x + 2 * slack[c] for c, x in best.items()})), state.schema), given)
    last = costs.mapInArrow(_not_above(sc.broadcast({c: x + 2 * slack[c] for c, x in least(costs).items()})), costs.schema)
    sure = F.min(F.struct(F.round("cost", 6).alias("r"), "id", "cost")).alias("b")
    return _summed(slim, last, given, exact=True).groupBy("c").agg(sure).select("c", "b.id", "b.cost")


def _members(b: pa.RecordBatch):
    """The clusters (first column) of a batch, each with its rows' places and vectors (third column)."""
    coded, x = b.column(0).dictionary_encode("encode"), _matrix(b.column(2))
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    for k, c in enumerate(coded.dictionary.to_pylist()):
        own = order[ends[k] : ends[k + 1]]
        yield c, own, x[own]


def _pairs(x: np.ndarray) -> np.ndarray:
    """Products of two numbers of each row, each two once."""
    i, j = np.triu_indices(x.shape[1])
    return x[:, i] * x[:, j]


def _moments(given):
    """Batches to each cluster's greatest squared norm and, of the large ones, moments to the third, about the mean, in parts."""

    def run(batches):
        total, top, kept = {}, {}, None
        for b in batches:
            kept = b.schema.field(0).type
            for c, _, x in _members(b):
                (_, mean), large = given.value[0][c], c in given.value[1]
                total.setdefault(c, np.zeros(1))
                for at in range(0, len(x), 512):
                    u = x[at : at + 512] - mean
                    a = np.square(u).sum(1)
                    top[c] = max(top.get(c, 0.0), float(a.max()))
                    if large:
                        each = [[len(u), a.sum(), (a * a).sum(), (a**3).sum()], u.sum(0), a @ u, (a * a) @ u, u.T @ u, (u * a[:, None]).T @ u, _pairs(u).T @ u]
                        total[c] = total[c] + np.concatenate([np.ravel(e) for e in each])
        for c, x in total.items():
            for k, at in enumerate(range(0, len(x), 1 << 14)):
                yield pa.RecordBatch.from_arrays([pa.array([c], kept), pa.array([k], pa.int32()), pa.array([top[c]]), pa.array([x[at : at + (1 << 14)]], pa.list_(pa.float64()))], ["c", "part", "top", "x"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    """One part of a cluster's moments, summed over tasks: a row a task."""
    x = sum(v.values.to_numpy() for v in rows["x"])
    return pa.Table.from_arrays([rows["c"].slice(0, 1), rows["part"].slice(0, 1), pa.array([max(rows["top"].to_pylist())]), pa.array([x], pa.list_(pa.float64()))], ["c", "part", "top", "x"])


def _bounds(given, known):
    """Batches with a lower bound of each row's summed distance to its cluster."""

    def run(batches):
        for b in batches:
            low = np.zeros(b.num_rows)
            for c, own, x in _members(b):
                (n, mean), (top, sums) = given.value[0][c], known.value[c]
                for at in range(0, len(own), 512):
                    u = x[at : at + 512] - mean
                    low[own[at : at + 512]] = np.fmax(n * np.sqrt(np.square(u).sum(1)), _least_sum(u, top, sums) if len(sums) > 1 else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(low)], ["c", "id", "v", "low"])

    return run


def _least_sum(u: np.ndarray, top: float, sums: np.ndarray) -> np.ndarray:
    """A lower bound of each row's summed distance to all rows of which sums are the moments, and top the greatest squared norm.

    The sums over all rows of s, s^2 and s^3 (s: the squared distance) follow from the moments. With m the mean of s,
    sqrt s = sqrt m + (s - m) / 2 sqrt m - (s - m)^2 h(s) / 2 sqrt m, where h(s) = 1 / (sqrt s + sqrt m)^2 is convex: on [0, the
    greatest s] it is at most its chord, which leaves a cubic in s. What rounding may have lost is taken off.
    """
    d = u.shape[1]
    (n, a1, a2, a3), (s0, s1, s2), (c0, c1), t = sums[:4], sums[4 : 4 + 3 * d].reshape(3, d), sums[4 + 3 * d : 4 + 3 * d + 2 * d * d].reshape(2, d, d), sums[4 + 3 * d + 2 * d * d :].reshape(-1, d)
    a = np.square(u).sum(1)
    q0, q1, q2, r0, r1 = u @ s0, u @ s1, u @ s2, ((u @ c0) * u).sum(1), ((u @ c1) * u).sum(1)
    i, j = np.triu_indices(d)
    cubes = (((_pairs(u) * np.where(i == j, 1.0, 2.0)) @ t) * u).sum(1)
    m = np.maximum((n * a + a1 - 2 * q0) / n, 1e-300)
    second = [n * a * a + 2 * a * a1 + a2, -4 * (a * q0 + q1), 4 * r0, -n * m * m]  # about m
    plain = [*second[:3]]
    third = [n * a**3 + 3 * a * a * a1 + 3 * a * a2 + a3, -6 * (a * a * q0 + 2 * a * q1 + q2), 12 * (a * r0 + r1), -8 * cubes, -3 * m * sum(plain), 2 * n * m**3]
    lost = lambda terms: 1e-11 * sum(np.abs(e) for e in terms)
    high = np.maximum((np.sqrt(a) + math.sqrt(top)) ** 2, 1e-300)
    root = np.sqrt(m)
    t2, t3 = sum(second) + lost(second), sum(third) - m * lost(plain) * 3 - lost(third)
    with np.errstate(all="ignore"):  # rows all alike have no bound
        slope = (1 / (np.sqrt(high) + root) ** 2 - 1 / m) / high
        got = n * root * (1 - 1e-11) - (t2 / m + slope * (t3 + m * t2)) / (2 * root)
    return np.where(np.isfinite(got), got, 0.0)


def _not_above(most):
    """Rows whose last column is at most their cluster's number."""

    def run(batches):
        for b in batches:
            coded = b.column(0).dictionary_encode("encode")
            each = np.array([most.value[c] for c in coded.dictionary.to_pylist()], float)
            yield b.filter(pa.array(b.column(b.num_columns - 1).to_numpy() <= each[coded.indices.to_numpy()]))

    return run


def _summed(slim: DataFrame, some: DataFrame, given, exact: bool = False) -> DataFrame:
    """c, id, v, cost: each vector of some (copies once, by the least id) with its summed distance to the rows of its cluster.

    For parts of them that fit MAX_QUERY_BYTES, in turn. By matrix products of vectors less their mean, or exact: by differences, dimension by dimension.
    """
    each = some.groupBy("c", "v").agg(F.min("id").alias("id"))
    some = settled(each.select("c", F.monotonically_increasing_id().alias("k"), "v", "id"), "medoid-tried")
    size = some.agg(F.sum(F.size("v"))).first()[0] or 0
    parts, found = max(1, -(-size * 8 // MAX_QUERY_BYTES)), None
    for part in range(parts):
        asked: dict = {}
        for b in some.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == part).toArrow().to_batches():
            for c, own, x in _members(b):
                asked.setdefault(c, []).append((b.column(1).to_numpy()[own], x))
        sent = slim.sparkSession.sparkContext.broadcast({c: tuple(map(np.concatenate, zip(*e, strict=True))) for c, e in asked.items()})
        got = settled(slim.mapInArrow(_sums_to(sent, given, exact), "k long, cost double").groupBy("k").agg(F.sum("cost").alias("cost")), "medoid-sums")
        sent.unpersist()
        found = got if found is None else found.union(got)
    return some.join(found, "k").select("c", "id", "v", "cost")


def _sums_to(sent, given, exact: bool):
    """Batches to the sums of distances from each vector sent to the task's rows of its cluster."""

    def run(batches):
        total: dict = {}
        for b in batches:
            for c, _, x in _members(b):
                if c not in sent.value:
                    continue
                q, mean = sent.value[c][1], given.value[0][c][1]
                sums = total.setdefault(c, np.zeros(len(q)))
                if exact:
                    for k in range(len(q)):
                        sums[k] -= _exact(q[k : k + 1], x, np.zeros(len(x), int), np.arange(len(x)), "euclidean").sum()
                    continue
                x = x - mean
                step, xx, turned = max(1, TILE // len(x)), np.square(x).sum(1), -2 * x.T
                for at in range(0, len(q), step):
                    u = q[at : at + step] - mean
                    s = u @ turned
                    s += xx
                    s += np.square(u).sum(1)[:, None]
                    np.sqrt(np.maximum(s, 0, out=s), out=s)
                    sums[at : at + step] += s.sum(1)
        for c, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[c][0]), pa.array(sums)], ["k", "cost"])

    return run


def trimmed(modes: DataFrame, medoid_ids: DataFrame, threshold: float) -> DataFrame:
    """label 0 for modes whose MAC with their cluster's medoid is below the threshold. modes: vec_id, label, re, im."""
    m = medoid_ids.join(modes.select(F.col("vec_id").alias("medoid"), F.col("re").alias("mr"), F.col("im").alias("mi")), "medoid").select("label", "mr", "mi")
    value = vectors.mac(F.col("re"), F.col("im"), F.col("mr"), F.col("mi"))
    return modes.join(m, "label", "left").select("vec_id", "label", value.alias("mac"), F.when(value >= threshold, F.col("label")).otherwise(0).alias("trimmed"))


def eigengap(values: DataFrame, *keys: str) -> DataFrame:
    """The number of clusters: place of the greatest gap in the first half of sorted eigenvalues, 2 at least. values: keys, value."""
    w = Window.partitionBy(*keys).orderBy("value")
    gaps = values.withColumn("_r", F.row_number().over(w)).withColumn("_g", F.lead("value").over(w) - F.col("value")).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    best = F.max(F.struct(F.col("_g"), -F.col("_r")))
    return gaps.where(F.col("_r") <= F.floor(F.col("_n") / 2)).groupBy(*keys).agg(F.greatest(F.lit(2), -best["col2"]).cast("long").alias("clusters"))

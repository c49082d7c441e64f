"""Queries over vectors: searches, clusters and modal assurance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import modes, similarity
from ..sources import standins as S
from .signal_queries import query, r

#: Searches take as queries the rows whose id is divisible by this, against all rows.
QUERY_STEP, K = 100, 10
_DOT = "list_sum(list_transform(range(1, 65), lambda j: CAST({a}.embedding[j] AS DOUBLE) * {b}.embedding[j]))"
_KNN = """SELECT query, id, CAST(rank AS INTEGER) AS rank, round(similarity, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM (
SELECT q.vec_id AS query, x.vec_id AS id, {s} AS similarity FROM embeddings q JOIN embeddings x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id)) WHERE rank <= 10"""
_D2 = "list_sum(list_transform(range(1, 65), lambda j: pow(CAST({a}.embedding[j] AS DOUBLE) - {b}.embedding[j], 2)))"


def _search(spark, d, metric):
    rows = S.table(spark, d, "embeddings")
    found = similarity.nearest(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0), K, metric)
    return found.select("query", "id", "rank", r("similarity", 5).alias("similarity"))


@query(_KNN.format(s=_DOT.format(a="q", b="x") + " / sqrt(" + _DOT.format(a="q", b="q") + ") / sqrt(" + _DOT.format(a="x", b="x") + ")"))
def knn_cosine(spark, d):
    return _search(spark, d, "cosine")


@query(_KNN.format(s="-sqrt(" + _D2.format(a="q", b="x") + ")"))
def knn_euclidean(spark, d):
    return _search(spark, d, "euclidean")


def _pair(a: str, b: str, first: str, second: str) -> str:
    return f"list_sum(list_transform(range(1, 33), lambda j: CAST({a}.embedding[j + {first}] AS DOUBLE) * {b}.embedding[j + {second}]))"


_MAC = f"(pow({_pair('q', 'x', '0', '0')} + {_pair('q', 'x', '32', '32')}, 2) + pow({_pair('q', 'x', '0', '32')} - {_pair('q', 'x', '32', '0')}, 2)) / ({_DOT.format(a='q', b='q')} * {_DOT.format(a='x', b='x')})"


@query(_KNN.format(s=_MAC))
def knn_mac(spark, d):
    return _search(spark, d, "mac")


_COSINE = _DOT.format(a="q", b="x") + " / sqrt(" + _DOT.format(a="q", b="q") + ") / sqrt(" + _DOT.format(a="x", b="x") + ")"
_ALL_KNN = "WITH k AS (" + _KNN.format(s=_COSINE).replace("q.vec_id % 100 = 0 AND ", "").replace("round(similarity, 5) AS similarity", "similarity") + ")"


def reciprocal(spark, d):
    rows = S.table(spark, d, "embeddings")
    return similarity.reciprocal(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0), K)


@query(_ALL_KNN + " SELECT a.query, a.id FROM k a JOIN k b ON a.query = b.id AND a.id = b.query WHERE a.query % 100 = 0")
def mutual_knn(spark, d):
    """Neighbours that have each other: the stated query set against all rows."""
    return similarity.mutual(reciprocal(spark, d))


_START = "s AS (SELECT label AS cluster, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)"
_ASSIGN = f"WITH {_START}, a AS (SELECT x.vec_id, x.label, x.embedding, arg_min(s.cluster, ({_D2.format(a='x', b='s')}, s.cluster)) AS cluster, min({_D2.format(a='x', b='s')}) AS d2 FROM embeddings x CROSS JOIN s GROUP BY ALL)\n"


def _start(rows):
    first = F.min(F.struct("vec_id", "embedding")).alias("b")
    return rows.groupBy(F.col("label").alias("cluster")).agg(first).select("cluster", F.col("b.embedding").cast("array<double>").alias("centre"))


@query(_ASSIGN + "SELECT vec_id, cluster, round(d2, 5) AS d2 FROM a")
def kmeans_assign_step(spark, d):
    rows = S.table(spark, d, "embeddings")
    return similarity.assign(rows, _start(rows)).select("vec_id", "cluster", r("d2", 5).alias("d2"))


#: Rounds of assignment and means, each from the centres of the one before, while the cost falls.
_LLOYD = f"""WITH RECURSIVE {_START}, x AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings),
l(n, cost, cs) AS (SELECT 0, CAST('inf' AS DOUBLE), (SELECT list({{'c': cluster, 'v': CAST(embedding AS DOUBLE[64])}} ORDER BY cluster) FROM s)
UNION ALL SELECT n + 1, now, cs FROM (SELECT n, was, sum(part) AS now, list({{'c': c, 'v': CAST(mean AS DOUBLE[64])}} ORDER BY c) AS cs FROM (
SELECT n, was, c, sum(d2) AS part, [{", ".join(f"avg(v[{j}])" for j in range(1, 65))}] AS mean FROM (
SELECT n, was, vec_id, v, arg_min(c, (d2, c)) AS c, min(d2) AS d2 FROM (SELECT l.n, l.cost AS was, x.vec_id, x.v, o.c.c AS c, pow(array_distance(x.v, o.c.v), 2) AS d2 FROM l, unnest(l.cs) AS o(c), x) GROUP BY n, was, vec_id, v) GROUP BY n, was, c) GROUP BY n, was) WHERE now < was)
"""


@query(_LLOYD + "SELECT vec_id, CAST(arg_min(c, (d2, c)) AS INTEGER) AS cluster, round(min(d2), 4) AS d2 FROM (SELECT x.vec_id, o.c.c AS c, pow(array_distance(x.v, o.c.v), 2) AS d2 FROM (SELECT cs FROM l ORDER BY n DESC LIMIT 1) k, unnest(k.cs) AS o(c), x) GROUP BY 1")
def kmeans_lloyd(spark, d):
    rows = S.table(spark, d, "embeddings")
    return similarity.kmeans(rows, _start(rows), 64).select("vec_id", "cluster", r("d2", 4).alias("d2"))


_MEDOID = "SELECT label, arg_min(vec_id, (round(c, 6), vec_id)) AS medoid, round(min(c), 4) AS cost FROM (SELECT x.label, x.vec_id, sum({}) AS c FROM embeddings x JOIN embeddings y USING (label) GROUP BY 1, 2) GROUP BY 1"
_UNIT = "({} / sqrt({}) / sqrt({}))".format(*(_DOT.format(a=a, b=b) for a, b in (("x", "y"), ("x", "x"), ("y", "y"))))
_MAC_XY = "(pow({} + {}, 2) + pow({} - {}, 2)) / ({} * {})".format(*(_pair("x", "y", i, j) for i, j in (("0", "0"), ("32", "32"), ("0", "32"), ("32", "0"))), _DOT.format(a="x", b="x"), _DOT.format(a="y", b="y"))


@query(_MEDOID.format("sqrt(" + _D2.format(a="x", b="y") + ")"))
def medoids(spark, d):
    return similarity.medoids(S.table(spark, d, "embeddings")).select("label", "medoid", r("cost", 4).alias("cost"))


@query(_MEDOID.format("1 - " + _UNIT))
def medoids_cosine(spark, d):
    return similarity.medoids(S.table(spark, d, "embeddings"), metric="cosine").select("label", "medoid", r("cost", 4).alias("cost"))


@query(_MEDOID.format("1 - " + _MAC_XY))
def medoids_mac(spark, d):
    return similarity.medoids(S.table(spark, d, "embeddings"), metric="mac").select("label", "medoid", r("cost", 4).alias("cost"))


@query(f"WITH m AS ({_MEDOID.format('1 - ' + _MAC_XY)}), p AS (SELECT x.vec_id, x.label, {_MAC} AS mac FROM m JOIN embeddings q ON q.vec_id = m.medoid JOIN embeddings x ON x.label = m.label) SELECT vec_id, round(mac, 5) AS mac, CASE WHEN round(mac, 9) >= 0.05 THEN label ELSE 0 END AS trimmed FROM p")
def trim_cluster(spark, d):
    return similarity.trimmed(S.modes(spark, d), medoids_mac(spark, d).select("label", "medoid"), 0.05).select("vec_id", r("mac", 5).alias("mac"), F.col("trimmed").cast("int").alias("trimmed"))


@query("SELECT label, CAST(greatest(2, arg_max(k, (g, -k))) AS BIGINT) AS clusters FROM (SELECT label, row_number() OVER w AS k, lead(v) OVER w - v AS g, count(*) OVER (PARTITION BY label) AS n FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY v)) WHERE k <= n // 2 GROUP BY 1")
def eigengap(spark, d):
    v = S.table(spark, d, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("value"))
    return similarity.eigengap(v, "label")


_SHAPE = "sh AS (SELECT vec_id, j, j * 0.7 AS x, j * 0.3 AS y, CAST(embedding[j + 1] AS DOUBLE) AS re, CAST(embedding[j + 33] AS DOUBLE) AS im FROM embeddings CROSS JOIN (SELECT unnest(range(32)) AS j))"


@query(f"WITH {_SHAPE}, h AS (SELECT vec_id, m, n, (pow(sum(re * cos(p) + im * sin(p)), 2) + pow(sum(im * cos(p) - re * sin(p)), 2)) / (sum(re * re + im * im) * count(*)) AS mac FROM (SELECT *, m * x + n * y AS p FROM sh CROSS JOIN (SELECT unnest(range(-2, 3)) AS m) CROSS JOIN (SELECT unnest(range(-2, 3)) AS n)) GROUP BY 1, 2, 3)\nSELECT vec_id, CAST(m AS INTEGER) AS m, CAST(n AS INTEGER) AS n, round(mac, 6) AS mac FROM h")
def mn_harmonic_fit(spark, d):
    e = S.table(spark, d, "embeddings")
    z = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.struct((j * 0.7).alias("x"), (j * 0.3).alias("y"), F.get("embedding", j).cast("double").alias("re"), F.get("embedding", j + 32).cast("double").alias("im")))
    return modes.harmonic_mac(e.select("vec_id", F.explode(z).alias("z")).select("vec_id", "z.*"), 2, 2, "vec_id").select("vec_id", "m", "n", r("mac").alias("mac"))


@query("SELECT vec_id, round(max(m), 6) AS top, round(sqrt(sum(m * m)), 6) AS norm FROM (SELECT vec_id, sqrt(pow(CAST(embedding[j] AS DOUBLE), 2) + pow(CAST(embedding[j + 32] AS DOUBLE), 2)) AS m FROM embeddings CROSS JOIN (SELECT unnest(range(1, 33)) AS j)) GROUP BY 1")
def shape_magnitudes(spark, d):
    m = S.modes(spark, d).withColumn("z", F.zip_with("re", "im", lambda a, b: F.sqrt(a.cast("double") * a + b.cast("double") * b)))
    return m.select("vec_id", r(F.array_max("z")).alias("top"), r(F.sqrt(vectors.norm2(F.col("z")))).alias("norm"))

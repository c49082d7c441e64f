"""Queries over prototypes, cross-spectral modes, covariances, profiles and resampled signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars, vectors
from ..operators import frames, modes, params, scoring, spectral_clusters, sysid
from ..sources import examples
from ..sources import standins as S
from .grid_queries import ANGLES, _P, _p, _probes, _sensors
from .signal_queries import query, r
from .vector_queries import _DOT, _MAC, _pair


@query("""WITH z AS (SELECT user_id % 8 AS g, value AS x FROM events), q AS (SELECT g, greatest(x, m) AS x FROM z JOIN (SELECT g, median(x) AS m FROM z GROUP BY 1) USING (g)),
e AS (SELECT g, min(x) AS low, max(x) AS high, count(*) AS n FROM q GROUP BY 1), u AS (SELECT g, (x - low) / (high - low) * 100 AS u FROM q JOIN e USING (g)),
p AS (SELECT g, c, c * 100.0 / 99 AS place FROM e CROSS JOIN (SELECT unnest(range(100)) AS c)),
s AS (SELECT p.g, c, place, count(*) FILTER (u <= place + 1e-12) AS r, max(u) FILTER (u <= place + 1e-12) AS a, min(u) FILTER (u > place + 1e-12) AS z FROM p JOIN u USING (g) GROUP BY ALL),
y AS (SELECT s.*, low, high, (r - 1 + CASE WHEN z IS NULL THEN 0 ELSE (place - a) / (z - a) END) / (n - 1) * 200 AS y FROM s JOIN e USING (g)),
d AS (SELECT *, round(abs(y - first_value(y) OVER w - (last_value(y) OVER w - first_value(y) OVER w) / 100 * place), 9) AS d FROM y WINDOW w AS (PARTITION BY g ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT g, round(arg_max(place, (d, -c)) / 100 * (high - low) + low, 6) AS threshold FROM d GROUP BY g, low, high""")
def cdf_threshold(spark, d):
    z = S.table(spark, d, "events").select((F.col("user_id") % 8).alias("g"), F.col("value").alias("x"))
    return params.cdf_threshold(z, "g").select("g", r("threshold").alias("threshold"))


@query(""", s AS (SELECT channel, i / 720.0 * 0.6 AS rr, x, i / 720.0 AS rho FROM hourly), n AS (SELECT *, rr - lag(rr) OVER w AS hb, lead(rr) OVER w - rr AS ha, lag(x) OVER w AS xb, lead(x) OVER w AS xa FROM s WINDOW w AS (PARTITION BY channel ORDER BY rho)),
g AS (SELECT *, CASE WHEN hb IS NULL THEN (xa - x) / ha WHEN ha IS NULL THEN (x - xb) / hb ELSE (hb * hb * xa + (ha * ha - hb * hb) * x - ha * ha * xb) / (hb * ha * (ha + hb)) END AS sl FROM n),
k AS (SELECT *, lead(rho) OVER w AS rho1, lead(x) OVER w AS x1, lead(sl) OVER w AS sl1 FROM g WINDOW w AS (PARTITION BY channel ORDER BY rho)),
v AS (SELECT channel, x + (0.47 - rho) / (rho1 - rho) * (x1 - x) AS f, sl + (0.47 - rho) / (rho1 - rho) * (sl1 - sl) AS sl FROM k WHERE rho <= 0.47 AND 0.47 < rho1)
SELECT channel, round(f, 4) AS value, round(sl, 3) AS slope, round(-f / sl, 6) AS length FROM v""", "hourly")
def gradient_scale_length(spark, d):
    h = S.hourly(spark, d).select("channel", (F.col("i") / 720.0).alias("rho"), "x")
    return frames.scale_length(h, 0.47, 0.6, "channel").select("channel", r("value", 4).alias("value"), r("slope", 3).alias("slope"), r("length").alias("length"))


@query(""", k AS (SELECT k, (CASE WHEN k = 0 THEN 0.25 ELSE sin(pi() * k / 4) / (pi() * k) END) * (0.54 + 0.46 * cos(pi() * k / 40)) AS w FROM (SELECT unnest(range(-40, 41)) AS k))
SELECT f, m, round(sum(w * v) / sum(w), 4) AS y FROM (SELECT unnest(range(180)) AS m) CROSS JOIN k JOIN grid ON t = m * 4 + k GROUP BY 1, 2""", "grid")
def decimate(spark, d):
    return frames.decimated(S.grid(spark, d).select("f", F.col("t").alias("i"), F.col("v").alias("x")), 4, keys=("f",)).select("f", "m", r("y", 4).alias("y"))


@query(None)
def noise_added(spark, d):
    return frames.noisy(S.signal(spark, d), 0.1, 7, "channel").select("channel", "i", "x", "y")


@query(f"SELECT source, round(avg(0.7 * (-(CASE WHEN quality = 1 THEN 0.25 ELSE 0.75 END) * pow(1 - pt, 2) * ln(pt)) + 0.3 * -((quality * 0.9 + 0.1) * ln(p) + (1 - (quality * 0.9 + 0.1)) * ln(1 - p))), 6) AS loss FROM (SELECT *, CASE WHEN quality = 1 THEN p ELSE 1 - p END AS pt FROM (SELECT *, {_P} AS p FROM pairs)) GROUP BY 1", "pairs")
def combined_loss(spark, d):
    y = F.col("quality")
    loss = scalars.combined_loss([scalars.focal_loss(_p(), y), scalars.smoothed_cross_entropy(_p(), y, 0.1)], [0.7, 0.3])
    return S.pairs(spark, d).groupBy("source").agg(r(F.avg(loss)).alias("loss"))


_QUERIES = [(100.0, 20.0), (50000.0, 80.0), (400000.0, 10.0)]


@query("WITH q AS (SELECT * FROM (VALUES (0, 100.0, 20.0), (1, 50000.0, 80.0), (2, 400000.0, 10.0)) v(query, t0, f0)), p AS (SELECT event_id AS id, epoch_us(ts) / 1000000.0 - 1704067200 AS time, value AS frequency FROM events), d AS (SELECT query, id, time, frequency, sqrt(pow(time - t0, 2) + pow(frequency - f0, 2)) AS distance FROM q CROSS JOIN p) SELECT query, arg_min(id, (distance, time, frequency, id)) AS id, round(min(distance), 4) AS distance, min(distance) > 5 AS far FROM d GROUP BY 1")
def prototypes(spark, d):
    """The record nearest to each asked time and frequency; events stand for poles."""
    poles = S.table(spark, d, "events").select("event_id", (F.unix_micros("ts") / 1e6 - S.EPOCH).alias("time"), F.col("value").alias("frequency"))
    return modes.prototypes(poles.withColumnRenamed("event_id", "id"), _QUERIES).select("query", "id", r("distance", 4).alias("distance"), "far")


@query(f"SELECT reference, block, id, round(mac, 6) AS mac FROM (SELECT q.vec_id AS reference, x.label AS block, x.vec_id AS id, round({_MAC}, 12) AS mac, row_number() OVER (PARTITION BY q.vec_id, x.label ORDER BY round({_MAC}, 12) DESC, x.vec_id) AS n FROM embeddings q JOIN embeddings x ON q.vec_id % 100 = 0 AND {_MAC} >= 0.05) WHERE n = 1")
def reference_matches(spark, d):
    shapes = S.modes(spark, d)
    found = modes.traces(shapes.select(F.col("label").alias("block"), F.col("vec_id").alias("id"), "re", "im"), shapes.where("vec_id % 100 = 0").select(F.col("vec_id").alias("reference"), "re", "im"), 0.05)
    return found.select("reference", "block", "id", r("mac").alias("mac"))


_C = _DOT.format(a="q", b="q")


@query(f"WITH q AS (SELECT label, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) SELECT x.vec_id, round(({_pair('q', 'x', '0', '0')} + {_pair('q', 'x', '32', '32')}) / {_C}, 6) + 0.0 AS re, round(({_pair('q', 'x', '0', '32')} - {_pair('q', 'x', '32', '0')}) / {_C}, 6) + 0.0 AS im FROM embeddings x JOIN q USING (label)")
def scalar_fit(spark, d):
    """Each shape as a complex multiple of its label's first one."""
    m = S.modes(spark, d)
    first = m.groupBy("label").agg(F.min(F.struct("vec_id", "re", "im")).alias("b")).select("label", F.col("b.re").alias("br"), F.col("b.im").alias("bi"))
    re, im = vectors.scalar_fit(F.col("re"), F.col("im"), F.col("br"), F.col("bi"))
    return m.join(first, "label").select("vec_id", r(re).alias("re"), r(im).alias("im"))


@query(None)
def csm_modes(spark, d):
    return modes.csm_modes(_probes(spark, d), ANGLES, range(-5, 6), 4)


@query(None)
def cca_poles(spark, d):
    return sysid.canonical_poles(_sensors(spark, d), 6, 6, 4, 1.0)


@query(""", w AS (SELECT user_id % 6 AS c, CAST(floor((epoch_us(ts) // 1000000 - 1704067200) / 3600) AS BIGINT) AS i, sum(value) AS x FROM events GROUP BY ALL), rows_ AS (SELECT DISTINCT i FROM w),
last_ AS (SELECT max(i) AS last FROM rows_), b AS (SELECT unnest(range(0, (last - 239) // 120 + 1)) AS block FROM last_),
y AS (SELECT block, c, coalesce(x, 0) AS x, row_number() OVER (PARTITION BY block, c ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY block, c) AS n FROM b JOIN rows_ ON i BETWEEN block * 120 AND block * 120 + 239 CROSS JOIN (SELECT unnest(range(6)) AS c) LEFT JOIN w USING (i, c)),
k AS (SELECT fold, block, c, var_pop(x) AS v FROM y CROSS JOIN (SELECT unnest(range(5)) AS fold) WHERE NOT (j >= round_even(fold * n / 5.0, 0) AND j < round_even((fold + 1) * n / 5.0, 0)) GROUP BY ALL)
SELECT block, CAST(fold AS INTEGER) AS fold, round(sum(v), 2) AS trace FROM k GROUP BY 1, 2""".replace(", w AS", "WITH w AS", 1))
def fold_traces(spark, d):
    return sysid.fold_covariances(_sensors(spark, d), 5).select("block", "fold", r("trace", 2).alias("trace"))


@query(None)
def fold_covariances(spark, d):
    return sysid.fold_covariances(_sensors(spark, d), 5)


@query(None)
def projected_poles(spark, d):
    return sysid.projected_poles(_sensors(spark, d), 4, 2, 3, 1.0)


@query(None)
def component_spectra(spark, d):
    return sysid.component_spectra(_sensors(spark, d), 2)


@query(None)
def frequency_shapes(spark, d):
    return sysid.frequency_shapes(_sensors(spark, d), [0.2618, 1.0])


@query("""WITH q AS (SELECT p_partkey AS signal, unnest(range(50 + p_size * 10)) AS i, 50.0 + p_partkey % 100 AS f FROM part), u AS (SELECT *, i / 1000.0 AS t FROM q)
SELECT signal, i, round(2 * sin(2 * pi() * (f * (t - 0.1) + 20 * pow(t - 0.1, 2))) + 6 * sin(2 * pi() * 200 * (t - 0.05)) * exp(-0.5 * pow((t - 0.05) / 0.01, 2)), 6) + 0.0 AS x FROM u""")
def example_signal(spark, d):
    """A sweeping tone and a pulse for each part, as long as its size says."""
    part = lambda a, f, sweep, centre, width: F.struct(F.lit(a).alias("amplitude"), f.alias("frequency"), F.lit(sweep).alias("sweep"), F.lit(centre).alias("centre"), F.lit(width).cast("double").alias("width"))
    made = F.array(part(2.0, 50.0 + F.col("p_partkey") % 100, 40.0, 0.1, None), part(6.0, F.lit(200.0), 0.0, 0.05, 0.01))
    asked = S.table(spark, d, "part").select(F.col("p_partkey").alias("signal"), (50 + F.col("p_size") * 10).alias("samples"), F.lit(1000.0).alias("rate"), F.lit(0.0).alias("noise"), F.lit(0).alias("seed"), made.alias("parts"))
    return examples.example_signals(asked, "signal").select("signal", "i", r("x").alias("x"))


def _region_graph(spark, d):
    """Customers tied to their region, and regions loosely to each other; regions are numbered from -1 down."""
    home = S.table(spark, d, "customer").join(S.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = home.select(F.col("c_custkey").cast("long").alias("a"), (-1 - F.col("n_regionkey")).cast("long").alias("b"), F.lit(1.0).alias("w"))
    held = c.select(F.col("b").alias("a")).distinct().withColumn("all", F.collect_set("a").over(Window.partitionBy(F.lit(0))))  # a handful of regions
    loose = held.select("a", F.explode("all").alias("b")).where("a <> b").withColumn("w", F.lit(0.01))
    return c.union(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).union(loose)


@query("SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY n_regionkey) AS first_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def spectral_clusters_of_graph(spark, d):
    """Spectral clusters of the customers, each named by its least one: the regions."""
    graph = _region_graph(spark, d)
    found = spectral_clusters.clusters(graph, graph.where("b < 0").select("b").distinct().count()).where("id >= 0")
    least = found.groupBy("cluster").agg(F.min("id").alias("first_id"))
    return found.join(least, "cluster").select("id", "first_id")


@query("SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY n_regionkey) AS first_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def spectral_clusters_auto(spark, d):
    """The same without being told how many: the eigenvalues say, and the best of three starts counts."""
    found = spectral_clusters.clusters(_region_graph(spark, d), trials=3).where("id >= 0")
    least = found.groupBy("cluster").agg(F.min("id").alias("first_id"))
    return found.join(least, "cluster").select("id", "first_id")


@query("SELECT f, round(sum(s * s), 6) AS y FROM (SELECT f, (v - avg(v) OVER (PARTITION BY f)) / (stddev_pop(v) OVER (PARTITION BY f) + 1e-6) AS s FROM grid) GROUP BY 1", "grid")
def scored_rows(spark, d):
    """A plugged-in scorer over whole rows of the grid: here the energy of the standardised row."""
    x = F.transform(F.array_sort(F.collect_list(F.struct("t", "z"))), lambda s: s["z"])
    rows = scoring.standardised(S.grid(spark, d), "f").groupBy("f").agg(x.alias("x"))
    return scoring.scored(rows, _energy, 2.0, keys=("f",)).select("f", r(F.get("y", F.lit(0))).alias("y"))


def _energy(power):
    return lambda x: [(abs(x) ** power).sum()]

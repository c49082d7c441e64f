"""Queries over prepared, gated and thresholded images, averaged spectrograms and prototype channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preparation
from ..sources import standins as S
from .grid_queries import _SEG
from .signal_queries import query, r


def _complex(spark, d):
    """Two images side by side of the grid as real parts and its rows turned round as imaginary ones; some cells are no numbers."""
    g = S.grid(spark, d)
    other = g.select((15 - F.col("f")).alias("f"), "t", (F.col("v") / 2).alias("im"))
    re = F.when((F.col("f") + F.col("t")) % 97 == 0, F.lit(float("nan"))).otherwise(F.col("v"))
    return g.join(other, ["f", "t"]).select((F.col("t") / 360).cast("int").alias("input"), "f", (F.col("t") % 360).alias("t"), re.alias("re"), "im")


_Z = """, z AS (SELECT CAST(g.t // 360 AS INTEGER) AS input, g.f, g.t % 360 AS t, CASE WHEN (g.f + g.t) % 97 = 0 THEN 0.0 ELSE g.v END AS re, o.v / 2 AS im FROM grid g JOIN grid o ON o.t = g.t AND o.f = 15 - g.f)"""


@query(_Z + """, x AS (SELECT *, sqrt(re * re + im * im) AS x FROM z), m AS (SELECT input, avg(x) AS m, stddev_samp(x) AS s FROM x GROUP BY 1)
SELECT input, f, t, CASE WHEN f < 2 OR f >= 15 THEN 0.0 ELSE round((x - m) / (s + 1e-6), 6) + 0.0 END AS v FROM x JOIN m USING (input)""", "grid")
def prepared_magnitude(spark, d):
    return preparation.prepared(_complex(spark, d), "input", height=16, lower=2, upper=1).select("input", "f", "t", r("v").alias("v"))


@query(_Z + """, x AS (SELECT input, f, t, 0 AS part, re AS x FROM z UNION ALL SELECT input, f, t, 1, im FROM z), m AS (SELECT input, part, median(x) AS m FROM x GROUP BY ALL),
s AS (SELECT input, part, m, 1.4826 * median(abs(x - m)) + 1e-6 AS s FROM x JOIN m USING (input, part) GROUP BY ALL)
SELECT input, part, f, t, CASE WHEN f >= 14 THEN 0.0 ELSE round(0.5 * asinh((x - m) / (0.5 * s)), 5) + 0.0 END AS v FROM x JOIN s USING (input, part)""", "grid")
def prepared_complex(spark, d):
    found = preparation.prepared(_complex(spark, d), "input", height=16, magnitude=False, normalisation="robust_asinh", a=0.5, upper=2)
    return found.select("input", "part", "f", "t", r("v", 5).alias("v"))


@query("""WITH RECURSIVE """ + S.SQL["grid"] + """, c AS (SELECT t // 360 AS input, f, t % 360 AS t, v AS x FROM grid), e AS (SELECT input, stddev_pop(x) * 0.6 AS threshold FROM c WHERE input < 2 GROUP BY 1),
d AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END AS d FROM c WINDOW w AS (PARTITION BY input, f ORDER BY t)),
on_ AS (SELECT input, f, t FROM d JOIN e USING (input) WHERE d > threshold AND f BETWEEN 1 AND 14 AND t BETWEEN 2 AND 358),
link AS (SELECT a.input, a.t * 4294967296 + a.f AS a, b.t * 4294967296 + b.f AS b FROM on_ a JOIN on_ b ON a.input = b.input AND abs(a.f - b.f) + abs(a.t - b.t) = 1),
cc(input, node, label) USING KEY (input, node) AS (SELECT input, t * 4294967296 + f, t * 4294967296 + f FROM on_ UNION SELECT e.input, e.b, min(cc.label) FROM cc JOIN link e ON e.input = cc.input AND e.a = cc.node JOIN recurring.cc AS had ON had.input = e.input AND had.node = e.b WHERE cc.label < had.label GROUP BY e.input, e.b)
SELECT input, CAST(node % 4294967296 AS BIGINT) AS f, CAST(node // 4294967296 AS BIGINT) AS t FROM (SELECT *, count(*) OVER (PARTITION BY input, label) AS n FROM cc) WHERE n >= 3""")
def thresholded_slopes(spark, d):
    """Cells that rise faster than their image's threshold, in regions of three or more."""
    c = S.grid(spark, d).select(F.floor(F.col("t") / 360).alias("input"), "f", (F.col("t") % 360).alias("t"), F.col("v").alias("x"))
    limits = c.groupBy("input").agg((F.stddev_pop("x") * 0.6).alias("threshold"))
    return preparation.rising(c, limits, "input", height=16, bottom=1, top=1, min_size=3, tile=128)


@query(""", l AS (SELECT t, avg(v) + 1.5 * stddev_pop(v) AS l FROM grid GROUP BY 1), g AS (SELECT f, t, CASE WHEN v > l THEN 1.0 ELSE 0.0 END AS g FROM grid JOIN l USING (t)),
k AS (SELECT k, exp(-0.5 * pow(k / 2.0, 2)) AS w FROM (SELECT unnest(range(-8, 9)) AS k)), n AS (SELECT k, w / (SELECT sum(w) FROM k) AS w FROM k),
a AS (SELECT f, t, sum(w * y) AS g FROM (SELECT g.f, g.t, n.w, h.g AS y FROM g CROSS JOIN n JOIN g h ON h.f = g.f AND h.t = CASE WHEN g.t + k < 0 THEN -1 - (g.t + k) WHEN g.t + k > 719 THEN 1439 - (g.t + k) ELSE g.t + k END) GROUP BY 1, 2),
b AS (SELECT f, t, sum(w * y) AS g FROM (SELECT a.f, a.t, n.w, h.g AS y FROM a CROSS JOIN n JOIN a h ON h.t = a.t AND h.f = CASE WHEN a.f + k < 0 THEN -1 - (a.f + k) WHEN a.f + k > 15 THEN 31 - (a.f + k) ELSE a.f + k END) GROUP BY 1, 2),
e AS (SELECT min(g) AS lo, max(g) AS hi FROM b)
SELECT f, t, round(v * ((g - lo) / (hi - lo) * 0.9 + 0.1), 4) + 0.0 AS v FROM grid JOIN b USING (f, t) CROSS JOIN e""", "grid")
def gated_columns(spark, d):
    return preparation.gated(S.grid(spark, d)).select("f", "t", r("v", 4).alias("v"))


@query(_SEG.format(n=32, h=16) + "SELECT b AS block, CAST(k AS INTEGER) AS k, round(avg(re * re + im * im) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END / 12.0, 3) + 0.0 AS p FROM sp GROUP BY sp.b, sp.k", "grid")
def averaged_spectrogram(spark, d):
    rows = S.grid(spark, d).select("f", F.col("t").alias("i"), F.col("v").alias("x"))
    return preparation.averaged_spectrogram(rows, 32, 0.5, 1.0, "f").select("block", "k", r("p", 3).alias("p"))


@query(_Z + ", m AS (SELECT input, max(sqrt(re * re + im * im)) AS m FROM z GROUP BY 1) SELECT input, f, t, round(ln(1 + sqrt(re * re + im * im) / m), 6) + 0.0 AS v FROM z JOIN m USING (input)", "grid")
def displayed_images(spark, d):
    z = _complex(spark, d).withColumn("re", F.nanvl("re", F.lit(0.0)))
    return preparation.displayed(z, "input").select("input", "f", "t", r("v").alias("v"))


@query(""", a AS (SELECT vec_id, unnest(range(1, 33)) AS channel, re, im FROM modes), s AS (SELECT vec_id, channel, sqrt(pow(CAST(re[channel] AS DOUBLE), 2) + pow(CAST(im[channel] AS DOUBLE), 2)) AS amplitude, atan2(CAST(im[channel] AS DOUBLE), CAST(re[channel] AS DOUBLE)) AS phase FROM a),
t AS (SELECT *, max(amplitude) OVER (PARTITION BY vec_id) AS top FROM s)
SELECT vec_id AS mode, CAST(channel AS INTEGER) AS channel, CAST(1.5 + channel / 100.0 AS DOUBLE) AS r, CAST(channel % 5 - 2 AS DOUBLE) AS z, CAST(channel * 11.25 AS DOUBLE) AS phi, round(amplitude, 6) AS amplitude, round(phase, 5) + 0.0 AS phase FROM t WHERE amplitude > 0.7 * top""", "modes")
def prototype_channels(spark, d):
    shapes = S.modes(spark, d).select(F.col("vec_id").alias("mode"), "re", "im")
    c = F.col("channel")
    places = spark.range(1, 33).select(F.col("id").cast("int").alias("channel")).select("channel", (1.5 + c / 100.0).alias("r"), (c % 5 - 2).cast("double").alias("z"), (c * 11.25).alias("phi"))
    return preparation.prototype_channels(shapes, places, 0.7).select("mode", "channel", r("r").alias("r"), "z", "phi", r("amplitude").alias("amplitude"), r("phase", 5).alias("phase"))


@query("""WITH c AS (SELECT s_suppkey AS channel, (s_suppkey % 7 - 3) / 100.0 AS x, s_suppkey % 80 / 10.0 AS y FROM supplier), p AS (SELECT *, CASE WHEN abs(x) <= 0.02 THEN 0 WHEN abs(y - 5.6287) <= 0.1 THEN 1 ELSE 2 END AS part FROM c)
SELECT channel, part, row_number() OVER (ORDER BY part, CASE part WHEN 0 THEN y WHEN 1 THEN x END, channel) - 1 AS place FROM p""")
def array_order(spark, d):
    k = F.col("s_suppkey")
    c = S.table(spark, d, "supplier").select(k.alias("channel"), ((k % 7 - 3) / 100.0).alias("x"), (k % 80 / 10.0).alias("y"))
    return preparation.array_order(c).select("channel", "part", F.col("place").cast("long").alias("place"))

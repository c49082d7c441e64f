"""Queries over prototype traces, mode location, probe amplitudes and decimation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, frames, grids, location, modes, polygons
from ..sources import standins as S
from .more_queries import _signals
from .signal_queries import query, r


def _hours(spark, d):
    """t (hour), x: sums of six sensors, 0 where one has none; hours without any event are missing."""
    ev = S.table(spark, d, "events")
    sums = [F.sum(F.when(F.col("user_id") % 6 == c, F.col("value")).otherwise(0.0)) for c in range(6)]
    return ev.groupBy(F.floor((F.unix_seconds("ts") - S.EPOCH) / 3600).alias("t")).agg(F.array(*sums).alias("x"))


@query("""WITH s AS (SELECT CAST(floor((epoch_us(ts) // 1000000 - 1704067200) / 3600) AS BIGINT) AS t, user_id % 6 AS c, sum(value) AS x FROM events GROUP BY ALL),
q AS (SELECT p_partkey AS reference, p_partkey * 7 % 700 + 0.25 AS time, p_size % 10 / 25.0 AS frequency FROM part),
w AS (SELECT *, CASE WHEN frequency > 0 THEN least(5.0 / frequency, 48.0) ELSE 24.0 END AS width FROM q)
SELECT reference, round(t - time, 6) AS time, round(sum(x * ((reference + 3 * c * c) % 7 - 3)), 4) + 0.0 AS signal FROM w JOIN s ON t BETWEEN time - width / 2 AND time + width / 2 GROUP BY 1, 2""")
def prototype_traces(spark, d):
    """The sensors around each part's own time, along the shape that follows from the part."""
    key = F.col("p_partkey")
    shape = lambda k: F.array(*(((k + 3 * c * c) % 7 - 3).cast("double") for c in range(6)))
    asked = S.table(spark, d, "part").select(key.alias("reference"), (key * 7 % 700 + 0.25).alias("time"), (F.col("p_size") % 10 / 25.0).alias("frequency"), shape(key).alias("re"), shape(key + 1).alias("im"))
    return modes.prototype_traces(asked, _hours(spark, d), 48.0).select("reference", r("time").alias("time"), r("signal", 4).alias("signal"))


def _channels(spark, d):
    """Rows of the grid as channels of a profile: channel, i, t (hours), x; and their places."""
    rows = S.grid(spark, d).select(F.col("f").alias("channel"), F.col("t").alias("i"), F.col("t").cast("double").alias("t"), (F.col("v") + 1.0).alias("x"))
    places = spark.range(S.N_ROWS).select(F.col("id").alias("channel"), (1.2 + F.col("id") * 0.05).alias("place"))
    return rows, places


@query(None)
def mode_location(spark, d):
    """The band around one cycle in 20 hours, over the level of each channel."""
    rows, places = _channels(spark, d)
    return location.located(location.by_amplitude(rows, 0.03, 0.07, (100.0, 600.0), 1.0), places, 1.5, 0.5)


@query(""", c AS (SELECT f AS channel, t, v + 1.0 AS x FROM grid WHERE t BETWEEN 100 AND 600), ref AS (SELECT i AS t, x FROM hourly WHERE channel = (SELECT min(channel) FROM hourly)),
pt AS (SELECT unnest(range(100, 601)) AS t), lo AS (SELECT pt.t, a.t AS ta, a.x AS xa FROM pt ASOF LEFT JOIN ref a ON pt.t >= a.t), hi AS (SELECT pt.t, z.t AS tz, z.x AS xz FROM pt ASOF LEFT JOIN ref z ON pt.t <= z.t),
ri AS (SELECT t, CASE WHEN ta IS NULL THEN xz WHEN tz IS NULL OR ta = tz THEN xa ELSE xa + (xz - xa) * (t - ta) / (tz - ta) END AS y FROM lo JOIN hi USING (t)),
sg AS (SELECT channel, b, t - 100 - b * 32 AS j, x, y FROM (SELECT unnest(range(14)) AS b) JOIN c ON t - 100 >= b * 32 AND t - 100 < b * 32 + 64 JOIN ri USING (t)),
cn AS (SELECT channel, b, j, (x - avg(x) OVER w) * (0.5 - 0.5 * cos(2 * pi() * j / 64)) AS x, (y - avg(y) OVER w) * (0.5 - 0.5 * cos(2 * pi() * j / 64)) AS y FROM sg WINDOW w AS (PARTITION BY channel, b)),
sp AS (SELECT channel, b, k, sum(x * cos(2 * pi() * ((j * k) % 64) / 64)) AS ar, -sum(x * sin(2 * pi() * ((j * k) % 64) / 64)) AS ai, sum(y * cos(2 * pi() * ((j * k) % 64) / 64)) AS br, -sum(y * sin(2 * pi() * ((j * k) % 64) / 64)) AS bi FROM cn CROSS JOIN (SELECT unnest(range(2, 13)) AS k) GROUP BY 1, 2, 3),
co AS (SELECT channel, k, least(1, (pow(avg(ar * br + ai * bi), 2) + pow(avg(ai * br - ar * bi), 2)) / greatest(avg(ar * ar + ai * ai) * avg(br * br + bi * bi), 1e-15)) AS g FROM sp GROUP BY 1, 2),
m AS (SELECT channel, avg(g) AS metric FROM co GROUP BY 1), e AS (SELECT channel, median(x) AS level FROM c GROUP BY 1)
SELECT channel, round(level, 6) AS level, round(metric, 6) AS metric, CAST(round(1.2 + channel * 0.05, 6) AS DOUBLE) AS place, CAST(round(abs(1.2 + channel * 0.05 - 1.5) / 0.5, 6) AS DOUBLE) AS rho, channel = first_value(channel) OVER (ORDER BY round(metric, 12) DESC, channel) AS peak FROM m JOIN e USING (channel)""", "grid", "hourly")
def mode_location_coherence(spark, d):
    """Coherence of each channel with the hours of one kind of event, which lack some, between 2 and 12 cycles in 64 hours."""
    rows, places = _channels(spark, d)
    h = S.hourly(spark, d)
    first = h.agg(F.min("channel").alias("channel"))
    ref = h.join(F.broadcast(first), "channel").select(F.col("i").cast("double").alias("t"), "x")  # one row
    found = location.located(location.by_coherence(rows, ref, 2 / 64, 12 / 64, (100.0, 600.0), 1.0, 64, 24.0), places, 1.5, 0.5)
    return found.select("channel", r("level").alias("level"), r("metric").alias("metric"), r("place").alias("place"), r("rho").alias("rho"), "peak")


@query(None)
def probe_amplitude(spark, d):
    rows, _ = _channels(spark, d)
    return location.probe_amplitude(rows.select(F.col("channel").alias("probe"), "t", "x"), (50.0, 650.0), (0.1, 0.4))


@query(None)
def decimate_iir(spark, d):
    """Every fourth hour of each row behind a Chebyshev low pass of order 8."""
    return filters.decimated(_signals(spark, d), 4, keys=("f",)).select("f", F.posexplode("y").alias("m", "y"))


@query(""", k AS (SELECT k, (CASE WHEN k = 0 THEN 0.25 ELSE sin(pi() * k / 4) / (pi() * k) END) * (0.54 + 0.46 * cos(pi() * k / 4)) AS w FROM (SELECT unnest(range(-4, 5)) AS k))
SELECT f, m, round(sum(w * v) / (SELECT sum(w) FROM k), 4) AS y FROM (SELECT unnest(range(180)) AS m) CROSS JOIN k JOIN grid ON t = m * 4 + k GROUP BY 1, 2""", "grid")
def decimate_fir(spark, d):
    """The same behind nine taps, with zeros beyond the ends."""
    rows = S.grid(spark, d).select("f", F.col("t").alias("i"), F.col("v").alias("x"))
    return frames.decimated(rows, 4, 4, "zero", keys=("f",)).select("f", "m", r("y", 4).alias("y"))


def _mask(spark, d):
    return S.score(spark, d).select((F.col("t") / 240).cast("int").alias("input"), "f", (F.col("t") % 240).cast("long").alias("t"), (F.col("s") > 0.25).alias("s"))


@query("""WITH RECURSIVE """ + S.SQL["grid"] + ", " + S.SQL["score"] + """, on_ AS (SELECT CAST(t // 240 AS INTEGER) AS input, f, t % 240 AS t FROM score WHERE s > 0.25),
link AS (SELECT a.input, a.t * 4294967296 + a.f AS a, b.t * 4294967296 + b.f AS b FROM on_ a JOIN on_ b ON a.input = b.input AND abs(a.f - b.f) + abs(a.t - b.t) = 1),
cc(input, node, label) USING KEY (input, node) AS (SELECT input, t * 4294967296 + f, t * 4294967296 + f FROM on_ UNION SELECT e.input, e.b, min(cc.label) FROM cc JOIN link e ON e.input = cc.input AND e.a = cc.node JOIN recurring.cc AS had ON had.input = e.input AND had.node = e.b WHERE cc.label < had.label GROUP BY e.input, e.b),
r AS (SELECT input, label, node % 4294967296 AS f, node // 4294967296 AS t FROM cc),
n AS (SELECT r.input, r.label, r.f, r.t, df, dt FROM r, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) v(df, dt) WHERE r.f + df BETWEEN 0 AND 15 AND r.t + dt BETWEEN 0 AND 239)
SELECT n.input, CAST(n.label AS BIGINT) AS label, count(*) AS points FROM n LEFT JOIN r x ON x.input = n.input AND x.label = n.label AND x.f = n.f + n.df AND x.t = n.t + n.dt WHERE x.f IS NULL GROUP BY 1, 2""")
def region_outlines(spark, d):
    """How many points the outlines of each region have: one between each of its pixels and a neighbour outside."""
    regions = grids.connected_regions(_mask(spark, d), "input", tile=64)
    found = polygons.outlines(regions, "input", height=16, width=240)
    return found.groupBy("input", "label").agg(F.sum(F.col("n") - F.col("closed").cast("int")).alias("points"))


@query(None)
def mask_polygons(spark, d):
    """The polygon of the largest outline of ten days' mask, from its runs."""
    runs = grids.run_lengths(_mask(spark, d), "input", height=16)
    return polygons.mask_polygons(runs, grids.connected_regions, "input", height=16, width=240)

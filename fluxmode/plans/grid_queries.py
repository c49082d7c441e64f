"""Queries over grids, masks, scores and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import events, grids, metrics, modes, params, spectral, sysid
from ..sources import standins as S
from . import catalogue, staging
from .signal_queries import query, r

ANGLES = {0: 0.0, 1: 40.0, 2: 90.0, 3: 140.0, 4: 200.0, 5: 250.0}
_PHI = "(CASE c WHEN 0 THEN 0 WHEN 1 THEN 40 WHEN 2 THEN 90 WHEN 3 THEN 140 WHEN 4 THEN 200 ELSE 250 END * pi() / 180)"
_ELM = """, act AS (SELECT t, avg(CASE WHEN s >= 0.3 THEN 1.0 ELSE 0.0 END) AS activity FROM score GROUP BY 1),
onn AS (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) - 1 <= 3 THEN 0 ELSE 1 END AS n FROM act WHERE activity >= 0.25),
run AS (SELECT t, sum(n) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM onn), ev AS (SELECT min(t) AS start, max(t) AS stop FROM run GROUP BY run),
elm AS (SELECT start, stop, stop - start + 1 AS duration, round(max(activity), 6) AS peak FROM ev JOIN act ON t BETWEEN start AND stop GROUP BY 1, 2)
"""


def _mask(spark, d):
    return S.score(spark, d).withColumn("input", F.lit(0))


@query(_ELM + "SELECT start, stop, duration, peak FROM elm", "grid", "score")
def elm_events(spark, d):
    e = events.elm_events(_mask(spark, d), "input", threshold=0.3, activity_min=0.25, min_gap=3)
    return e.select("start", "stop", "duration", r("peak").alias("peak"))


@query(_ELM + "SELECT count(*) AS n_events, round(count(*) / (720 * 256 / 200000.0), 6) AS elm_freq_hz, round(coalesce(sum(duration), 0) / 720.0, 6) AS duty_cycle FROM elm", "grid", "score")
def elm_summary(spark, d):
    e = events.elm_events(_mask(spark, d), "input", threshold=0.3, activity_min=0.25, min_gap=3)
    inputs = spark.range(1).select(F.lit(0).alias("input"), F.lit(720).alias("n_cols"), F.lit(200000.0).alias("fs"))
    s = events.elm_summary(e, inputs, 256, "input")
    return s.select("n_events", r("elm_freq_hz").alias("elm_freq_hz"), r("duty_cycle").alias("duty_cycle"))


@query("SELECT t, round(avg(CASE WHEN s >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS activity FROM score GROUP BY 1", "grid", "score")
def column_activity(spark, d):
    return events.column_activity(S.score(spark, d), 0.3).select("t", r("activity").alias("activity"))


@query("SELECT f, t, round(abs(v - coalesce(lag(v) OVER (PARTITION BY f ORDER BY t), v)), 4) AS d FROM grid", "grid")
def transient_field(spark, d):
    return grids.transient_field(S.grid(spark, d)).select("f", "t", r("d", 4).alias("d"))


@query("SELECT f // 4 AS tile, round(sum(CASE WHEN f % 4 < 3 THEN coalesce(a, 0) ELSE 0 END) + sum(CASE WHEN t < 719 THEN coalesce(b, 0) ELSE 0 END), 2) AS tv FROM (SELECT *, abs(lead(v) OVER (PARTITION BY f ORDER BY t) - v) AS a, abs(lead(v) OVER (PARTITION BY f // 4, t ORDER BY f) - v) AS b FROM grid) GROUP BY 1", "grid")
def total_variation(spark, d):
    tiles = S.grid(spark, d).withColumn("tile", F.floor(F.col("f") / 4))
    return grids.total_variation(tiles, "tile").select("tile", r("tv", 2).alias("tv"))


@query("SELECT f % 2 AS label, min(t) AS x, min(f) AS y, max(t) - min(t) + 1 AS w, max(f) - min(f) + 1 AS h, count(*) AS area FROM score WHERE s > 0.5 GROUP BY 1", "grid", "score")
def bbox_instances(spark, d):
    on = S.score(spark, d).where("s > 0.5").withColumn("label", F.col("f") % 2)
    return grids.bounding_boxes(on).select("label", "x", "y", "w", "h", "area")


#: Regions of set cells by the least code of a neighbour, round by round, until none changes.
_REGIONS = (S.cte("grid") + """, lit AS (SELECT t * 4294967296 + f AS id FROM grid WHERE v > 0),
near AS (SELECT a.id AS a, a.id + k AS b FROM lit a CROSS JOIN (SELECT unnest([1, -1, 4294967296, -4294967296]) AS k) WHERE a.id + k IN (SELECT id FROM lit)),
cc(id, label) USING KEY (id) AS (SELECT id, id FROM lit UNION SELECT near.b, min(cc.label) FROM cc JOIN near ON near.a = cc.id JOIN recurring.cc AS had ON had.id = near.b WHERE cc.label < had.label GROUP BY near.b),
reg AS (SELECT CAST(0 AS INTEGER) AS input, id % 4294967296 AS f, id // 4294967296 AS t, label FROM cc)
""").replace("WITH", "WITH RECURSIVE", 1)


@query(_REGIONS + "SELECT * FROM reg")
def connected_regions(spark, d):
    mask = S.grid(spark, d).select(F.lit(0).alias("input"), "f", "t", (F.col("v") > 0).alias("s"))
    return grids.connected_regions(mask, "input", tile=64)


@query(_REGIONS + "SELECT input, f, t, label FROM reg JOIN (SELECT label FROM reg GROUP BY 1 HAVING count(*) >= 3) USING (label)")
def small_object_removal(spark, d):
    mask = S.grid(spark, d).select(F.lit(0).alias("input"), "f", "t", (F.col("v") > 0).alias("s"))
    return grids.without_small(mask, grids.connected_regions(mask, "input", tile=64), 3, "input").select("input", "f", "t", "label")


@query("SELECT min(p) AS start, count(*) AS length FROM (SELECT t * 16 + f AS p, t * 16 + f - row_number() OVER (ORDER BY t * 16 + f) AS g FROM grid WHERE v > 0) GROUP BY g", "grid")
def rle_counts(spark, d):
    mask = S.grid(spark, d).select(F.lit(0).alias("input"), "f", "t", (F.col("v") > 0).alias("s"))
    return grids.run_lengths(mask, "input", height=16).select("start", "length")


@query("SELECT f, t, (s > 0.25 AND s * 0.9 > 0.45 AND NOT (s > 0.9 OR s * 0.5 > 0.25)) OR s > 0.95 AS c, (s * 0.5 > 0.25 AND s > 0.45 AND NOT (s > 0.95 OR s > 0.25)) OR s > 0.9 AS s1 FROM score", "grid", "score")
def mask_refine_logic(spark, d):
    s = F.col("s")
    df = S.score(spark, d).select("f", "t", s.alias("p0"), (s * 0.9).alias("e0"), (s * 0.5).alias("p1"), s.alias("e1"), (s > 0.95).alias("y0"), (s > 0.9).alias("y1"))
    return grids.refined(df).select("f", "t", "c", F.col("s").alias("s1"))


@query("SELECT f, t, round(v * CASE WHEN f < 4 THEN 1 - 0.05 * f WHEN f < 10 THEN 0.8 - 0.05 * (f - 4) ELSE 0.5 - 0.04 * (f - 10) END, 4) AS v FROM grid", "grid")
def rolloff_interp(spark, d):
    table = spark.createDataFrame([(0.0, 1.0), (4.0, 0.8), (10.0, 0.5), (20.0, 0.1)], "x double, c double")
    return grids.rolloff(S.grid(spark, d), table).select("f", "t", r("v", 4).alias("v"))


@query("SELECT f, t, round(CASE WHEN s > 0.4 OR s * s > 0.4 THEN v ELSE 0 END, 4) AS v FROM score", "grid", "score")
def spectral_gate(spark, d):
    return S.score(spark, d).select("f", "t", r(scalars.spectral_gate(F.col("v"), F.col("s"), F.col("s") * F.col("s"), 0.4), 4).alias("v"))


@query("SELECT f, t, CASE WHEN s >= 0.6 THEN 'transient' WHEN s >= 0.3 THEN 'coherent' ELSE 'none' END AS layer, round(CASE WHEN s < 0.1 THEN 0 WHEN s > 0.9 THEN 1 ELSE s END, 6) AS shade FROM score", "grid", "score")
def overlay_composite(spark, d):
    s = F.col("s")
    burst = F.when(s >= 0.6, 1.0).otherwise(0.0)
    return S.score(spark, d).select("f", "t", scalars.overlay(s, burst, 0.3).alias("layer"), r(scalars.enhanced(s, 10, 90)).alias("shade"))


@query("SELECT f, t, max(v) OVER (PARTITION BY f ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS e FROM grid", "grid")
def grey_dilation(spark, d):
    return grids.local_extreme(S.grid(spark, d), 2, "max").select("f", "t", "e")


@query("SELECT DISTINCT f, t, round(t * 128 / 200000.0 * 1e3, 6) AS time_ms, round((f + 1) * 200000.0 / 1024 / 1e3, 6) AS freq_khz FROM grid", "grid")
def stft_axes(spark, d):
    fs = F.lit(200000.0)
    return S.grid(spark, d).select("f", "t", r(scalars.column_seconds(F.col("t"), 128, fs) * 1e3).alias("time_ms"), r(scalars.row_khz(F.col("f"), 1024, fs)).alias("freq_khz"))


@query("SELECT f, t, least(t // 710, 720 // 710 + CASE WHEN 720 % 710 >= 32 THEN 1 ELSE 0 END - 1) AS win FROM grid", "grid")
def detection_windows(spark, d):
    width, sliver, n = 710, 32, S.N_HOURS
    count = n // width + (1 if n % width >= sliver else 0)
    return S.grid(spark, d).select("f", "t", F.least(F.floor(F.col("t") / width), F.lit(max(count, 1) - 1)).cast("long").alias("win"))


@query(""", e AS (SELECT f, t // 120 AS sample, sqrt(avg(v * v)) AS e FROM grid GROUP BY 1, 2), p AS (SELECT f, median(e) AS e FROM e GROUP BY 1),
o AS (SELECT f, abs(ln(e) - ln((SELECT median(e) FROM p))) <= ln(1.05) AS ok FROM p)
SELECT greatest(1, least(coalesce((SELECT min(f) FROM o WHERE ok), 16), CAST(floor(16 * 0.3) AS BIGINT))) AS lower, greatest(1, least(coalesce(15 - (SELECT max(f) FROM o WHERE ok), 16), CAST(floor(16 * 0.3) AS BIGINT))) AS upper""", "grid")
def edge_bins_energy(spark, d):
    g = S.grid(spark, d).withColumn("sample", F.floor(F.col("t") / 120)).withColumn("input", F.lit(0))
    return params.edge_bins(params.energy_profile(g, "input"), "input", k=1.05, cap=0.3).select("lower", "upper")


@query(""", z AS (SELECT user_id % 8 AS g, value AS x FROM events), e AS (SELECT g, min(x) AS low, max(x) AS high FROM z GROUP BY 1),
h AS (SELECT g, low, high, b, sum(n) OVER (PARTITION BY g ORDER BY b) / sum(n) OVER (PARTITION BY g) AS cdf FROM (SELECT g, low, high, least(CAST(floor((x - low) / (high - low) * 64) AS BIGINT), 63) AS b, count(*) AS n FROM z JOIN e USING (g) GROUP BY 1, 2, 3, 4)),
c AS (SELECT *, first_value(b) OVER w AS b0, first_value(cdf) OVER w AS c0, last_value(b) OVER w AS b1, last_value(cdf) OVER w AS c1 FROM h WINDOW w AS (PARTITION BY g ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(cdf - (c0 + (c1 - c0) * (b - b0) / greatest(b1 - b0, 1)), 9) DESC, b) AS p FROM c)
SELECT g, round(low + (high - low) * ((b + 0.5) / 64), 6) AS threshold FROM k WHERE p = 1""".replace(", z AS", "WITH z AS", 1))
def triangle_threshold(spark, d):
    z = S.table(spark, d, "events").select((F.col("user_id") % 8).alias("g"), F.col("value").alias("x"))
    return params.triangle_threshold(z, "g", bins=64).select("g", r("threshold").alias("threshold"))


@query("""WITH z AS (SELECT user_id % 8 AS g, ln(1 + value) - 3 AS x FROM events), tops AS (SELECT g, quantile_cont(x, 0.999) AS top, quantile_cont(x, 0.98) AS back, count(*) AS n FROM z WHERE x > 0 GROUP BY 1),
h AS (SELECT g, least(CAST(floor(x / top * 511) AS BIGINT), 511) AS b, count(*) AS m FROM z JOIN tops USING (g) WHERE x > 0 AND x <= top GROUP BY ALL),
d AS (SELECT g, b, sum(coalesce(m, 0)) OVER (PARTITION BY g ORDER BY b) / n - b / 511.0 AS d FROM (SELECT g, n, unnest(range(512)) AS b FROM tops) LEFT JOIN h USING (g, b)),
k AS (SELECT *, d > coalesce(lag(d) OVER w, -1) AND d >= coalesce(lead(d) OVER w, -1) AS peak, min(d) OVER (PARTITION BY g ORDER BY b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM d WINDOW w AS (PARTITION BY g ORDER BY b)),
kn AS (SELECT g, min(b) AS b FROM k WHERE peak AND later < d - 1 / 511.0 GROUP BY 1)
SELECT g, round(CASE WHEN coalesce(n, 0) < 100 THEN CAST('inf' AS DOUBLE) WHEN kn.b IS NULL THEN back ELSE kn.b / 511.0 * top END, 6) AS threshold, kn.b IS NULL AS used_fallback FROM (SELECT DISTINCT g FROM z) LEFT JOIN tops USING (g) LEFT JOIN kn USING (g)""")
def knee_threshold(spark, d):
    z = S.table(spark, d, "events").select((F.col("user_id") % 8).alias("g"), (F.log1p("value") - 3).alias("x"))
    return params.knee_threshold(z, "g").withColumn("threshold", r("threshold"))


@query("""SELECT DISTINCT p_size AS n, round(1e6 * pow(p_size / 513.0, 4), 6) AS lam, CAST(greatest(1, least(5, floor(log2(least(p_size, 64) / 4.0)))) AS BIGINT) AS layers, CAST(ceil(p_size / 32.0) * 32 AS BIGINT) AS padded, greatest(1, CAST(floor(p_size * 0.01) AS BIGINT)) AS rows_off FROM part WHERE p_size > 0""")
def auto_sizes(spark, d):
    n = F.col("n")
    sizes = S.table(spark, d, "part").where("p_size > 0").select(F.col("p_size").alias("n")).distinct()
    return sizes.select("n", r(scalars.baseline_weight(n)).alias("lam"), scalars.layer_count(n, F.lit(64)).alias("layers"), scalars.padded(n, F.lit(32)).alias("padded"), scalars.share_of(n, 0.01).alias("rows_off"))


_COUNTS = "count_if(p AND y) AS tp, count_if(p AND NOT y) AS fp, count_if(NOT p AND y) AS fn, count_if(NOT p AND NOT y) AS tn"
_RATIOS = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 6) AS iou, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy"
_R = ("precision", "recall", "f1", "iou", "accuracy")


@query(f"SELECT source, tp, fp, fn, tn, {_RATIOS} FROM (SELECT source, {_COUNTS} FROM (SELECT source, n_chars > 1000 AS p, quality = 1 AS y FROM pairs) GROUP BY 1)", "pairs")
def confusion_metrics(spark, d):
    m = metrics.confusion(S.pairs(spark, d), F.col("n_chars") > 1000, F.col("quality") == 1, "source")
    return m.select("source", "tp", "fp", "fn", "tn", *(r(c).alias(c) for c in _R))


@query(f"SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, {_RATIOS} FROM (SELECT threshold, {_COUNTS} FROM (SELECT threshold, s >= threshold AS p, v > 300 AS y FROM score CROSS JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS threshold)) GROUP BY 1)", "grid", "score")
def threshold_sweep(spark, d):
    m = metrics.threshold_sweep(S.score(spark, d), "s", F.col("v") > 300, [k / 10 for k in range(1, 10)])
    return m.select("threshold", "tp", "fp", "fn", "tn", *(r(c).alias(c) for c in _R))


@query("SELECT f AS image, round(CASE WHEN count_if(s > 0.3 OR v > 200) > 0 THEN count_if(s > 0.3 AND v > 200) / count_if(s > 0.3 OR v > 200) ELSE 0 END, 6) AS iou FROM score GROUP BY 1", "grid", "score")
def per_image_iou(spark, d):
    m = metrics.confusion(S.score(spark, d), F.col("s") > 0.3, F.col("v") > 200, "f")
    return m.select(F.col("f").alias("image"), r("iou").alias("iou"))


_P = "least(greatest(n_chars / 10000.0, 0.01), 0.99)"


def _p():
    return F.least(F.greatest(F.col("n_chars") / 10000.0, F.lit(0.01)), F.lit(0.99))


@query(f"SELECT source, round(avg(-(CASE WHEN quality = 1 THEN 0.25 ELSE 0.75 END) * pow(1 - pt, 2) * ln(pt)), 6) AS loss FROM (SELECT *, CASE WHEN quality = 1 THEN {_P} ELSE 1 - {_P} END AS pt FROM pairs) GROUP BY 1", "pairs")
def focal_loss(spark, d):
    return S.pairs(spark, d).groupBy("source").agg(r(F.avg(scalars.focal_loss(_p(), F.col("quality")))).alias("loss"))


@query(f"SELECT source, round(avg(-(quality * ln(p) + (1 - quality) * ln(1 - p)) - (p * ln(greatest(quality, 1e-4)) + (1 - p) * ln(greatest(1 - quality, 1e-4)))), 6) AS loss FROM (SELECT *, {_P} AS p FROM pairs) GROUP BY 1", "pairs")
def symmetric_ce_loss(spark, d):
    return S.pairs(spark, d).groupBy("source").agg(r(F.avg(scalars.symmetric_cross_entropy(_p(), F.col("quality")))).alias("loss"))


@query("SELECT f, t, n, round(p, 6) AS p, round(-(q * ln(q) + (1 - q) * ln(1 - q)), 6) AS entropy FROM (SELECT f, t, count(*) AS n, avg(p) AS p, least(greatest(avg(p), 1e-12), 1 - 1e-12) AS q FROM (SELECT f, t, s * (1 - 0.1 * k) AS p FROM score CROSS JOIN (SELECT unnest(range(5)) AS k)) GROUP BY 1, 2)", "grid", "score")
def ensemble_entropy(spark, d):
    p = S.score(spark, d).select("f", "t", F.explode(F.array(*(F.col("s") * (1 - 0.1 * k) for k in range(5)))).alias("p"))
    return metrics.ensemble(p, "f", "t").select("f", "t", "n", r("p").alias("p"), r("entropy").alias("entropy"))


@query(f"SELECT doc_id, round(0.7 * quality + 0.3 * {_P}, 6) AS target FROM pairs", "pairs")
def soft_targets(spark, d):
    return S.pairs(spark, d).select("doc_id", r(scalars.soft_target(F.col("quality"), _p(), 0.3)).alias("target"))


#: The CRC-32 of decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@query(f"SELECT doc_id, CAST({_CRC} % 5 AS BIGINT) AS fold FROM documents")
def fold_assign(spark, d):
    return metrics.folds(S.table(spark, d, "documents").select("doc_id"), "doc_id", 5)


_DFT = """, tw AS (SELECT channel, k, sum(x * cos(-2 * pi() * ((i * k) % 720) / 720)) AS re, sum(x * sin(-2 * pi() * ((i * k) % 720) / 720)) AS im FROM hourly CROSS JOIN (SELECT unnest(range(361)) AS k) GROUP BY 1, 2)
"""


def _hour_power(spark, d):
    """Power of all bins of each event type's hours; hours without events count as 0."""
    return spectral.power_rows(spectral.spectra(spectral.dense(S.hourly(spark, d), S.N_HOURS, "channel"), S.N_HOURS, "none", keys=("channel",)), "channel")


@query(_DFT + "SELECT channel, CAST(k AS INTEGER) AS k, round(sqrt(re * re + im * im), 4) AS amplitude FROM tw", "hourly")
def dft_amplitude(spark, d):
    return _hour_power(spark, d).select("channel", "k", r(F.sqrt("p"), 4).alias("amplitude"))


@query(_DFT + "SELECT channel, CAST(k AS INTEGER) AS k, round(re * re + im * im, 2) AS power FROM tw WHERE k < 49", "hourly")
def dft_power_relational(spark, d):
    """The same as sums of columns, over the lowest 48 bins and the constant."""
    return spectral.dft_power(S.hourly(spark, d), 720, 49, "channel").select("channel", "k", r("power", 2).alias("power"))


@query(_DFT + "SELECT channel, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT channel, (re * re + im * im) / sum(re * re + im * im) OVER (PARTITION BY channel) AS p FROM tw WHERE k > 0) GROUP BY 1", "hourly")
def spectral_entropy(spark, d):
    return spectral.entropy(_hour_power(spark, d).where("k > 0"), "channel", value="p").select("channel", r("entropy").alias("entropy"))


def _rows(spark, d):
    """Each grid row as a signal."""
    return S.grid(spark, d).select("f", F.col("t").alias("i"), F.col("v").alias("x"), F.col("t").cast("double").alias("t"))


_SEG = """, seg AS (SELECT f, b, t - b * {h} AS j, v FROM grid JOIN (SELECT unnest(range(0, (720 - {n}) // {h} + 1)) AS b) ON t BETWEEN b * {h} AND b * {h} + {n} - 1),
cen AS (SELECT f, b, j, (v - avg(v) OVER (PARTITION BY f, b)) * (0.5 - 0.5 * cos(2 * pi() * j / {n})) AS x FROM seg),
sp AS (SELECT f, b, k, sum(x * cos(2 * pi() * ((j * k) % {n}) / {n})) AS re, -sum(x * sin(2 * pi() * ((j * k) % {n}) / {n})) AS im FROM cen CROSS JOIN (SELECT unnest(range({n} // 2 + 1)) AS k) GROUP BY 1, 2, 3)
"""


@query(_SEG.format(n=32, h=16) + "SELECT f, CAST(k AS INTEGER) AS k, round(avg(re * re + im * im) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END / 12.0, 3) + 0.0 AS psd FROM sp GROUP BY f, sp.k", "grid")
def welch_psd(spark, d):
    return spectral.welch(_rows(spark, d), 32, 0.5, 1.0, "f").select("f", "k", r("psd", 3).alias("psd"))


@query(_SEG.format(n=24, h=24) + "SELECT f, CAST(b // 5 AS BIGINT) AS big, CAST(k AS INTEGER) AS k, round(median(re * re + im * im), 2) + 0.0 AS p FROM sp GROUP BY f, b // 5, sp.k", "grid")
def kfold_psd_median(spark, d):
    return spectral.kfold_median(_rows(spark, d), 120, 5, "f").select("f", "big", "k", r("p", 2).alias("p"))


@query(_SEG.format(n=32, h=32).replace("(v - avg(v) OVER (PARTITION BY f, b))", "v") + """, z AS (SELECT x.f, x.b, x.k, x.re AS ar, x.im AS ai, y.re AS br, y.im AS bi FROM sp x JOIN sp y ON y.f = x.f + 8 AND x.b = y.b AND x.k = y.k)
SELECT f, CAST(k AS INTEGER) AS k, round(least(1, (pow(avg(ar * br + ai * bi), 2) + pow(avg(ai * br - ar * bi), 2)) / greatest(avg(ar * ar + ai * ai) * avg(br * br + bi * bi), 1e-15)), 6) AS coherence FROM z GROUP BY 1, 2""", "grid")
def cross_coherence(spark, d):
    spec = spectral.spectra(spectral.framed(_rows(spark, d), 32, 32, "f"), 32, "hann", keys=("f",))
    other = spec.where("f >= 8").withColumn("f", F.col("f") - 8)
    return spectral.cross(spec.where("f < 8"), other, "f").select("f", "k", r("coherence").alias("coherence"))


@query(_SEG.format(n=64, h=16).replace("(v - avg(v) OVER (PARTITION BY f, b))", "v") + """, im AS (SELECT f AS input, k - 1 AS f, b AS t, ln(1 + sqrt(re * re + im * im)) AS x FROM sp WHERE k > 0)
SELECT input, CAST(f AS INTEGER) AS f, t, round(least(greatest(x, lo), hi), 6) AS v FROM im JOIN (SELECT input, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM im GROUP BY 1) USING (input)""", "grid")
def stft_magnitude(spark, d):
    return spectral.stft_magnitude(_rows(spark, d).withColumnRenamed("f", "input"), 64, 16, "input").withColumn("v", r("v"))


@query("SELECT DISTINCT p_size AS n, round(CASE WHEN p_size < 2 THEN 0 ELSE pow(tanh(1.96 / sqrt(2.0 * p_size - 2)), 2) END, 6) AS c95 FROM part")
def c95_level(spark, d):
    return S.table(spark, d, "part").select(F.col("p_size").alias("n")).distinct().select("n", r(scalars.c95(F.col("n"))).alias("c95"))


_PROBE = """WITH pr AS (SELECT user_id % 6 AS c, CAST(floor((epoch_us(ts) // 1000000 - 1704067200) / 3600) AS BIGINT) // 48 AS w, CAST(floor((epoch_us(ts) // 1000000 - 1704067200) / 3600) AS BIGINT) % 48 AS j, value AS x FROM events),
fx AS (SELECT c, w, k, sum(x * cos(2 * pi() * ((j * k) % 48) / 48)) AS re, -sum(x * sin(2 * pi() * ((j * k) % 48) / 48)) AS im FROM pr CROSS JOIN (SELECT unnest(range(1, 24)) AS k) GROUP BY 1, 2, 3),
st AS (SELECT w, k, n, sqrt(pow(sum(re * cos(n * phi) + im * sin(n * phi)), 2) + pow(sum(im * cos(n * phi) - re * sin(n * phi)), 2)) / count(*) AS amp FROM (SELECT *, """ + _PHI + """ AS phi FROM fx) CROSS JOIN (SELECT unnest(range(-5, 6)) AS n) GROUP BY 1, 2, 3),
dn AS (SELECT w, k, n, amp, amp / tot AS coherence FROM (SELECT *, sum(amp) OVER (PARTITION BY w, k) AS tot, row_number() OVER (PARTITION BY w, k ORDER BY amp DESC, n) AS p FROM st) WHERE p = 1)
"""


def _probes(spark, d):
    """channel (sensor), w (two-day window), k, re, im: spectra of the sensor array, all bins but the constant and the last, where n and -n are alike."""
    hour = F.floor((F.unix_seconds("ts") - S.EPOCH) / 3600)
    x = S.table(spark, d, "events").select((F.col("user_id") % 6).alias("channel"), F.floor(hour / 48).alias("w"), (hour % 48).alias("i"), F.col("value").alias("x"))
    return spectral.dft_power(x, 48, 24, "channel", "w").where("k > 0")


def _amplitudes(spark, d):
    return modes.steering(_probes(spark, d), ANGLES, range(-5, 6), "w", "k")


@query(_PROBE + "SELECT w, CAST(k AS INTEGER) AS k, CAST(n AS INTEGER) AS n, round(amp, 4) AS amp FROM st")
def steering_matched_filter(spark, d):
    return _amplitudes(spark, d).select("w", "k", "n", r("amp", 4).alias("amp"))


@query(_PROBE + "SELECT w, CAST(k AS INTEGER) AS k, CAST(n AS INTEGER) AS n, round(amp, 4) AS amp, round(coherence, 6) AS coherence FROM dn")
def n_dominant(spark, d):
    return modes.dominant(_amplitudes(spark, d), "w", "k").select("w", "k", "n", r("amp", 4).alias("amp"), r("coherence").alias("coherence"))


@query(_PROBE + "SELECT w, CAST(n AS INTEGER) AS n, round(sqrt(coalesce(sum(a), 0)), 4) AS rms FROM (SELECT *, (amp * amp + pow(lag(amp) OVER (PARTITION BY w, n ORDER BY k), 2)) / 2 * 0.5 AS a FROM st) GROUP BY 1, 2")
def mode_rms(spark, d):
    return modes.mode_rms(_amplitudes(spark, d), 0.5, "w").select("w", "n", r("rms", 4).alias("rms"))


_MODE_EVENTS = _PROBE + """, g AS (SELECT n, w, max(amp) AS amp, arg_max(k, (amp, -k)) AS pk, sum(coherence) AS c, count(*) AS m, min(k) AS f0, max(k) AS f1 FROM dn WHERE n <> 0 AND coherence >= 0.12 AND amp >= 50 GROUP BY 1, 2),
gr AS (SELECT *, sum(b) OVER (PARTITION BY n ORDER BY w ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN w - lag(w) OVER (PARTITION BY n ORDER BY w) - 1 <= 2 THEN 0 ELSE 1 END AS b FROM g)),
me AS (SELECT CAST(n AS BIGINT) AS n, min(w) AS start, max(w) AS stop, arg_max(pk, (amp, -w)) AS peak_f, round(max(amp), 4) AS peak_amp, round(sum(c) / sum(m), 6) AS mean_coherence, min(f0) AS f_min, max(f1) AS f_max FROM gr GROUP BY n, run HAVING max(w) - min(w) + 1 >= 2)
"""


def _events(spark, d):
    spectrum = modes.dominant(_amplitudes(spark, d), "w", "k").select(F.lit(0).alias("shot"), "w", F.col("k").alias("f"), "n", F.col("coherence").alias("coh"), "amp")
    return events.mode_events(spectrum, "shot", coherence=0.12, amplitude=50.0, max_gap=2, min_length=2)


@query(_MODE_EVENTS + "SELECT n, start, stop, CAST(peak_f AS INTEGER) AS peak_f, peak_amp, mean_coherence, CAST(f_min AS INTEGER) AS f_min, CAST(f_max AS INTEGER) AS f_max FROM me")
def mode_events(spark, d):
    return _events(spark, d).select(F.col("n").cast("long").alias("n"), "start", "stop", "peak_f", r("peak_amp", 4).alias("peak_amp"), r("mean_coherence").alias("mean_coherence"), "f_min", "f_max")


_TS = _PROBE + """, q AS (SELECT w, k, n, atan2(im, re) - n * phi AS dl FROM (SELECT *, """ + _PHI + """ AS phi FROM fx) CROSS JOIN (SELECT unnest(range(1, 6)) AS n)),
mm AS (SELECT w, k, n, atan2(sum(sin(dl)), sum(cos(dl))) AS m FROM q GROUP BY 1, 2, 3)
SELECT w, CAST(k AS INTEGER) AS k, CAST(n AS INTEGER) AS n, round(sum(pow(atan2(sin(dl - m), cos(dl - m)), 2)), 5) AS chi2 FROM q JOIN mm USING (w, k, n) GROUP BY 1, 2, 3"""


@query(_TS)
def timeslice_fit(spark, d):
    phases = _probes(spark, d).select("w", "k", "channel", F.atan2("im", "re").alias("phase"), F.lit(1.0).alias("one"))
    return modes.timeslice_fit(phases.select(F.col("w").alias("win"), "k", "channel", "phase", F.col("one").alias("w")), ANGLES, range(1, 6), "win", "k").select(F.col("win").alias("w"), "k", "n", r("chi2", 5).alias("chi2"))


def _catalogue(spark, d):
    found = _events(spark, d)
    mode = catalogue.record(found, shot=F.col("shot"), diagnostic=F.lit("array"), detector=F.lit("mode"), start=F.col("start"), stop=F.col("stop"), f_low=F.col("f_min"), f_high=F.col("f_max"), n=F.col("n"), amplitude=r("peak_amp", 4))
    elm = events.elm_events(_mask(spark, d), "input", threshold=0.3, activity_min=0.25, min_gap=3)
    burst = catalogue.record(elm, shot=F.col("input"), diagnostic=F.lit("grid"), detector=F.lit("elm"), start=F.floor(F.col("start") / 48), stop=F.floor(F.col("stop") / 48), amplitude=r("peak"))
    return catalogue.union(mode, burst)


_CAT = _MODE_EVENTS.rstrip() + ",\n" + S.SQL["grid"] + ",\n" + S.SQL["score"] + _ELM + """, cat AS (SELECT 0 AS shot, 'array' AS diagnostic, 'mode' AS detector, start, stop, CAST(f_min AS DOUBLE) AS f_low, CAST(f_max AS DOUBLE) AS f_high, n, peak_amp AS amplitude FROM me
UNION ALL SELECT 0, 'grid', 'elm', start // 48, stop // 48, NULL, NULL, NULL, peak FROM elm)
"""


@query(_CAT + "SELECT detector, diagnostic, start, stop, f_low, f_high, n, amplitude FROM cat")
def catalogue_union(spark, d):
    return _catalogue(spark, d).select("detector", "diagnostic", "start", "stop", "f_low", "f_high", "n", "amplitude")


@query(_CAT + "SELECT start, stop, n, f_low, f_high FROM cat c WHERE detector = 'mode' AND n = -5 AND f_low <= 6 AND f_high >= 2 AND NOT EXISTS (SELECT 1 FROM cat e WHERE e.detector = 'elm' AND e.amplitude > 0.45 AND e.start <= c.stop AND c.start <= e.stop)")
def catalogue_find_n_band_no_elm(spark, d):
    all_ = staging.settled(_catalogue(spark, d).where("detector <> 'elm' OR amplitude > 0.45"), "catalogue")
    return catalogue.find(all_, n=-5, band=(2.0, 6.0)).transform(lambda rows: events.overlapping(rows, all_.where("detector = 'elm'"), 4, "shot", how="left_anti")).select("start", "stop", "n", "f_low", "f_high")


@query(_CAT + "SELECT b AS bucket, count(DISTINCT diagnostic) AS diagnostics, count(*) AS records FROM (SELECT diagnostic, unnest(range(start // 2, stop // 2 + 1)) AS b FROM cat) GROUP BY 1 HAVING count(DISTINCT diagnostic) >= 2")
def catalogue_cross_diagnostic(spark, d):
    return catalogue.confirmed(_catalogue(spark, d), bucket=2).select("bucket", "diagnostics", "records")


@query("SELECT p_partkey, sha256(concat_ws(';', 'p_brand=' || coalesce(p_brand, 'null'), 'p_size=' || coalesce(CAST(p_size AS VARCHAR), 'null'))) AS hash FROM part")
def params_hash(spark, d):
    return staging.params_hashes(S.table(spark, d, "part"), "p_size", "p_brand").select("p_partkey", "hash")


@query("""WITH n AS (SELECT doc_id, 0 AS i, 0 AS x, 0 AS y FROM documents WHERE false), c AS (SELECT conv_id, turn AS i, turn * 3 AS x, length(text) % 40 AS y FROM conversations),
s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT DISTINCT conv_id, t, CAST(floor(py + CASE WHEN x = px THEN 1.0 ELSE least(greatest((t - px) / (x - px), 0.0), 1.0) END * (y - py)) AS BIGINT) AS f FROM (SELECT *, unnest(range(least(px, x), greatest(px, x) + 1)) AS t FROM s WHERE px IS NOT NULL)""")
def annotation_raster(spark, d):
    nodes = S.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("i"), (F.col("turn") * 3).alias("x"), (F.length("text") % 40).alias("y"))
    return grids.polyline_cells(nodes, "conv_id").select("conv_id", "t", "f")


def _sensors(spark, d):
    hour = F.floor((F.unix_seconds("ts") - S.EPOCH) / 3600)
    ev = S.table(spark, d, "events").groupBy((F.col("user_id") % 6).cast("int").alias("channel"), hour.alias("i")).agg(F.sum("value").alias("x"))
    return sysid.channel_blocks(ev.withColumn("input", F.lit(0)), 240, 120, 6, "input")


@query(None)
def ar_assess(spark, d):
    return sysid.ar_assessment(_sensors(spark, d), 4)


@query(None)
def arpca_models(spark, d):
    return sysid.arpca_poles(_sensors(spark, d), 6, 3, 1.0)


@query(None)
def ssi_poles(spark, d):
    return sysid.ssi_poles(_sensors(spark, d), 8, 8, 1.0)


@query(None)
def stable_poles(spark, d):
    blocks = _sensors(spark, d)
    return sysid.stable_poles(sysid.ssi_poles(blocks, 8, 6, 1.0), sysid.ssi_poles(blocks, 8, 10, 1.0), 0.05, "input", "block")


@query("""SELECT channel, round(a / b, 6) AS coefficient, round(greatest(0, 1 - sqrt(greatest(y - a / b * a, 0) / y)), 6) AS daf FROM (SELECT channel, sum(c * p) AS a, sum(p * p) AS b, sum(c * c) AS y FROM
(SELECT *, lag(c) OVER (PARTITION BY channel ORDER BY i) AS p FROM (SELECT channel, i, x - avg(x) OVER (PARTITION BY channel) AS c FROM sig)) WHERE p IS NOT NULL GROUP BY 1)""", "sig")
def ar1_assess(spark, d):
    return sysid.ar1(S.signal(spark, d), "channel").select("channel", r("coefficient").alias("coefficient"), r("daf").alias("daf"))

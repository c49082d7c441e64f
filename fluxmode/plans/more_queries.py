"""Queries over windows, profiles, physics, filters, losses and similarity graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics, scalars
from ..operators import events, filters, frames, grids, metrics, scoring, similarity, spectral, stats
from ..sources import standins as S
from .grid_queries import _P, _SEG, _p, _rows
from .signal_queries import query, r
from .vector_queries import _ALL_KNN, _D2, _DOT, K, QUERY_STEP, reciprocal


@query("SELECT channel, i // 24 AS win, i, round(x, 4) AS x FROM hourly JOIN (SELECT DISTINCT channel, i // 24 AS w FROM hourly WHERE x > 300) k USING (channel) WHERE i // 24 = k.w", "hourly")
def state_nonempty_windows(spark, d):
    h = S.hourly(spark, d).withColumn("win", F.floor(F.col("i") / 24)).withColumn("state", F.col("x") > 300)
    return frames.nonempty(h, "state", "channel", "win").select("channel", "win", "i", r("x", 4).alias("x"))


@query("SELECT channel, b AS win, i - b * 4 AS j, x FROM sig JOIN (SELECT channel, unnest(range(0, (max(i) - 9) // 4 + 1)) AS b FROM sig GROUP BY channel HAVING max(i) >= 9) USING (channel) WHERE i BETWEEN b * 4 AND b * 4 + 9", "sig")
def split_samples(spark, d):
    return frames.blocks(S.signal(spark, d), 10, 4, "channel").select("channel", F.col("block").alias("win"), "j", "x")


@query("SELECT i, count(*) AS n, round(avg(x), 4) AS x FROM hourly WHERE channel IN ('click', 'view') GROUP BY 1 HAVING count(*) = 2", "hourly")
def merge_average(spark, d):
    return frames.averaged(S.hourly(spark, d).where("channel IN ('click', 'view')"), "channel", "i").select("i", "n", r("x", 4).alias("x"))


@query("SELECT channel, min(i) AS start, max(i) AS stop, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY channel ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY channel ORDER BY i) - 1 <= 2 THEN 0 ELSE 1 END AS b FROM sig WHERE x > 60)) GROUP BY channel, run", "sig")
def fill_gaps_runs(spark, d):
    return events.islands(S.signal(spark, d).where("x > 60"), 2, "channel", by="i").drop("run")


_BLOCKS = ", e AS (SELECT channel, max(i) AS last FROM hourly GROUP BY 1), p AS (SELECT h.channel, b AS block, i, x FROM hourly h JOIN (SELECT channel, unnest(range(0, (last - 239) // 120 + 1)) AS b FROM e WHERE last >= 239) k ON h.channel = k.channel AND i BETWEEN b * 120 AND b * 120 + 239)\n"


@query(_BLOCKS + "SELECT channel, round(median(r), 6) AS r FROM (SELECT channel, block, avg(abs(r)) AS r FROM (SELECT a.channel, a.block, b.channel AS other, coalesce(corr(a.x, b.x), 0) AS r FROM p a JOIN p b ON a.block = b.block AND a.i = b.i AND a.channel <> b.channel GROUP BY ALL) GROUP BY 1, 2) GROUP BY 1", "hourly")
def corr_assess_blocks(spark, d):
    parts = frames.blocks(S.hourly(spark, d), 240, 120, "channel")
    return stats.block_correlations(parts).groupBy("channel").agg(r(F.median("r")).alias("r"))


@query(_SEG.format(n=32, h=32).replace("(v - avg(v) OVER (PARTITION BY f, b))", "v") + """, z AS (SELECT x.f, x.b, x.k, x.re * x.re + x.im * x.im AS xx, y.re * y.re + y.im * y.im AS yy, x.re * y.re + x.im * y.im AS re, x.im * y.re - x.re * y.im AS im FROM sp x JOIN sp y ON y.f = x.f + 8 AND x.b = y.b AND x.k = y.k),
g AS (SELECT a.f, a.b, a.k, sum(pow(0.9, a.b - c.b) * c.xx) AS xx, sum(pow(0.9, a.b - c.b) * c.yy) AS yy, sum(pow(0.9, a.b - c.b) * c.re) AS re, sum(pow(0.9, a.b - c.b) * c.im) AS im FROM z a JOIN z c ON a.f = c.f AND a.k = c.k AND c.b BETWEEN a.b - 64 AND a.b GROUP BY 1, 2, 3)
SELECT f, b AS block, CAST(k AS INTEGER) AS k, round(least(1, (re * re + im * im) / greatest(xx * yy, 1e-15)), 5) AS coherence FROM g""", "grid")
def coherence_forgetting(spark, d):
    spec = spectral.spectra(spectral.framed(_rows(spark, d), 32, 32, "f"), 32, "hann", keys=("f",))
    other = spec.where("f >= 8").withColumn("f", F.col("f") - 8)
    return spectral.forgetting_coherence(spec.where("f < 8"), other, 0.9, 64, "f").select("f", "block", "k", r("coherence", 5).alias("coherence"))


_CROSS = ", s AS (SELECT *, lead(i) OVER (PARTITION BY channel ORDER BY i) AS i1, lead(x) OVER (PARTITION BY channel ORDER BY i) AS x1 FROM hourly), c AS (SELECT channel, i + (250 - x) / (x1 - x) * (i1 - i) AS place FROM s WHERE x1 IS NOT NULL AND ((x - 250) * (x1 - 250) < 0 OR (x = 250 AND x1 <> 250)))\n"


@query(_CROSS + "SELECT channel, round(min(place), 5) AS inner_at, round(max(place), 5) AS outer_at FROM c GROUP BY 1", "hourly")
def q_surface_crossing(spark, d):
    h = S.hourly(spark, d)
    last = frames.crossings(h, 250.0, "channel", last=True).withColumnRenamed("at", "outer_at")
    return frames.crossings(h, 250.0, "channel").join(last, "channel").select("channel", r("at", 5).alias("inner_at"), r("outer_at", 5).alias("outer_at"))


_MU0 = "(4e-7 * pi())"


@query(f"""WITH p AS (SELECT p_partkey, p_size / 100.0 AS w, p_retailprice / 2000.0 AS rs, p_size * 1e-4 AS rho FROM part)
SELECT p_partkey, round({_MU0} * rs * rs / (1.22 * 1e-7), 4) AS tau, round(CASE WHEN rs = 0 OR w * w + rho * rho <= 0 THEN 0 ELSE (0.5 / rs) * (rs / 0.3) * (rs / 0.2) * w / (w * w + rho * rho) END, 4) AS drive,
round(-{_MU0} * 1.7 * 2 / 0.3 * 1e5 * 0.05 * tanh(w / 0.05) / w, 4) + 0.0 AS eccd, round(4 * sqrt(rs * (1e-3 * 0.9 * pow(rs / 0.9, 2)) / (2 * 0.3)), 6) AS seed, round({_MU0} * 1e6 / (2 * pi() * rs * 1.8), 6) AS poloidal FROM p WHERE w > 0 AND rs > 0""")
def mre_terms(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", (F.col("p_size") / 100.0).alias("w"), (F.col("p_retailprice") / 2000.0).alias("rs"), (F.col("p_size") * 1e-4).alias("rho")).where("w > 0 AND rs > 0")
    w, rs, n = F.col("w"), F.col("rs"), F.lit
    return p.select(
        "p_partkey", r(physics.resistive_time(n(1e-7), rs), 4).alias("tau"), r(physics.bootstrap_drive(w, n(0.5), rs, n(0.3), n(0.2), F.col("rho")), 4).alias("drive"),
        r(physics.current_drive(n(1e5), n(0.3), n(2.0), n(1.7), w, n(0.05)), 4).alias("eccd"), r(physics.seed_width(n(1e-3), n(0.9), rs, n(0.3))).alias("seed"), r(physics.poloidal_field(n(1e6), rs)).alias("poloidal"),
    )


_BLUR = """, k AS (SELECT k, exp(-0.5 * pow(k / 2.0, 2)) AS w FROM (SELECT unnest(range(-8, 9)) AS k)),
s AS (SELECT g.f, g.t, CASE WHEN g.t + k < 0 THEN -1 - (g.t + k) WHEN g.t + k > 719 THEN 1439 - (g.t + k) ELSE g.t + k END AS u, w / (SELECT sum(w) FROM k) AS w FROM grid g CROSS JOIN k)
SELECT s.f, s.t, round(sum(s.w * g.v), 4) AS v FROM s JOIN grid g ON g.f = s.f AND g.t = s.u GROUP BY 1, 2"""


@query(_BLUR, "grid")
def gaussian_blur(spark, d):
    return grids.blurred(S.grid(spark, d), 2.0).select("f", "t", r("v", 4).alias("v"))


_W = "OVER (PARTITION BY f ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(f"SELECT f, t, max(v) {_W} AS v FROM (SELECT f, t, min(v) {_W} AS v FROM (SELECT f, t, min(v) {_W} AS v FROM (SELECT f, t, max(v) {_W} AS v FROM grid)))", "grid")
def grey_close_open(spark, d):
    return grids.opened_closed(S.grid(spark, d), 2)


@query("SELECT f, t, round(1 / (1 + exp(-(v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6))), 6) AS p FROM grid WINDOW w AS (PARTITION BY f)", "grid")
def score_surrogate(spark, d):
    return scoring.surrogate(S.grid(spark, d), "f").select("f", "t", r("p").alias("p"))


@query("SELECT DISTINCT conv_id, a AS tpatch, b AS fpatch FROM (SELECT conv_id, turn * 3 AS x, length(text) % 40 AS y FROM conversations) c, (SELECT unnest(range(20)) AS a), (SELECT unnest(range(16)) AS b) WHERE x >= a * 2 AND x < a * 2 + 8 AND y >= b * 2.5 AND y < b * 2.5 + 5")
def patch_membership(spark, d):
    nodes = S.table(spark, d, "conversations").select("conv_id", (F.col("turn") * 3).alias("x"), (F.length("text") % 40).alias("y"))
    both = frames.patches(frames.patches(nodes, "x", 8, 2, 20, "tpatch"), "y", 5, 2.5, 16, "fpatch")
    return both.select("conv_id", "tpatch", "fpatch").distinct()


@query("""WITH e AS (SELECT user_id, event_type AS source, event_id, array_position(['purchase', 'signup', 'click'], event_type) AS p FROM events WHERE event_type IN ('purchase', 'signup', 'click'))
SELECT user_id, source, event_id FROM e QUALIFY p = min(p) OVER (PARTITION BY user_id)""")
def preferred_source(spark, d):
    e = S.table(spark, d, "events").select("user_id", F.col("event_type").alias("source"), "event_id")
    return frames.preferred(e, ["purchase", "signup", "click"], "source", "user_id")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS repeated FROM (SELECT DISTINCT doc_id FROM documents)")
def oof_coverage(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id").distinct()
    folds = metrics.folds(docs, "doc_id", 5)
    out = None
    for k in range(5):  # each fold is predicted by the model that has not seen it
        part = folds.where(F.col("fold") == k).select("doc_id", F.lit(k).alias("model"))
        out = part if out is None else out.union(part)
    return metrics.coverage(out, docs, "doc_id")


@query(f"SELECT source, round(1 - (2 * sum(p * quality) + 1) / (sum(p) + sum(quality) + 1), 6) AS dice_loss, round(1 - (sum(p * quality) + 1) / (sum(p) + sum(quality) - sum(p * quality) + 1), 6) AS iou_loss, round(avg(-((quality * 0.9 + 0.1) * ln(p) + (1 - (quality * 0.9 + 0.1)) * ln(1 - p))), 6) AS smooth_ce FROM (SELECT *, {_P} AS p FROM pairs) GROUP BY 1", "pairs")
def overlap_losses(spark, d):
    pairs = S.pairs(spark, d)
    smooth = pairs.groupBy("source").agg(r(F.avg(scalars.smoothed_cross_entropy(_p(), F.col("quality"), 0.1))).alias("smooth_ce"))
    losses = metrics.overlap_losses(pairs, _p(), F.col("quality"), "source")
    return losses.join(smooth, "source").select("source", r("dice_loss").alias("dice_loss"), r("iou_loss").alias("iou_loss"), "smooth_ce")


_COS = _DOT.format(a="q", b="x") + " / sqrt(" + _DOT.format(a="q", b="q") + ") / sqrt(" + _DOT.format(a="x", b="x") + ")"


@query(f"SELECT query, id, round(s, 5) AS similarity FROM (SELECT q.vec_id AS query, x.vec_id AS id, {_COS} AS s FROM embeddings q JOIN embeddings x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id) WHERE s >= 0.15")
def epsilon_graph(spark, d):
    rows = S.table(spark, d, "embeddings")
    return similarity.within(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0), 0.15).withColumn("similarity", r("similarity", 5))


@query(f"SELECT query, id, round(exp(-d2 / 2.0), 5) AS weight FROM (SELECT q.vec_id AS query, x.vec_id AS id, {_D2.format(a='q', b='x')} AS d2, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D2.format(a='q', b='x')}, x.vec_id) AS n FROM embeddings q JOIN embeddings x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id) WHERE n <= 10")
def gaussian_similarity(spark, d):
    rows = S.table(spark, d, "embeddings")
    found = similarity.nearest(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0), K, "euclidean")
    return found.select("query", "id", r(similarity.gaussian(F.col("similarity"), 1.0), 5).alias("weight"))


@query(_ALL_KNN + " SELECT a.query, a.id, round(a.similarity * CASE WHEN b.id IS NULL THEN 1 ELSE 4 END, 5) AS similarity FROM k a LEFT JOIN k b ON a.query = b.id AND a.id = b.query WHERE a.query % 100 = 0")
def krnn_enhance(spark, d):
    return similarity.boosted(reciprocal(spark, d)).select("query", "id", r("similarity", 5).alias("similarity"))


def _signals(spark, d):
    """f and the row's values in time order: one row a signal."""
    x = F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"])
    return S.grid(spark, d).groupBy("f").agg(x.alias("x"))


@query(None)
def butterworth_filter(spark, d):
    y = filters.filtered(_signals(spark, d), "low", 0.2, 2, keys=("f",))
    return y.select("f", F.posexplode("y").alias("t", "y")).select("f", "t", r("y").alias("y"))


@query(None)
def band_rms(spark, d):
    y = filters.filtered(_signals(spark, d), "band", (0.05, 0.25), 4, keys=("f",))
    return y.select("f", r(F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v) / F.size("y"))).alias("rms"))


@query(None)
def baseline_columns(spark, d):
    """Baseline along frequency of each column of the grid."""
    x = F.transform(F.array_sort(F.collect_list(F.struct("f", "v"))), lambda s: s["v"])
    columns = S.grid(spark, d).groupBy("t").agg(x.alias("x"))
    return filters.baselines(columns, 100.0, keys=("t",)).select("t", F.posexplode("y").alias("f", "y")).select("t", "f", r("y", 4).alias("y"))

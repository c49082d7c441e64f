"""Queries over signals: the operators of stats, frames and events applied to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import events, frames, stats
from ..sources import standins as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *ctes: str):
    """Register a query with its SQL over the named stand-ins."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (S.cte(*ctes) if ctes else "") + "\n" + sql
        return f

    return put


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0 makes -0 a 0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


@query("SELECT channel, i, round(t, 6) AS t, x FROM sig", "sig")
def signal_long(spark, d):
    return S.signal(spark, d).withColumn("t", r("t"))


@query("SELECT channel, i, round(x - avg(x) OVER (PARTITION BY channel), 10) + 0.0 AS centred FROM sig", "sig")
def demean_block(spark, d):
    return stats.demean(S.signal(spark, d), "channel").select("channel", "i", r("centred", 10).alias("centred"))


@query("SELECT channel, i, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-6), 6) + 0.0 AS z FROM sig WINDOW w AS (PARTITION BY channel)", "sig")
def zscore_channel(spark, d):
    return stats.zscore(S.signal(spark, d), "channel").select("channel", "i", r("z").alias("z"))


@query("SELECT channel, i, round(ln(1 + x), 6) + 0.0 AS y FROM sig", "sig")
def log1p_scale(spark, d):
    return S.signal(spark, d).select("channel", "i", r(scalars.log_scale(F.col("x"))).alias("y"))


@query("SELECT channel, i, round(least(greatest(x, lo), hi), 6) + 0.0 AS clipped FROM sig JOIN (SELECT channel, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM sig GROUP BY 1) USING (channel)", "sig")
def percentile_clip(spark, d):
    return stats.percentile_clip(S.signal(spark, d), "channel").select("channel", "i", r("clipped").alias("clipped"))


_ROBUST = ", m AS (SELECT channel, median(x) AS med FROM sig GROUP BY 1), rs AS (SELECT channel, med, 1.4826 * median(abs(x - med)) + 1e-6 AS scale FROM sig JOIN m USING (channel) GROUP BY 1, 2)\n"


@query(_ROBUST + "SELECT channel, round(med, 6) AS median, round(scale, 6) AS scale FROM rs", "sig")
def robust_stats(spark, d):
    return stats.robust_stats(S.signal(spark, d), "channel").select("channel", r("median").alias("median"), r("scale").alias("scale"))


@query(_ROBUST + "SELECT channel, i, round(0.5 * asinh((x - med) / (0.5 * scale)), 6) + 0.0 AS y FROM sig JOIN rs USING (channel)", "sig")
def asinh_norm(spark, d):
    sig = S.signal(spark, d)
    both = sig.join(stats.robust_stats(sig, "channel"), "channel")
    return both.select("channel", "i", r(scalars.asinh_norm(F.col("x"), 0.5, F.col("median"), F.col("scale"))).alias("y"))


@query("SELECT channel, i, x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) AS outlier FROM sig JOIN (SELECT channel, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM sig GROUP BY 1) USING (channel)", "sig")
def outlier_iqr(spark, d):
    return stats.outliers_iqr(S.signal(spark, d), "channel", k=1.5).select("channel", "i", "outlier")


@query("SELECT channel, i, abs(x - avg(x) OVER w) > 2 * stddev_pop(x) OVER w AS outlier FROM sig WINDOW w AS (PARTITION BY channel)", "sig")
def outlier_zscore(spark, d):
    return stats.outliers_zscore(S.signal(spark, d), "channel", k=2.0).select("channel", "i", "outlier")


@query(", m AS (SELECT channel, median(x) AS med FROM sig GROUP BY 1), q AS (SELECT channel, median(abs(x - med)) AS mad FROM sig JOIN m USING (channel) GROUP BY 1)\nSELECT channel, i, abs(0.6745 * (x - med) / (mad + 1e-12)) > 3 AS outlier FROM sig JOIN m USING (channel) JOIN q USING (channel)", "sig")
def outlier_mad(spark, d):
    return stats.outliers_mad(S.signal(spark, d), "channel").select("channel", "i", "outlier")


@query("SELECT channel, round(CASE WHEN count(*) <= 10 THEN 1.0 ELSE var_pop(x) / (var_pop(e) / 2 + 1e-12) END, 6) AS snr FROM (SELECT *, x - lag(x) OVER (PARTITION BY channel ORDER BY i) AS e FROM sig) GROUP BY 1", "sig")
def snr_estimate(spark, d):
    return stats.snr(S.signal(spark, d), "channel").select("channel", r("snr").alias("snr"))


@query(", s AS (SELECT *, lead(t) OVER (PARTITION BY channel ORDER BY i) - t AS dt FROM sig)\nSELECT channel, i, round(t, 3) AS t, round(dt, 3) AS dt FROM s JOIN (SELECT channel, median(dt) AS m FROM s GROUP BY 1) USING (channel) WHERE dt > 2 * m", "sig")
def time_gaps(spark, d):
    return stats.time_gaps(S.signal(spark, d), "channel").select("channel", "i", r("t", 3).alias("t"), r("dt", 3).alias("dt"))


@query("SELECT channel, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS low, max(x) AS high, round(median(x), 6) AS median, round(max(t) - min(t), 3) AS span FROM sig GROUP BY 1", "sig")
def channel_statistics(spark, d):
    s = stats.channel_statistics(S.signal(spark, d), "channel")
    return s.select("channel", "n", r("mean").alias("mean"), r("std").alias("std"), "low", "high", r("median").alias("median"), r("span", 3).alias("span"))


@query(", k AS (SELECT channel, x, row_number() OVER (PARTITION BY channel ORDER BY x) - 1 AS p, count(*) OVER (PARTITION BY channel) AS n FROM sig)\nSELECT channel, CAST(q AS DOUBLE) AS q, x FROM k JOIN (SELECT unnest([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]) AS q) ON p = round_even(CAST(q AS DOUBLE) * (n - 1), 0)", "sig")
def qplot_quantiles(spark, d):
    return stats.order_quantiles(S.signal(spark, d), "channel")


@query("SELECT channel, round(sqrt(sum((1 + i % 3) * x * x) / sum(1 + i % 3)), 6) AS rms FROM sig GROUP BY 1", "sig")
def weighted_rms(spark, d):
    return stats.weighted_rms(S.signal(spark, d).withColumn("w", 1 + F.col("i") % 3), "channel").select("channel", r("rms").alias("rms"))


@query("SELECT channel, median(x) AS median FROM (SELECT channel, x, row_number() OVER (PARTITION BY channel ORDER BY x) AS k, count(*) OVER (PARTITION BY channel) AS n FROM sig) WHERE k = (n + 1) // 2 GROUP BY 1", "sig")
def lower_median(spark, d):
    return stats.lower_median(S.signal(spark, d), "channel")


@query("SELECT channel, count_if(e = 0) AS repeated, count_if(e < 0) AS falling, count_if(x IS NULL) AS missing FROM (SELECT *, t - lag(t) OVER (PARTITION BY channel ORDER BY i) AS e FROM sig) GROUP BY 1", "sig")
def validate_series(spark, d):
    return stats.validation(S.signal(spark, d), "channel").select("channel", "repeated", "falling", "missing")


@query("SELECT channel, count(*) AS n, min(x) AS low, max(x) AS high, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS q2, round(quantile_cont(x, 0.75), 6) AS q3, count_if(x = 0) AS zeros FROM sig GROUP BY 1", "sig")
def array_profile(spark, d):
    return stats.array_profile(S.signal(spark, d), "channel").select("channel", "n", "low", "high", *(r(q).alias(q) for q in ("q1", "q2", "q3")), "zeros")


@query("SELECT a.channel AS a, b.channel AS b, count(*) AS n, round(coalesce(corr(a.x, b.x), 0.0), 6) + 0.0 AS r FROM hourly a JOIN hourly b ON a.i = b.i AND a.channel < b.channel GROUP BY 1, 2", "hourly")
def pairwise_correlation(spark, d):
    return stats.correlations(S.hourly(spark, d)).withColumn("r", r("r"))


@query("SELECT channel, i, round(x - 0.99 * coalesce(lag(x) OVER (PARTITION BY channel ORDER BY i), 0.0), 6) + 0.0 AS y FROM sig", "sig")
def preemphasis(spark, d):
    return frames.preemphasis(S.signal(spark, d), "channel").select("channel", "i", r("y").alias("y"))


@query("SELECT channel, i, round(sum(x) OVER (PARTITION BY channel ORDER BY i), 4) AS total FROM sig", "sig")
def cumulative_sum(spark, d):
    return frames.cumulative_sum(S.signal(spark, d), "channel").select("channel", "i", r("total", 4).alias("total"))


@query("SELECT channel, i, round(sum(a) OVER (PARTITION BY channel ORDER BY i), 4) AS area FROM (SELECT *, coalesce((x + lag(x) OVER (PARTITION BY channel ORDER BY i)) / 2, 0) AS a FROM sig)", "sig")
def cumulative_trapezoid(spark, d):
    return frames.cumulative_trapezoid(S.signal(spark, d), "channel").select("channel", "i", r("area", 4).alias("area"))


@query("SELECT channel, i, round(CASE WHEN p IS NULL THEN n - x WHEN n IS NULL THEN x - p ELSE (n - p) / 2 END, 6) + 0.0 AS slope FROM (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS n FROM sig WINDOW w AS (PARTITION BY channel ORDER BY i))", "sig")
def gradient_time(spark, d):
    return frames.gradient(S.signal(spark, d), "channel").select("channel", "i", r("slope").alias("slope"))


@query("SELECT channel, i, max(abs(x)) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS envelope FROM sig", "sig")
def rolling_max_envelope(spark, d):
    return frames.rolling_max(S.signal(spark, d), 5, "channel").select("channel", "i", "envelope")


@query("SELECT channel, i, round(avg(x) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM sig", "sig")
def rolling_mean(spark, d):
    return frames.rolling_mean(S.signal(spark, d), 7, "channel").select("channel", "i", r("smooth").alias("smooth"))


@query("SELECT a.channel, a.i, round(sum(0.2 * pow(0.8, a.i - b.i) * b.x), 6) AS y FROM sig a JOIN sig b ON a.channel = b.channel AND b.i BETWEEN a.i - 64 AND a.i GROUP BY 1, 2", "sig")
def forgetting_filter(spark, d):
    return frames.forgetting(S.signal(spark, d), 0.8, 64, "channel").select("channel", "i", r("y").alias("y"))


_TM = """, e AS (SELECT *, max(abs(x)) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS env FROM sig),
o AS (SELECT *, i - row_number() OVER (PARTITION BY channel ORDER BY i) AS g FROM e WHERE env > 60),
ev AS (SELECT channel, min(i) AS start, max(i) AS stop, max(abs(x)) AS peak FROM o GROUP BY channel, g HAVING max(i) - min(i) + 1 >= 3)
"""


@query(_TM + "SELECT * FROM ev", "sig")
def tm_events(spark, d):
    return events.threshold_events(S.signal(spark, d), 60.0, 3, 2, "channel")


@query(_TM + "SELECT channel, min(start) AS onset FROM ev GROUP BY 1", "sig")
def tm_onset(spark, d):
    return events.onset(tm_events(spark, d), "channel")


@query(""", n AS (SELECT channel, max(i) AS last FROM sig GROUP BY 1), b AS (SELECT channel, unnest(range(0, (last - 15) // 8 + 1)) AS block FROM n WHERE last >= 15)
SELECT b.channel, b.block, count(*) AS n, round((min(t) + max(t)) / 2, 3) AS centre, round(avg(x), 6) AS mean, round(sqrt(avg(x * x)), 6) AS rms
FROM b JOIN sig ON sig.channel = b.channel AND i BETWEEN block * 8 AND block * 8 + 15 GROUP BY 1, 2""", "sig")
def frame_blocks(spark, d):
    b = frames.block_statistics(S.signal(spark, d), 16, 8, "channel")
    return b.select("channel", "block", "n", r("centre", 3).alias("centre"), r("mean").alias("mean"), r("rms").alias("rms"))


@query(""", n AS (SELECT channel, count(*) AS n FROM sig GROUP BY 1), f AS (SELECT channel, n, CAST(1 + round_even((n - 16) / 10.0, 0) AS BIGINT) AS frames FROM n WHERE n >= 16)
SELECT channel, k, CAST(round_even(k * (n - 16) / CAST(greatest(frames - 1, 1) AS DOUBLE), 0) AS BIGINT) AS start FROM (SELECT *, unnest(range(0, frames)) AS k FROM f)""", "sig")
def fuzzy_frames(spark, d):
    return frames.fuzzy_frames(S.signal(spark, d).groupBy("channel").agg(F.count("*").alias("n")), 16, 10.0, "channel")


@query(""", g AS (SELECT channel, min(t) AS a, max(t) AS z, CAST(floor((max(t) - min(t)) * 0.001) AS BIGINT) AS n FROM sig GROUP BY 1),
k AS (SELECT channel, k, a + k * ((z - a) / greatest(n, 1)) AS tk FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM g)),
s AS (SELECT *, lead(t) OVER (PARTITION BY channel ORDER BY t) AS t1, lead(x) OVER (PARTITION BY channel ORDER BY t) AS x1 FROM sig)
SELECT k.channel, k.k, round(s.x + coalesce((s.x1 - s.x) * (tk - s.t) / (s.t1 - s.t), 0), 4) AS x FROM k ASOF JOIN s ON k.channel = s.channel AND s.t <= k.tk + 1e-6""", "sig")
def resample_linear(spark, d):
    return frames.resampled(S.signal(spark, d), 0.001, "channel").select("channel", "k", r("x", 4).alias("x"))


@query("SELECT i, count(*) AS n, round(sum(x), 4) AS total, round(avg(x), 4) AS mean FROM hourly GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT channel) FROM hourly)", "hourly")
def align_intersection(spark, d):
    return frames.aligned(S.hourly(spark, d)).select("i", "n", r("total", 4).alias("total"), r("mean", 4).alias("mean"))


@query("SELECT i, count(*) AS n, round(sum(x), 4) AS total, round(avg(x), 4) AS mean FROM hourly GROUP BY 1", "hourly")
def align_union(spark, d):
    return frames.aligned(S.hourly(spark, d), how="union").select("i", "n", r("total", 4).alias("total"), r("mean", 4).alias("mean"))


@query(""", p AS (SELECT event_type AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i, user_id AS channel, value AS x FROM events),
n AS (SELECT channel, max(i) + 1 AS n FROM p WHERE k = 'click' GROUP BY 1)
SELECT channel, i, x FROM p WHERE k = 'click' UNION ALL SELECT channel, i + coalesce(n, 0), x FROM p LEFT JOIN n USING (channel) WHERE k = 'view'""".replace(", p AS", "WITH p AS", 1))
def merge_concat_time(spark, d):
    w = Window.partitionBy("channel", "k").orderBy("ts", "event_id")
    p = S.table(spark, d, "events").select(F.col("event_type").alias("k"), F.col("user_id").alias("channel"), F.col("value").alias("x"), "ts", "event_id")
    p = p.select("k", "channel", (F.row_number().over(w) - 1).cast("long").alias("i"), "x")
    part = lambda k: p.where(F.col("k") == k).select("channel", "i", "x")
    return frames.concatenated(part("click"), part("view"), "channel")


@query(""", s AS (SELECT channel AS shot, i // 10 AS win, avg(CASE WHEN x > 50 THEN 1.0 ELSE 0.0 END) AS score FROM sig GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY score DESC, win) AS p FROM s WHERE score >= 0.3)
SELECT shot, win, round(score, 6) AS score, row_number() OVER (PARTITION BY shot ORDER BY win) - 1 AS new_window FROM k WHERE p <= 3""", "sig")
def window_topk_per_shot(spark, d):
    s = S.signal(spark, d).groupBy(F.col("channel").alias("shot"), F.floor(F.col("i") / 10).alias("window")).agg(F.avg((F.col("x") > 50).cast("double")).alias("score"))
    k = frames.top_windows(s, 3, 0.3, "shot")
    return k.select("shot", F.col("window").alias("win"), r("score").alias("score"), F.col("new_window").cast("long").alias("new_window"))


@query("SELECT channel, i, x FROM sig WHERE channel NOT IN (SELECT channel FROM sig GROUP BY 1 HAVING stddev_pop(x) < 40)", "sig")
def filter_bad_channels(spark, d):
    sig = S.signal(spark, d)
    bad = sig.groupBy("channel").agg(F.stddev_pop("x").alias("s")).where("s < 40").select("channel")
    return sig.join(bad, "channel", "left_anti").select("channel", "i", "x")


@query("""SELECT c_custkey AS k, t0, t, x FROM (SELECT c_custkey, c_custkey * 997.0 % 2000000 AS t0, p.t, p.x, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(p.t - c_custkey * 997.0 % 2000000), p.t, p.x) AS n
FROM customer LEFT JOIN (SELECT user_id AS ch, epoch_us(ts) / 1000000.0 - 1704067200 AS t, value AS x FROM events) p ON p.ch = c_custkey % 150) WHERE n = 1""")
def asof_nearest(spark, d):
    points = S.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 150).alias("channel"), (F.col("c_custkey") * 997.0 % 2000000).alias("t0"))
    series = S.table(spark, d, "events").select(F.col("user_id").alias("channel"), (F.unix_micros("ts") / 1e6 - S.EPOCH).alias("t"), F.col("value").alias("x"))
    return frames.asof_nearest(points, series, 40000.0, "channel").select("k", "t0", "t", "x")


@query(""", p AS (SELECT user_id, value, epoch_us(ts) / 1000000.0 AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 14400 THEN 0 ELSE 1 END AS n FROM p),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(max(t) - min(t), 3) AS seconds, round(sum(value), 4) AS total FROM s GROUP BY 1, 2""".replace(", p AS", "WITH p AS", 1))
def session_events(spark, d):
    s = events.sessions(S.table(spark, d, "events"), 14400, "user_id", F.unix_micros("ts") / 1e6, "value")
    return s.select("user_id", F.col("session").cast("long").alias("session"), "n", r("seconds", 3).alias("seconds"), r("total", 4).alias("total"))


@query("SELECT path, min(ord) AS first_seen FROM (SELECT regexp_extract(url, '://([^?#]*)', 1) AS path, page_id AS ord FROM pages) GROUP BY 1")
def collect_dedup_first_seen(spark, d):
    pages = S.table(spark, d, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"), F.col("page_id").alias("ord"))
    return pages.groupBy("path").agg(F.min("ord").alias("first_seen"))


@query("SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k, regexp_extract(event_type, '^(.)', 1) AS short FROM events")
def params_json(spark, d):
    ev = S.table(spark, d, "events")
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.regexp_extract("event_type", "^(.)", 1).alias("short"))

"""Queries over modes of blocks: filter diagonalisation, projected models of two orders, robust covariances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modal, spectral, sysid
from ..sources import standins as S
from .grid_queries import _sensors
from .signal_queries import query, r

#: Cycles an hour.
BANDS = [(0.01, 0.06), (0.06, 0.2), (0.2, 0.45)]


@query(None)
def filter_diagonalisation(spark, d):
    return modal.filter_diagonalised(_sensors(spark, d), 80, BANDS, error=2.0)


@query(None)
def filter_diagonalisation_confirmed(spark, d):
    return modal.confirmed_poles(_sensors(spark, d), (80, 64), BANDS, closeness=0.9, confidence=0.4)


@query(""", c AS (SELECT DISTINCT channel FROM hourly), k AS (SELECT unnest(range(513)) AS k),
p AS (SELECT channel, k, coalesce(sum(x * cos(2 * pi() * ((i * k) % 1024) / 1024)), 0) AS re, -coalesce(sum(x * sin(2 * pi() * ((i * k) % 1024) / 1024)), 0) AS im FROM c CROSS JOIN k LEFT JOIN hourly USING (channel) GROUP BY 1, 2)
SELECT channel, CAST(k AS INTEGER) AS k, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM p""", "hourly")
def zero_padded_dft(spark, d):
    """Spectra of the hourly signals, gaps and all, padded to 1024 samples."""
    spec = spectral.spectra(spectral.dense(S.hourly(spark, d), 1024, "channel"), 1024, "none", keys=("channel",))
    return spec.select("channel", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select("channel", "k", r("z.re", 3).alias("re"), r("z.im", 3).alias("im"))


def _found(spark, d, kind):
    reduced = {"principal": -4, "covariance": 4, "canonical": 0}[kind]
    return modal.projected_modes(_sensors(spark, d), (6, 10), past=8, future=8, kind=kind, reduced=reduced, draws=1 if reduced == 0 else 3, mac=0.6, closeness=0.8, seed=3)


@query(None)
def projected_modes(spark, d):
    """Modes that two orders agree on, of three random orthonormal projections and the linear predictor."""
    return _found(spark, d, "principal")


@query(None)
def projected_modes_recurring(spark, d):
    """Of covariance-driven models over Gaussian projections, the modes that two draws or more have; with the centres of their blocks."""
    found = modal.recurring(_found(spark, d, "covariance"), 0.05, 2, "input", "block")
    return modal.harvested(found, 240, 120, 1 / 3600.0, "draw", "place", "draws", "nearest")


@query(None)
def canonical_modes(spark, d):
    return _found(spark, d, "canonical")


@query(None)
def robust_covariance(spark, d):
    return modal.robust_covariance(_sensors(spark, d), 5, "logdet")


_FOLDS = """WITH w AS (SELECT user_id % 6 AS c, CAST(floor((epoch_us(ts) // 1000000 - 1704067200) / 3600) AS BIGINT) AS i, sum(value) AS x FROM events GROUP BY ALL), rows_ AS (SELECT DISTINCT i FROM w),
b AS (SELECT unnest(range(0, ((SELECT max(i) FROM rows_) - 239) // 120 + 1)) AS block),
y AS (SELECT block, c, coalesce(x, 0) AS x, row_number() OVER (PARTITION BY block, c ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY block, c) AS n FROM b JOIN rows_ ON i BETWEEN block * 120 AND block * 120 + 239 CROSS JOIN (SELECT unnest(range(6)) AS c) LEFT JOIN w USING (i, c)),
k AS (SELECT block, fold, c, avg(x) AS m, var_pop(x) AS v, count(*) AS kept FROM y CROSS JOIN (SELECT unnest(range(5)) AS fold) WHERE NOT (j >= round_even(fold * n / 5.0, 0) AND j < round_even((fold + 1) * n / 5.0, 0)) GROUP BY ALL)
"""


@query(_FOLDS + "SELECT block, CAST(fold AS INTEGER) AS fold, CAST(kept AS INTEGER) AS kept, round(score, 2) AS score, round(means, 4) AS mean_sum FROM (SELECT block, fold, any_value(kept) AS kept, sum(v) AS score, sum(m) AS means, row_number() OVER (PARTITION BY block ORDER BY round(sum(v), 6), fold) AS p FROM k WHERE kept > 6 GROUP BY block, fold) WHERE p = 1")
def robust_covariance_by_trace(spark, d):
    """The fold whose absence leaves the least total variance, and the mean over the channels without it."""
    got = modal.robust_covariance(_sensors(spark, d), 5, "trace")
    total = F.aggregate("mean", F.lit(0.0), lambda s, x: s + x)
    return got.select("block", "fold", "kept", r("score", 2).alias("score"), r(total, 4).alias("mean_sum"))


@query(_FOLDS.split("k AS (")[0] + """p AS (SELECT block, c, x, cos(j * 0.2618) AS a, sin(j * 0.2618) AS s FROM y), q AS (SELECT block, c, sum(a * a) AS aa, sum(s * s) AS ss, sum(a * s) AS ay, sum(a * x) AS ax, sum(s * x) AS sx FROM p GROUP BY 1, 2)
SELECT block, CAST(c AS INTEGER) AS channel, round((ax * ss - sx * ay) / (aa * ss - ay * ay), 4) + 0.0 AS re, round((sx * aa - ax * ay) / (aa * ss - ay * ay), 4) + 0.0 AS im FROM q""")
def daily_shapes(spark, d):
    """The shape of each block at one cycle a day, by least squares."""
    return sysid.frequency_shapes(_sensors(spark, d), [0.2618]).select("block", "channel", r("re", 4).alias("re"), r("im", 4).alias("im"))


@query(None)
def covariance_spectra(spark, d):
    return modal.covariance_spectra(_sensors(spark, d))


@query(None)
def innovation_residuals(spark, d):
    return modal.residuals(_sensors(spark, d), 6, 6, 4)


@query(""", c AS (SELECT f, t, v - avg(v) OVER (PARTITION BY f) AS x FROM grid), a AS (SELECT p.f, lag, sum(p.x * q.x) AS value FROM c p CROSS JOIN (SELECT unnest(range(62)) AS lag) JOIN c q ON q.f = p.f AND q.t = p.t + lag GROUP BY 1, 2),
n AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS z, first_value(value) OVER w AS v0 FROM a WINDOW w AS (PARTITION BY f ORDER BY lag)), k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY value DESC, lag) AS r FROM n WHERE lag BETWEEN 1 AND 60 AND value > b AND value > z AND value >= 0.02 * v0)
SELECT f, CAST(lag AS INTEGER) AS lag, round(1.0 / lag, 6) AS frequency, round(value, 3) AS value FROM k WHERE r <= 5""", "grid")
def autocorrelation_peaks(spark, d):
    g = S.grid(spark, d)
    mean = g.groupBy("f").agg(F.avg("v").alias("m"))
    rows = g.join(mean, "f").select("f", F.col("t").alias("i"), (F.col("v") - F.col("m")).alias("x"))
    return modal.autocorrelation_peaks(rows, 60, 0.02, 5, 1.0, "f").select("f", "lag", r("frequency").alias("frequency"), r("value", 3).alias("value"))

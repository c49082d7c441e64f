"""

Each builder has a DataFrame form and the same thing as SQL for the oracle, under the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: 2024-01-01 in seconds, and 1995-01-02.
EPOCH, WEEKS = 1704067200, 788918400
N_HOURS, N_ROWS = 720, 16

SQL = {
    "sig": "sig AS (SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) / 1000000.0 - 1704067200 AS t, value AS x FROM events)",
    "hourly": "hourly AS (SELECT event_type AS channel, CAST(floor((epoch_us(ts) // 1000000 - 1704067200) / 3600) AS BIGINT) AS i, sum(value) AS x FROM events GROUP BY ALL)",
    "grid": "grid AS (SELECT f, t, coalesce(v, 0.0) AS v FROM (SELECT unnest(range(16)) AS f) CROSS JOIN (SELECT unnest(range(720)) AS t) LEFT JOIN (SELECT user_id % 16 AS f, CAST(floor((epoch_us(ts) // 1000000 - 1704067200) / 3600) AS BIGINT) AS t, sum(value) AS v FROM events GROUP BY ALL) USING (f, t))",
    "score": "score AS (SELECT f, t, v, CASE WHEN m > 0 THEN v / m ELSE 0.0 END AS s FROM (SELECT *, max(v) OVER (PARTITION BY f) AS m FROM grid))",
    "weekly": "weekly AS (SELECT l_partkey % 32 AS f, CAST(floor((epoch_us(l_shipdate) // 1000000 - 788918400) / 604800) AS BIGINT) AS t, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL)",
    "modes": "modes AS (SELECT vec_id, label, embedding[1:32] AS re, embedding[33:64] AS im FROM embeddings)",
    "pairs": "pairs AS (SELECT doc_id, quality, toxic, source, n_chars FROM labels JOIN documents USING (doc_id))",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; times without a zone are taken in the session's zone, which the engine expects to be UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def _hour() -> F.Column:
    return F.floor((F.unix_seconds("ts") - EPOCH) / 3600)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel (user), i, t (seconds), x: each user's events in time order."""
    order = Window.partitionBy("channel").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), "ts", "event_id", F.col("value").alias("x"))
    return ev.select("channel", (F.row_number().over(order) - 1).cast("long").alias("i"), (F.unix_micros("ts") / 1e6 - EPOCH).alias("t"), "x")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel (event type), i (hour), x: sums of an hour; hours without events are missing."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("event_type").alias("channel"), _hour().alias("i")).agg(F.sum("value").alias("x"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f (user modulo 16), t (hour), v: a dense grid, 0 where nothing happened."""
    ev = table(spark, sf_dir, "events")
    have = ev.groupBy((F.col("user_id") % N_ROWS).alias("f"), _hour().alias("t")).agg(F.sum("value").alias("v"))
    cells = spark.range(N_ROWS * N_HOURS).select((F.col("id") % N_ROWS).alias("f"), F.floor(F.col("id") / N_ROWS).alias("t"))
    return cells.join(have, ["f", "t"], "left").select("f", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid with s: v against the greatest v of its row, in [0, 1]."""
    top = F.max("v").over(Window.partitionBy("f"))
    return grid(spark, sf_dir).withColumn("s", F.when(top > 0, F.col("v") / top).otherwise(0.0))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f (part modulo 32), t (weeks since 1995-01-02), v: sums of extended price."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_partkey") % 32).alias("f"), F.floor((F.unix_seconds("l_shipdate") - WEEKS) / 604800).alias("t")).agg(F.sum("l_extendedprice").alias("v"))


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, re, im: each embedding as a complex vector of 32."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 32).alias("re"), F.slice("embedding", 33, 32).alias("im"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "quality", "toxic", "source", "n_chars")


def cte(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)

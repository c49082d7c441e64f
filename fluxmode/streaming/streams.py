"""Structured Streaming forms of windows, sessions and the forgetting filter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """A stream of Parquet files with the schema of those there now."""
    schema = spark.read.parquet(path).schema
    df = spark.readStream.schema(schema).parquet(path)
    return df.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(stream: DataFrame, width: str, late: str, *keys: str, time: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums of event-time windows; rows later than the watermark are dropped."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(stream: DataFrame, width: str, step: str, late: str, *keys: str, time: str = "ts", value: str = "value") -> DataFrame:
    g = stream.withWatermark(time, late).groupBy(F.window(time, width, step), *keys)
    return g.agg(F.max(F.abs(value)).alias("envelope")).select(F.col("window.start").alias("start"), *keys, "envelope")


def sessions(stream: DataFrame, gap: str, late: str, key: str, time: str = "ts", value: str = "value") -> DataFrame:
    """Runs of a key's events whose gaps stay below `gap`."""
    g = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def forgetting(stream: DataFrame, factor: float, key: str, time: str = "ts", value: str = "value") -> DataFrame:
    """y = factor * y + (1 - factor) * x along each key's events, its last value kept as state between batches."""

    def step(keys: tuple, parts, state: GroupState):
        y = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(parts)).sort_values("t")
        for x in rows["x"]:
            y = factor * y + (1 - factor) * x
        state.update((float(y),))
        yield pd.DataFrame({"key": [keys[0]], "n": [len(rows)], "y": [float(y)]})

    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(time).cast("timestamp").alias("t"), F.col(value).cast("double").alias("x"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, n long, y double", "y double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, spark: SparkSession, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source holds and returns its sink; for tests and batch use."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)

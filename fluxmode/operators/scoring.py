"""Scoring of images or signals by a model that is plugged in.

A scorer is made once a task by a function that gets the sent model, and maps one array to one array.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def standardised(df: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """value less its image's mean, over its population deviation + 1e-6: column z."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(s, list(keys)).withColumn("z", (F.col(value) - F.col("_m")) / (F.col("_s") + 1e-6)).drop("_m", "_s")


def surrogate(df: DataFrame, *keys: str, gain: float = 1.0, offset: float = 0.0) -> DataFrame:
    """A stand-in for a trained model: the sigmoid of the standardised value, column p."""
    return standardised(df, *keys).withColumn("p", scalars.sigmoid(gain * F.col("z") - offset))


def scored(df: DataFrame, make: Callable, model, *, keys: tuple[str, ...]) -> DataFrame:
    """keys, y: make(model) applied to the array x of each row. A row that fails gets a null y and its error."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*keys, "x")

    def run(batches):
        score = make(sent.value)
        for b in batches:
            out, errors = [], []
            for v in b.column(b.num_columns - 1).to_pylist():
                try:
                    out.append(None if v is None else np.asarray(score(np.array(v, float)), float))
                    errors.append(None)
                except Exception as e:  # one bad row must not end the job
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.float64())), pa.array(errors, pa.string())], [*b.schema.names[:-1], "y", "error"])

    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, types + ", y array<double>, error string")

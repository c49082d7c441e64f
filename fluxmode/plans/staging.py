"""Tables between steps in the folder that the cluster shares, stage state, and parameter hashes."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_fluxmode_staging", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark._fluxmode_staging = tempfile.mkdtemp(prefix="fluxmode-staging-")
    return found.rstrip("/")


def settled(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends here."""
    path = noted(df.sparkSession, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def noted(spark: SparkSession, path: str, table: str | None = None) -> str:
    """path, remembered (with the name of its table, if it has one) for cleared."""
    held = getattr(spark, "_fluxmode_noted", None)
    if held is None:
        held = spark._fluxmode_noted = []
    held.append((path, table))
    return path


def cleared(spark: SparkSession) -> int:
    """Deletes the tables between steps that this session wrote, in whatever store they are, and says how many.

    Results read them until they are written themselves: call it after that.
    """
    held, spark._fluxmode_noted = getattr(spark, "_fluxmode_noted", None) or [], []
    for path, table in held:
        if table is not None:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(held)


def params_hash(params: dict) -> str:
    """A short hash of parameters that does not depend on their order."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def params_hashes(df: DataFrame, *columns: str) -> DataFrame:
    """The same for rows: SHA-256 of name=value pairs in order of name."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(columns)]
    return df.withColumn("hash", F.sha2(F.concat_ws(";", *parts), 256))


def stale(state: DataFrame, order: DataFrame) -> DataFrame:
    """Stages whose upstream ran later, or is not complete. state: step, status, ran_at; order: step, upstream."""
    up = state.select(F.col("step").alias("upstream"), F.col("status").alias("_s"), F.col("ran_at").alias("_r"))
    late = order.join(state, "step").join(up, "upstream", "left")
    bad = late.groupBy("step").agg(F.max((F.col("_s").isNull() | (F.col("_s") != "complete") | (F.col("_r") > F.col("ran_at"))).cast("int")).alias("_bad"))
    return state.join(bad, "step", "left").select("step", F.when((F.col("status") == "complete") & (F.col("_bad") == 1), "stale").otherwise(F.col("status")).alias("status"))

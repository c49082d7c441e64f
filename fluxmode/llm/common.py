"""Shared helpers: shared-folder tables, checkpoints, connected components and span assembly."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import noted

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where it is unset and all runs on one machine (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(spark, "_fluxmode_shared", None)
        if found is None:
            found = tempfile.mkdtemp(prefix="fluxmode-shared-")
            spark._fluxmode_shared = found
    return found.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called that."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name


#: Rows of one key from which on it is dealt over SALTS tasks, and the keys that may be dealt (a broadcast of 8 bytes each).
HOT, MAX_HOT, SALTS = 10_000, 1_000_000, 64


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """many joined with one (a stored table, one row a key) on keys; n: column of one, the rows of many that have the key.

    A key with more than HOT rows, or 1 / MAX_HOT of all rows where that is more, is hot: there are at most MAX_HOT
    of them, which bounds what is broadcast. The rows of a hot key are dealt over SALTS tasks and its row of one is copied to each.
    """
    limit = max(HOT, (one.agg(F.sum(n)).first()[0] or 0) // MAX_HOT)
    hot = one.where(F.col(n) > limit).select(F.xxhash64(*keys).alias("_hot")).distinct()
    if hot.isEmpty():
        return many.join(one, keys, how)
    is_hot = F.xxhash64(*keys) == F.col("_hot")
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = many.join(F.broadcast(hot), is_hot, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = one.join(F.broadcast(hot), is_hot, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors cost no recomputation.

    plans.staging.cleared deletes all such tables of a session, once the results that were made of them are written.
    """
    spark = df.sparkSession
    path = noted(spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b), of one orderable type; component is the least node reachable.

    Alternating large-star and small-star rounds. Each round groups a node's neighbours with a
    partial aggregate (min) only, so a node of very high degree never gathers its neighbours in one
    task: the neighbours are met again by a join that deals a hub's links over tasks. Every round is
    written to the shared folder, and the loop ends when no edge changes. Self-edges only name a node.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).where("node IS NOT NULL")
    now = stored(_oriented(edges), label)
    if now.isEmpty():
        return nodes.distinct().select("node", F.col("node").alias("component"))
    before = None
    for _ in range(max_rounds):
        # large star: link each larger neighbour to the least of the closed neighbourhood
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n")), f"{label}-low")
        large = spread_join(both, low, ["a"], "n").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(_oriented(large), f"{label}-large")
        # small star: link each smaller neighbour, and the node itself, to the least smaller neighbour
        least = stored(large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")), f"{label}-least")
        small = spread_join(large, least, ["a"], "n").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = _oriented(small.union(least.select("a", F.col("low").alias("b"))))
        now = stored(small, label)
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        state = (sums["n"], sums["s"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("component"))
    return (
        nodes.distinct()
        .join(roots, F.col("node") == F.col("a"), "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )


def _oriented(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller end, once each."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

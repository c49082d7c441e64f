"""A third of all rows on one key: the same results when hot keys are dealt over tasks, and no task with the key's rows."""

import random

import pytest
from pyspark.sql import functions as F

from fluxmode.llm import common, decontamination, near_dedup

rng = random.Random(21)
WORDS = [f"w{i}" for i in range(3000)]
BASE = [rng.choice(WORDS) for _ in range(80)]
BENCH = " ".join(f"t{i}" for i in range(20))


def near_copy():
    w = list(BASE)
    w[rng.randrange(80)] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    texts = [" ".join(BASE)] * 150 + [near_copy() for _ in range(150)] + [None] * 80 + [" ".join(rng.choice(WORDS) for _ in range(40)) + (" " + BENCH if i % 3 == 0 else "") for i in range(150)]
    rng.shuffle(texts)
    path = str(tmp_path_factory.mktemp("hot") / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def results(docs, bench):
    near = sorted(map(tuple, near_dedup.groups(docs).collect()))
    clean = sorted(map(tuple, decontamination.digest(decontamination.hits(docs, bench)).collect()))
    return near, clean


def test_dealt_keys_change_nothing(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, BENCH), (2, " ".join(WORDS[:15]))], "item_id long, text string")
    plain = results(docs, bench)
    monkeypatch.setattr(common, "HOT", 10)
    monkeypatch.setattr(decontamination, "MAX_BROADCAST", 0)
    assert results(docs, bench) == plain
    component = {r[0]: r[2] for r in plain[0]}
    group = [i for i, t in docs.collect() if t and len(set(t.split()) & set(BASE)) > 55]
    assert len(group) == 300 and len({component[i] for i in group}) == 1 and sum(r[2] > 0 for r in plain[1]) == 50


def test_hub_of_components(spark, monkeypatch):
    """A star of 3000 links and a chain, with the hub's links dealt over tasks."""
    monkeypatch.setattr(common, "HOT", 50)
    edges = spark.createDataFrame([(5000, i) for i in range(3000)] + [(6000 + i, 6001 + i) for i in range(40)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in [*range(3000), 5000]) and all(got[6000 + i] == 6000 for i in range(41))


def test_largest_task_of_a_dealt_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 100)
    many = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    one = common.stored(many.groupBy("k").agg(F.count("*").alias("n")), "one")
    for key, off in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "16"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, off)
    try:
        sizes = [r["count"] for r in common.spread_join(many, one, ["k"], "n").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plain = [r["count"] for r in many.join(one, "k").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == sum(plain) == 30_000 and max(plain) >= 10_000 and max(sizes) < 4000


def test_stored_tables_are_cleared(spark):
    import os

    from fluxmode.plans import staging

    kept = common.stored(spark.range(3), "kept").inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert os.path.exists(kept) and staging.cleared(spark) > 0 and not os.path.exists(kept)

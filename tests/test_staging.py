"""Tables between steps are deleted once their results are written."""

import os

from fluxmode.plans import staging


def test_cleared(spark, tmp_path):
    staging.cleared(spark)
    one = staging.settled(spark.range(5), "one")
    two = staging.settled(one.where("id > 2"), "two")
    paths = [f.removeprefix("file:").rsplit("/", 1)[0] for df in (one, two) for f in df.inputFiles()[:1]]
    paths = [p.removeprefix("//") for p in paths]
    name = "noted_table"
    at = staging.noted(spark, str(tmp_path / name), name)
    spark.range(3).write.option("path", at).saveAsTable(name)
    assert two.count() == 2 and all(os.path.isdir(p) for p in [*paths, at]) and spark.catalog.tableExists(name)
    assert staging.cleared(spark) == 3
    assert not any(os.path.exists(p) for p in [*paths, at]) and not spark.catalog.tableExists(name) and staging.cleared(spark) == 0

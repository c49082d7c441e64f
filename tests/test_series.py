"""Series in text tables and bundles of arrays: what is written is read, whatever the files look like."""

import os

import numpy as np
import pytest

from fluxmode.sources import series


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_files_with_columns_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿time,probe 1,"x, ""left"""\n0,1,2\n0.5,,4\r\n\n# a remark\n1,oops,-3e2,9\n')
    (tmp_path / "b.csv").write_text("t,other\n0,7\n1\n2,8,\n")
    (tmp_path / "none.csv").write_text("3,1,2\n4,5,6\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("time,x\n")
    (tmp_path / "a+b c%20.csv").write_text("time,,x\n1,2,3\n")
    got = {}
    for r in series.read(spark, str(tmp_path)).collect():
        got.setdefault(os.path.basename(r["input"]), []).append((r["time"], r["place"], r["channel"], r["x"]))
    got = {k: sorted(v, key=lambda x: x[:2]) for k, v in got.items()}
    left = 'x, "left"'
    assert got["a.csv"] == [(0.0, 1, "probe 1", 1.0), (0.0, 2, left, 2.0), (0.5, 1, "probe 1", None), (0.5, 2, left, 4.0), (1.0, 1, "probe 1", None), (1.0, 2, left, -300.0), (1.0, 3, "channel_3", 9.0)]
    assert got["b.csv"] == [(0.0, 1, "other", 7.0), (2.0, 1, "other", 8.0), (2.0, 2, "channel_2", None)]
    assert got["none.csv"] == [(3.0, 1, "channel_1", 1.0), (3.0, 2, "channel_2", 2.0), (4.0, 1, "channel_1", 5.0), (4.0, 2, "channel_2", 6.0)]
    assert got["a+b c%20.csv"] == [(1.0, 1, "channel_1", 2.0), (1.0, 2, "x", 3.0)]
    assert set(got) == {"a.csv", "b.csv", "none.csv", "a+b c%20.csv"}


def test_white_space_equals_loadtxt(spark, tmp_path):
    a = np.random.default_rng(3).normal(size=(50, 4))
    a[:, 0] = np.arange(50) / 7
    np.savetxt(tmp_path / "s.txt", a, header="Time\ta b c")
    got = series.read(spark, str(tmp_path / "s.txt"), sep=None)
    want = np.loadtxt(tmp_path / "s.txt")
    assert [(r["time"], r["channel"], r["x"]) for r in got.orderBy("time", "place").collect()] == [(want[i, 0], f"channel_{k}", want[i, k]) for i in range(50) for k in (1, 2, 3)]
    one = series.sampling(got).first()
    assert (one["samples"], one["channels"], one["first"], one["last"]) == (50, 3, want[0, 0], want[-1, 0])
    assert one["rate"] == pytest.approx(1 / np.mean(np.diff(want[:, 0])))


def test_a_long_file_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "long.csv", "w") as f:
        f.write("time,a,b\n")
        f.writelines(f"{i},{i % 7},{i % 5}\n" for i in range(60_000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        got = series.read(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert sorted((r["channel"], r["n"], r["s"]) for r in got.groupBy("channel").agg({"x": "count", "time": "sum"}).toDF("channel", "n", "s").select("channel", "n", "s").collect()) == [
            (c, 60_000, float(sum(range(60_000)))) for c in ("a", "b")
        ]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_round_trip(spark, tmp_path, sep):
    data = [(name, t / 3, c, t * 0.1 + k) for name in ("one/two", "a=b +%", "ü") for t in range(20) for k, c in enumerate(("p,1", "q;2", 'r "3"')) if (t + k) % 4]
    data += [("one/two", 0.0, "q;2", None), ("one/two", 0.0, "q;2", 5.0), ("one/two", 0.0, "q;2", 9.0)]  # the least stays
    series.write(spark.createDataFrame(data, "input string, time double, channel string, x double"), str(tmp_path / "out"), sep)
    back = series.read(spark, str(tmp_path / "out"), sep, folder="input").where("x IS NOT NULL").select("input", "time", "channel", "x")
    want = {}
    for name, t, c, x in data:
        if x is not None:
            want[name, t, c] = min(x, want.get((name, t, c), x))
    assert rows(back) == sorted((*k, x) for k, x in want.items())


def test_sampling_of_few_samples(spark):
    data = [("one", 2.0, 1, "a", 1.0), ("still", 1.0, 1, "a", 1.0), ("still", 1.0, 1, "a", 2.0)]
    got = series.sampling(spark.createDataFrame(data, "input string, time double, place int, channel string, x double"))
    assert rows(got) == [("one", 1, 1, 2.0, 2.0, 1.0), ("still", 2, 1, 1.0, 1.0, None)]
    assert series.sampling(got.selectExpr("input", "first AS time", "channels AS place", "input AS channel", "rate AS x").where("false")).count() == 0


BUNDLE = "input string, key string, dtype string, shape array<int>, data array<double>, text string"


def bundles(spark):
    data = [(n, "image", "f4", [2, 3], [float(k * i) for i in range(6)], None) for k, n in enumerate(("a", "b/c", "d %"))]
    data += [("a", "columns", "i8", None, [1.0, 2.0], None), ("a", "params", None, None, None, '{"k": 1}'), ("a", "absent", None, None, None, None), ("a", "none", "f8", [0], [], None)]
    return spark.createDataFrame(data, BUNDLE)


def test_bundles(spark, tmp_path):
    path = str(tmp_path / "out")
    series.write_bundles(bundles(spark), path)
    assert sorted(os.listdir(path)) == ["a.npz", "b%2Fc.npz", "d%20%25.npz"]
    a = np.load(f"{path}/a.npz")
    assert sorted(a.files) == ["columns", "image", "none", "params"] and a["image"].dtype == np.float32 and a["image"].shape == (2, 3)
    assert a["columns"].dtype == np.int64 and str(a["params"]) == '{"k": 1}'
    got = {(r["input"], r["key"]): r for r in series.read_bundles(spark, path).collect()}
    assert len(got) == 6 and got["b/c", "image"]["data"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and got["b/c", "image"]["shape"] == [2, 3]
    assert got["a", "params"]["text"] == '{"k": 1}' and got["a", "none"]["data"] == []
    (tmp_path / "out" / "bad.npz").write_bytes(b"none")
    assert series.read_bundles(spark, path).count() == 6
    series.write_bundles(bundles(spark).where("input = 'a'"), path, "overwrite")
    assert os.listdir(path) == ["a.npz"]


def test_a_failed_bundle_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    series.write_bundles(bundles(spark), path)
    before = sorted(os.listdir(path))
    bad = bundles(spark).selectExpr("concat('new', input) AS input", "key", "dtype", "IF(input = 'a' AND key = 'image', array(7), shape) AS shape", "data", "text")
    with pytest.raises(Exception, match="reshape"):
        series.write_bundles(bad, path)
    with pytest.raises(Exception, match="given twice"):
        series.write_bundles(bundles(spark).union(bundles(spark)), path)
    assert sorted(os.listdir(path)) == before


def test_prototype_lines(spark, tmp_path):
    from fluxmode.sources import sinks

    rng = np.random.default_rng(5)
    want = [(m, c, 1.5 + c / 100, -0.25, 11.25 * c, float(rng.uniform(0.5, 2e4)), float(rng.uniform(-3, 3))) for m in (1, 2, 10) for c in (3, 1, 20)]
    df = spark.createDataFrame(want, "mode long, channel int, r double, z double, phi double, amplitude double, phase double")
    sinks.write_prototypes(df.union(spark.createDataFrame([(11, 1, None, None, None, 1.0, 0.0)], df.schema)), str(tmp_path / "out"))
    parts = sorted(p for p in os.listdir(tmp_path / "out") if p.endswith(".txt"))
    text = [open(tmp_path / "out" / p).read() for p in parts]
    assert all(t.startswith("# Mode Channel R Z Phi Amplitude Phase\n") for t in text)
    got = np.concatenate([np.loadtxt(t.splitlines(), ndmin=2).reshape(-1, 7) for t in text if t.count("\n") > 1])
    assert np.allclose(got, [*sorted(want), (11, 1, 0, 0, 0, 1, 0)], rtol=1e-6, atol=1e-6) and "e+0" in "".join(text)
    sinks.write_prototypes(df.limit(0), str(tmp_path / "none"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "none")).distinct().collect() if not r["value"].startswith("#")] == []

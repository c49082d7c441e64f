"""Contour files: written by tasks, read back whole; failed tasks leave nothing."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxmode.sources import contours, readers

ROWS = [(k, k / 7, None if k == 3 else f"whale é{k}", "D" if k % 2 else None, [0.1 * j + k for j in range(k % 5)], [100.0 + j for j in range(k % 5)], [float(j) for j in range(k % 5)]) for k in range(40)]
SCHEMA = "graph long, score double, species string, call string, time array<double>, frequency array<double>, snr array<double>"


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    contours.write(df, str(tmp_path), comment="a comment", timestamp="2024-01-01T00:00:00Z", userVersion="2")
    names = os.listdir(tmp_path)
    assert len(names) == 3 and all(n.endswith(".ton") for n in names)
    got = contours.read(spark, str(tmp_path)).collect()
    assert {r["comment"] for r in got} == {"a comment"} and {r["timestamp"] for r in got} == {"2024-01-01T00:00:00Z"} and {r["error"] for r in got} == {None}
    have = sorted((r["graph"], r["score"], r["species"], r["call"], r["time"], r["frequency"], r["snr"]) for r in got)
    assert have == [(g, s, sp or "", c or "", t, f, n) for g, s, sp, c, t, f, n in ROWS] and {r["phase"] for r in got} == {None}
    assert readers.contours(spark, str(tmp_path)).count() == 40
    contours.write(df.limit(5), str(tmp_path))
    assert contours.read(spark, str(tmp_path)).count() == 45
    contours.write(df.where("graph < 7").select("time", "frequency"), str(tmp_path), "overwrite")
    left = contours.read(spark, str(tmp_path)).collect()
    assert len(left) == 7 and {r["species"] for r in left} == {None} and {r["graph"] for r in left} == {0}
    contours.write(df.limit(0), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []


def test_failed_task_leaves_no_file(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    contours.write(df, str(tmp_path))
    before = sorted(os.listdir(tmp_path))
    bad = df.withColumn("snr", F.when(F.col("graph") == 17, F.array(F.lit(1.0))).otherwise(F.col("snr")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="one length"):
            contours.write(bad, str(tmp_path), mode)
        assert sorted(os.listdir(tmp_path)) == before
    with pytest.raises(Exception, match="time and frequency"):
        contours.write(df.select("time"), str(tmp_path))


def test_headers_and_broken_files(spark, tmp_path):
    plain = struct.pack(">i4d", 2, 1.0, 10.0, 2.0, 20.0) + struct.pack(">i", 0)
    old = contours.MAGIC + struct.pack(">HHHI", 2, 3, 0, 18 + 2 + 3) + struct.pack(">H", 3) + b"abc" + plain
    (tmp_path / "plain.ton").write_bytes(plain)
    (tmp_path / "old.ton").write_bytes(old)
    (tmp_path / "cut.ton").write_bytes(plain + struct.pack(">i", 5) + b"12")
    (tmp_path / "empty.ton").write_bytes(b"")
    (tmp_path / "negative.ton").write_bytes(struct.pack(">i", -4))
    got = {}
    for r in contours.read(spark, str(tmp_path)).collect():
        got.setdefault(os.path.basename(r["path"]), []).append(r)
    for name in ("plain", "old"):
        assert [(r["time"], r["frequency"], r["graph"]) for r in got[f"{name}.ton"]] == [([1.0, 2.0], [10.0, 20.0], None), ([], [], None)]
    assert got["old.ton"][0]["comment"] == "abc" and "empty.ton" not in got
    assert [r["error"] is None for r in got["cut.ton"]] == [True, True, False] and [r["error"] is None for r in got["negative.ton"]] == [False]
    assert readers.contours(spark, str(tmp_path)).count() == 6


def test_bytes_by_hand():
    row = {"time": [1.5], "frequency": [2.5], "ridge": [3.5], "species": "x", "confidence": 0.5, "graph": 7}
    head = contours.encoded_header(list(row))
    assert head == b"silbido!" + struct.pack(">HHHI", 4, 1 | 2 | 64 | 512 | 32, 0, 18)
    assert contours.encoded(row, list(row)) == struct.pack(">d", 0.5) + struct.pack(">H", 1) + b"x" + struct.pack(">qi3d", 7, 1, 1.5, 2.5, 3.5)
    back = contours.decoded(head + contours.encoded(row, list(row)))
    assert len(back) == 1 and np.allclose(back[0]["ridge"], [3.5]) and back[0]["species"] == "x"
    with pytest.raises(ValueError):
        contours.encoded_header(["time"], comment="x" * 70000)

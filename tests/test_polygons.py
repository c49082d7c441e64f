"""Outlines and polygons of planted shapes, and back to masks."""

import os

import numpy as np
import pytest

from fluxmode.operators import grids, polygons
from test_registered import SF, grid, run  # noqa: F401  grid is a fixture


def inside(outlines, height, width):
    """Which pixels an odd number of outlines encloses, by rays to the left."""
    out = np.zeros((height, width), int)
    for rows, cols in outlines:
        for r0, c0, r1, c1 in zip(rows, cols, rows[1:], cols[1:]):
            for f in range(height):
                if (r0 > f) != (r1 > f):
                    at = c0 + (f - r0) * (c1 - c0) / (r1 - r0)
                    out[f] += np.arange(width) > at
    return out % 2 == 1


def labelled(spark, images):
    rows = [(k, int(f), int(t), True) for k, m in enumerate(images) for f, t in zip(*np.nonzero(m), strict=True)]
    return grids.connected_regions(spark.createDataFrame(rows, "input int, f long, t long, s boolean"), "input", tile=8)


def shapes():
    r = np.random.default_rng(3)
    disc = (np.add.outer((np.arange(40) - 20) ** 2, (np.arange(60) - 30) ** 2) < 150).astype(bool)
    ring = disc & ~(np.add.outer((np.arange(40) - 20) ** 2, (np.arange(60) - 30) ** 2) < 40)
    stairs = np.zeros((40, 60), bool)
    for k in range(2, 30):
        stairs[k, k : k + 2] = True
    corners = np.zeros((40, 60), bool)
    corners[5:8, 5:8] = corners[8:11, 8:11] = True  # touch at a corner
    noise = r.random((40, 60)) < 0.45
    noise[[0, -1]] = noise[:, [0, -1]] = False
    return [disc, ring, stairs, corners, noise]


def test_outlines_enclose_their_regions(spark):
    images = shapes()
    got = polygons.outlines(labelled(spark, images), "input", height=40, width=60).collect()
    for k, m in enumerate(images):
        mine = [(r["row"], r["column"]) for r in got if r["input"] == k]
        assert (inside(mine, 40, 60) == m).all() and all(r["closed"] for r in got if r["input"] == k)
    assert [sum(r["input"] == k for r in got) for k in range(4)] == [1, 2, 1, 2]
    for r in got:
        steps = np.abs(np.diff(r["row"])) + np.abs(np.diff(r["column"]))
        assert r["n"] == len(r["row"]) and (steps == 1).all() and (r["row"][0], r["column"][0]) == min(zip(r["row"], r["column"], strict=True))


def test_one_pixel_and_image_edges(spark):
    one = np.zeros((6, 6), bool)
    one[2, 3] = True
    half = np.zeros((6, 6), bool)
    half[:, :3] = True
    got = {r["input"]: r for r in polygons.outlines(labelled(spark, [one, half, np.ones((6, 6), bool)]), "input", height=6, width=6).collect()}
    assert sorted(got) == [0, 1]  # a full image has no outline
    assert sorted(zip(got[0]["row"], got[0]["column"], strict=True))[1:] == [(1.5, 3.0), (2.0, 2.5), (2.0, 3.5), (2.5, 3.0)] and got[0]["n"] == 5
    assert not got[1]["closed"] and got[1]["column"] == [2.5] * 6 and sorted(got[1]["row"]) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_polygons_of_runs(spark):
    images = shapes()
    masks = spark.createDataFrame([(k, int(f), int(t), True) for k, m in enumerate(images) for f, t in zip(*np.nonzero(m), strict=True)], "input int, f long, t long, s boolean")
    runs = grids.run_lengths(masks, "input", height=40)
    back = polygons.pixels(runs, "input", height=40)
    assert sorted(map(tuple, back.select("input", "f", "t").collect())) == sorted(map(tuple, masks.select("input", "f", "t").collect()))
    got = {r["input"]: r for r in polygons.mask_polygons(runs, grids.connected_regions, "input", height=40, width=60).collect()}
    full = polygons.outlines(labelled(spark, images), "input", height=40, width=60).collect()
    for k in range(len(images)):
        best = max((r for r in full if r["input"] == k), key=lambda r: (r["n"], -r["label"], -r["outline"]))
        points = np.stack((np.array(best["column"]) / 60, np.array(best["row"]) / 40), 1)
        if best["n"] > 100:
            points = points[np.linspace(0, best["n"] - 1, 50).astype(int)]
        assert np.allclose(np.reshape(got[k]["polygon"], (-1, 2)), points) and got[k]["n"] == best["n"]
    assert any(r["n"] > 100 for r in got.values()) and any(r["n"] <= 100 for r in got.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_registered_polygons(spark, grid):  # noqa: F811
    top = grid.max(1, keepdims=True)
    m = np.where(top > 0, grid / np.where(top > 0, top, 1), 0) > 0.25
    got = {r["input"]: r for r in run(spark, "mask_polygons")}
    assert set(got) == {k for k in range(3) if m[:, 240 * k : 240 * k + 240].any()}
    for k, r in got.items():
        p = np.reshape(r["polygon"], (-1, 2)) * [240, 16]
        part = m[:, 240 * k : 240 * k + 240]
        for x, y in p:  # every point lies half way between a set pixel and an unset one
            a, b = ((int(np.floor(y)), int(x)), (int(np.ceil(y)), int(x))) if y % 1 else ((int(y), int(np.floor(x))), (int(y), int(np.ceil(x))))
            assert part[a] != part[b]


def test_empty(spark):
    none = spark.createDataFrame([], "input int, f long, t long, label long")
    assert polygons.polygons(polygons.largest(polygons.outlines(none, "input", height=5, width=5), "input"), 5, 5).count() == 0

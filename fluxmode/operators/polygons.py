"""Outlines of regions in masks, by marching squares at one half, and the polygons they make.

Every pixel lies in four cells of two by two; a cell that holds some but not all of its corners has a segment, which cuts off each set corner
(or run of corners) from the rest. The segments come from grouping pixels by cell, so no task holds an image; only the linking of one region's
segments to outlines is done in one place, and that sees the region's boundary alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Of more points than MOST a polygon keeps KEPT, evenly spaced.
MOST, KEPT = 100, 50


def pixels(runs: DataFrame, *keys: str, height: int) -> DataFrame:
    """keys, f, t of the set pixels of runs (start, length) in column-major order."""
    p = F.explode(F.sequence("start", F.col("start") + F.col("length") - 1))
    return runs.where("length > 0").select(*keys, p.alias("_p")).select(*keys, F.pmod("_p", F.lit(height)).alias("f"), F.floor(F.col("_p") / height).alias("t"))


def _cell_segments(code: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Segments of a cell whose set corners are the bits of code, clockwise from the upper left; ends in half pixels from it.

    Going around, an edge from an unset corner to a set one enters, and one from a set corner leaves: each entry is tied to the next exit.
    """
    middles = ((0, 1), (1, 2), (2, 1), (1, 0))
    on = [bool(code >> k & 1) for k in range(4)]
    out = []
    for k in range(4):
        if not on[k] and on[(k + 1) % 4]:
            j = (k + 1) % 4
            while on[(j + 1) % 4]:
                j = (j + 1) % 4
            out.append((middles[k], middles[j]))
    return out


def segments(regions: DataFrame, *keys: str, height: int, width: int) -> DataFrame:
    """keys, label, r0, c0, r1, c1: directed pieces of the outlines of labelled pixels (f, t, label), in half pixels.

    Edges of the image are no outline. Of a region only its own pixels are set, so regions that touch at a corner are told apart.
    """
    corners = [(0, 0, 1), (0, -1, 2), (-1, -1, 4), (-1, 0, 8)]  # the cell a pixel lies in, and which corner of it the pixel is
    cells = F.explode(F.array(*(F.struct((F.col("f") + a).alias("cf"), (F.col("t") + b).alias("ct"), F.lit(bit).alias("bit")) for a, b, bit in corners)))
    each = regions.select(*keys, "label", cells.alias("c")).select(*keys, "label", "c.*").where((F.col("cf") >= 0) & (F.col("ct") >= 0) & (F.col("cf") < height - 1) & (F.col("ct") < width - 1))
    codes = each.groupBy(*keys, "label", "cf", "ct").agg(F.bit_or("bit").alias("code")).where("code < 15")
    two = lambda a, b: F.struct(*((F.col(base) * 2 + x).cast("long").alias(name) for name, base, x in (("r0", "cf", a[0]), ("c0", "ct", a[1]), ("r1", "cf", b[0]), ("c1", "ct", b[1]))))
    found = F.array().cast("array<struct<r0:bigint,c0:bigint,r1:bigint,c1:bigint>>")
    for code in range(1, 15):
        found = F.when(F.col("code") == code, F.array(*(two(a, b) for a, b in _cell_segments(code)))).otherwise(found)
    return codes.select(*keys, "label", F.explode(found).alias("s")).select(*keys, "label", "s.*")


def linked(r0: np.ndarray, c0: np.ndarray, r1: np.ndarray, c1: np.ndarray) -> list[tuple[np.ndarray, bool]]:
    """Outlines from directed segments: points (row, column), and whether each is closed (its first point is then its last, too).

    An open one starts where nothing leads to, a closed one at its least point. Outlines come in the order of their starts.
    """
    ends = np.unique(np.concatenate((np.stack((r0, c0), 1), np.stack((r1, c1), 1))), axis=0)
    place = {tuple(p): i for i, p in enumerate(ends.tolist())}
    follows = np.full(len(ends), -1)
    follows[[place[p] for p in zip(r0.tolist(), c0.tolist(), strict=True)]] = [place[p] for p in zip(r1.tolist(), c1.tolist(), strict=True)]
    after = follows.tolist()
    led = np.zeros(len(ends), bool)
    led[follows[follows >= 0]] = True
    seen, out = [False] * len(ends), []
    for i in [*np.flatnonzero(~led).tolist(), *range(len(ends))]:
        if seen[i]:
            continue
        path, at = [], i
        while at >= 0 and not seen[at]:
            seen[at] = True
            path.append(at)
            at = after[at]
        closed = at == i
        out.append((ends[[*path, i] if closed else path], closed))
    return sorted(out, key=lambda o: tuple(o[0][0]))


def outlines(regions: DataFrame, *keys: str, height: int, width: int) -> DataFrame:
    """keys, label, outline (number in the region), closed, n, points (arrays of row and column): the outer outline and those of holes."""
    pieces = segments(regions, *keys, height=height, width=width)
    types = dict(pieces.dtypes)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [pdf[c].iloc[0] for c in (*keys, "label")]
        found = linked(*(pdf[c].to_numpy() for c in ("r0", "c0", "r1", "c1")))
        return pd.DataFrame([(*names, k, closed, len(p), (p[:, 0] / 2).tolist(), (p[:, 1] / 2).tolist()) for k, (p, closed) in enumerate(found)], columns=[*keys, "label", "outline", "closed", "n", "row", "column"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, "label")) + ", outline int, closed boolean, n int, row array<double>, column array<double>"
    return pieces.groupBy(*keys, "label").applyInPandas(link, schema)


def largest(found: DataFrame, *keys: str) -> DataFrame:
    """Of each key the outline of most points (the least label and number of equals)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "label", "outline")
    ranked = found.select(*keys, "label", "outline", "n").withColumn("_p", F.row_number().over(order)).where("_p = 1").drop("_p", "n")
    return found.join(ranked, [*keys, "label", "outline"], "left_semi")


def polygons(found: DataFrame, height: int, width: int) -> DataFrame:
    """found with polygon in place of its points: x and y in turn, in shares of the image's width and height; of long outlines KEPT points."""
    step = (F.col("n") - 1) / F.lit(float(KEPT - 1))
    some = F.transform(F.sequence(F.lit(0), F.lit(KEPT - 1)), lambda i: F.when(i == KEPT - 1, F.col("n") - 1).otherwise(F.floor(i * step)).cast("int"))
    chosen = F.when(F.col("n") > MOST, some).otherwise(F.sequence(F.lit(0), F.col("n") - 1))
    points = F.flatten(F.transform(chosen, lambda i: F.array(F.get("column", i) / width, F.get("row", i) / height)))
    return found.withColumn("polygon", points).drop("row", "column")


def mask_polygons(runs: DataFrame, label, *keys: str, height: int, width: int) -> DataFrame:
    """The polygon of the largest outline of each mask given by its runs. label: what names the regions of pixels, as grids.connected_regions."""
    on = pixels(runs, *keys, height=height).withColumn("s", F.lit(True))
    return polygons(largest(outlines(label(on, *keys), *keys, height=height, width=width), *keys), height, width)

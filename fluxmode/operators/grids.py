"""Masks and images in long form (key columns, f, t, v or s)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import settled


def transient_field(df: DataFrame, *keys: str) -> DataFrame:
    """|v(t) - v(t - 1)|, 0 in the first column."""
    w = Window.partitionBy(*keys, "f").orderBy("t")
    return df.withColumn("d", F.abs(F.col("v") - F.coalesce(F.lag("v").over(w), F.col("v"))))


def total_variation(df: DataFrame, *keys: str) -> DataFrame:
    """Sum of |differences| along t without the last row's, and along f without the last column's."""
    along_t = F.abs(F.lead("v").over(Window.partitionBy(*keys, "f").orderBy("t")) - F.col("v"))
    along_f = F.abs(F.lead("v").over(Window.partitionBy(*keys, "t").orderBy("f")) - F.col("v"))
    ends = df.groupBy(*keys).agg(F.max("f").alias("_F"), F.max("t").alias("_T"))
    step = df.withColumn("_a", along_t).withColumn("_b", along_f)
    step = step.join(ends, list(keys)) if keys else step.join(F.broadcast(ends))  # one row
    return step.groupBy(*keys).agg(
        (F.sum(F.when(F.col("f") < F.col("_F"), F.coalesce("_a", F.lit(0.0))).otherwise(0.0)) + F.sum(F.when(F.col("t") < F.col("_T"), F.coalesce("_b", F.lit(0.0))).otherwise(0.0))).alias("tv")
    )


def bounding_boxes(labelled: DataFrame, *keys: str, min_area: int = 1) -> DataFrame:
    """x, y, w, h and area of each label."""
    box = labelled.groupBy(*keys, "label").agg(
        F.min("t").alias("x"), F.min("f").alias("y"), (F.max("t") - F.min("t") + 1).alias("w"), (F.max("f") - F.min("f") + 1).alias("h"), F.count("*").alias("area")
    )
    return box.where(F.col("area") >= min_area)


def run_lengths(mask: DataFrame, *keys: str, height: int) -> DataFrame:
    """Runs of set pixels in column-major order: start (place), length."""
    on = mask.where("s").withColumn("p", F.col("t") * height + F.col("f"))
    order = Window.partitionBy(*keys).orderBy("p")
    runs = on.withColumn("_g", F.col("p") - F.row_number().over(order))
    return runs.groupBy(*keys, "_g").agg(F.min("p").alias("start"), F.count("*").alias("length")).drop("_g")


def refined(df: DataFrame, mean_min: float = 0.25, entropy_min: float = 0.45) -> DataFrame:
    """Mask algebra over predictions: columns p0, e0, p1, e1 (mean, entropy by channel), y0, y1 -> c, s."""
    sure = lambda k: (F.col(f"p{k}") > mean_min) & (F.col(f"e{k}") > entropy_min)
    blocked = lambda k: F.col(f"y{k}") | (F.col(f"p{k}") > mean_min)
    return df.withColumn("c", (sure(0) & ~blocked(1)) | F.col("y0")).withColumn("s", (sure(1) & ~blocked(0)) | F.col("y1"))


def trimmed_rows(df: DataFrame, bottom: int, top: int, height: int) -> DataFrame:
    """The mask without its lowest and highest rows."""
    return df.withColumn("s", F.when((F.col("f") < bottom) | (F.col("f") >= height - top), False).otherwise(F.col("s")))


def rolloff(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Each row times its coefficient, interpolated linearly between the table's points. table: x, c.

    The table becomes segments; a bin finds its segment by an equi-join on the whole numbers it spans.
    """
    w = Window.orderBy("x")  # the table is a small calibration list
    seg = table.withColumn("x1", F.lead("x").over(w)).withColumn("c1", F.lead("c").over(w)).where("x1 IS NOT NULL")
    cells = seg.withColumn("_b", F.explode(F.sequence(F.floor("x"), F.ceil("x1") - 1)))
    hit = df.withColumn("_b", F.floor(F.col("f"))).join(cells, "_b").where((F.col("f") >= F.col("x")) & (F.col("f") < F.col("x1")))
    c = F.col("c") + (F.col("c1") - F.col("c")) * (F.col("f") - F.col("x")) / (F.col("x1") - F.col("x"))
    return hit.select(*keys, "f", "t", (F.col("v") * c).alias("v"))


def polyline_cells(nodes: DataFrame, *keys: str) -> DataFrame:
    """Raster of contours: the whole columns each segment spans, at the linearly interpolated row. nodes: keys, i, x, y."""
    w = Window.partitionBy(*keys).orderBy("i")
    seg = nodes.withColumn("_x", F.lag("x").over(w)).withColumn("_y", F.lag("y").over(w)).where("_x IS NOT NULL")
    cols = seg.withColumn("t", F.explode(F.sequence(F.least(F.floor("_x"), F.floor("x")), F.greatest(F.floor("_x"), F.floor("x")))))
    share = F.when(F.col("x") == F.col("_x"), 1.0).otherwise(F.least(F.greatest((F.col("t") - F.col("_x")) / (F.col("x") - F.col("_x")), F.lit(0.0)), F.lit(1.0)))
    return cols.select(*keys, "t", F.floor(F.col("_y") + share * (F.col("y") - F.col("_y"))).alias("f")).distinct()


def local_extreme(df: DataFrame, reach: int, how: str, *keys: str) -> DataFrame:
    """Grey dilation (max) or erosion (min) along t by windows of 2 * reach + 1 columns."""
    w = Window.partitionBy(*keys, "f").orderBy("t").rowsBetween(-reach, reach)
    return df.withColumn("e", (F.max if how == "max" else F.min)("v").over(w))


def blurred(df: DataFrame, sigma: float, *keys: str, reach: int | None = None) -> DataFrame:
    """Gaussian blur along t: keys, f, t, v. The ends are mirrored (edge column repeated); t is dense.

    Each value is added to the columns within reach of it, so a row is never gathered in one task.
    """
    n = reach if reach is not None else int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-n, n + 1)]
    taps = F.array(*(F.struct(F.lit(k - n).alias("k"), F.lit(x / sum(weights)).alias("w")) for k, x in enumerate(weights)))
    ends = df.groupBy(*keys, "f").agg(F.min("t").alias("_a"), F.max("t").alias("_z"))
    # a mirrored column gives what its original gives, to the columns inside
    each = df.join(ends, [*keys, "f"]).select("*", F.explode(taps).alias("p"))
    images = F.array(F.col("t"), 2 * F.col("_a") - 1 - F.col("t"), 2 * F.col("_z") + 1 - F.col("t"))
    laid = each.select(*keys, "f", "_a", "_z", "p", "v", F.explode(images).alias("_i")).select(*keys, "f", "_a", "_z", (F.col("_i") + F.col("p.k")).alias("t"), (F.col("v") * F.col("p.w")).alias("v"))
    return laid.where("t BETWEEN _a AND _z").groupBy(*keys, "f", "t").agg(F.sum("v").alias("v"))


def opened_closed(df: DataFrame, reach: int, *keys: str) -> DataFrame:
    """Grey closing, then opening, along t: keys, f, t, v."""
    for how in ("max", "min", "min", "max"):
        df = local_extreme(df, reach, how, *keys).select(*keys, "f", "t", F.col("e").alias("v"))
    return df


def connected_regions(mask: DataFrame, *keys: str, tile: int = 512) -> DataFrame:
    """4-connected regions of set pixels: keys, f, t, label (least t * 2^32 + f of the region).

    Regions are labelled within square tiles by numpy, one group a tile, so no task holds an
    image, however high or wide; labels that meet across a tile's edge are then merged by min-label rounds on edge pairs.
    """
    on = mask.where("s").select(*keys, "f", "t").withColumns({"_tt": F.floor(F.col("t") / tile), "_tf": F.floor(F.col("f") / tile)})
    schema = on.drop("_tt", "_tf").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", label bigint"

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        f, t = pdf["f"].to_numpy(np.int64), pdf["t"].to_numpy(np.int64)
        code = t * (1 << 32) + f
        order = np.argsort(code)
        code = code[order]
        lab = code.copy()
        pairs = [(np.flatnonzero(hit), at[hit]) for step in (1, 1 << 32) for at in [np.searchsorted(code, code + step)] for hit in [(at < len(code)) & (code[np.minimum(at, len(code) - 1)] == code + step)]]
        while True:
            was = lab.copy()
            for a, b in pairs:
                low = np.minimum(lab[a], lab[b])
                np.minimum.at(lab, a, low)
                np.minimum.at(lab, b, low)
            lab = lab[np.searchsorted(code, lab)]
            if (lab == was).all():
                break
        out = pdf.iloc[order].drop(columns=["_tt", "_tf"])
        return out.assign(label=lab)

    tiles = settled(on.groupBy(*keys, "_tt", "_tf").applyInPandas(label, schema), "tiles")

    def across(axis: str, other: str) -> DataFrame:
        """Labels on both sides of the edges between tiles that lie along an axis."""
        ends = tiles.where(F.col(axis) % tile == tile - 1).select(*keys, (F.col(axis) + 1).alias(axis), other, F.col("label").alias("a"))
        return ends.join(tiles.where(F.col(axis) % tile == 0).select(*keys, axis, other, F.col("label").alias("b")), [*keys, axis, other]).select(*keys, "a", "b")

    meet = settled(across("t", "f").union(across("f", "t")).distinct(), "edges")
    names = meet.select(*keys, F.col("b").alias("label"), "a").union(meet.select(*keys, "a", "b")).groupBy(*keys, "label").agg(F.min("a").alias("low"))
    names = names.withColumn("low", F.least("label", "low"))
    for _ in range(64):  # a region crosses one edge a round, halved by jumping
        hop = names.select(*keys, F.col("label").alias("low"), F.col("low").alias("_next"))
        links = meet.select(*keys, F.col("a").alias("label"), F.col("b").alias("o")).union(meet.select(*keys, F.col("b"), F.col("a")))
        around = links.join(names.select(*keys, F.col("label").alias("o"), F.col("low").alias("_l")), [*keys, "o"]).groupBy(*keys, "label").agg(F.min("_l").alias("_l"))
        new = names.join(hop, [*keys, "low"], "left").join(around, [*keys, "label"], "left")
        new = settled(new.select(*keys, "label", F.col("low").alias("_was"), F.least("low", F.coalesce("_next", "low"), F.coalesce("_l", "low")).alias("low")), "regions")
        same = new.where("low <> _was").isEmpty()
        names = new.drop("_was")
        if same:
            break
    else:
        raise RuntimeError("regions did not settle")
    return tiles.join(names, [*keys, "label"], "left").select(*keys, "f", "t", F.coalesce("low", "label").alias("label"))


def without_small(mask: DataFrame, regions: DataFrame, min_size: int, *keys: str) -> DataFrame:
    """Regions of at least min_size pixels."""
    return regions.join(regions.groupBy(*keys, "label").agg(F.count("*").alias("area")).where(F.col("area") >= min_size), [*keys, "label"])

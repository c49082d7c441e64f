"""Writers: event and summary tables as text with blanks for unknowns, and bundles as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def event_rows(events: DataFrame, hop: int, fs: float | None, key: str = "input") -> DataFrame:
    """The nine columns of an event table; times are null without a sample rate."""
    rate = F.lit(fs).cast("double")
    numbered = F.row_number().over(_by(key)) - 1
    start, stop = scalars.column_seconds(F.col("start"), hop, rate), scalars.column_seconds(F.col("stop") + 1, hop, rate)
    return events.select(
        F.col(key).alias("input"), numbered.alias("event"), F.col("start").alias("start_col"), F.col("stop").alias("end_col"), F.col("duration").alias("duration_cols"),
        start.alias("t_start_s"), stop.alias("t_end_s"), (stop - start).alias("duration_s"), F.col("peak").alias("peak_activity"),
    )


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("start")


def write_text(df: DataFrame, path: str) -> None:
    """CSV with a header; null is blank."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="")


def write_bundle(df: DataFrame, path: str, schema: str, source: str, **params) -> None:
    """A table with its schema name, source and parameters beside each row, partitioned by source."""
    given = F.to_json(F.create_map(*(F.lit(str(x)) for kv in sorted(params.items()) for x in kv))) if params else F.lit("{}")
    df.withColumns({"schema": F.lit(schema), "params_json": given, "source": F.lit(source)}).write.mode("overwrite").partitionBy("source").parquet(path)


def write_prototypes(channels: DataFrame, path: str) -> None:
    """The channels of prototypes (mode, channel, r, z, phi, amplitude, phase) as text, by mode and channel, with a commented header a file; unknown places are 0."""
    place = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("r", "z", "phi")]
    line = F.format_string("%d %d %.6f %.6f %.6f %.6e %.6f", F.col("mode").cast("long"), F.col("channel").cast("long"), *place, F.col("amplitude").cast("double"), F.col("phase").cast("double"))
    dealt = channels.repartitionByRange("mode", "channel").sortWithinPartitions("mode", "channel")
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of a task's rows, hence of a file
    header = F.lit("# Mode Channel R Z Phi Amplitude Phase\n")
    dealt.select(F.concat(F.when(first, header).otherwise(""), line).alias("value")).write.mode("overwrite").text(path)


def coco(boxes: DataFrame, image: str = "image") -> DataFrame:
    """One JSON document an image: its boxes with ids that run on within the image."""
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy(image).orderBy("label"))
    each = boxes.withColumn("id", row).withColumn("bbox", F.array("x", "y", "w", "h"))
    return each.groupBy(image).agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "bbox", "area")))).alias("annotations"))

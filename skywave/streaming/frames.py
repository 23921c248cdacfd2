"""State carried from frame to frame of a channel, for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skywave.streaming.memory import remember_stream


def frame_means(frames: DataFrame) -> DataFrame:
    """(channel, frame_id, mean_p) of (channel, frame_id, patch, p)."""
    return frames.groupBy(F.col("channel").cast("long").alias("channel"), F.col("frame_id").cast("long").alias("frame_id")).agg(F.avg("p").alias("mean_p"))


def carry_batch(means: DataFrame) -> DataFrame:
    """Each frame with its change from the frame before (0 for the first) and the profile, which the first frame sets for good."""
    w = Window.partitionBy("channel").orderBy("frame_id")
    return means.withColumn("change", F.abs(F.col("mean_p") - F.coalesce(F.lag("mean_p").over(w), F.col("mean_p")))).withColumn("profile", F.first("mean_p").over(w))


def carry_stream(means: DataFrame, lateness: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """carry_batch for a stream of (channel, frame_id, at, mean_p) whose frames come at most `lateness` after later ones, with
    `dropped`, how many frames of the channel came too late so far (see remember_stream)."""
    one = F.array(F.col("mean_p"))
    frames = means.select(F.col("channel").cast("long").alias("channel"), F.col("frame_id").cast("long").alias("frame_id"), "at", F.array(F.lit(0)).alias("patch"), one.alias("p"), one.alias("profile"))
    d = remember_stream(frames, lateness, idle_ms)
    change = F.coalesce(F.abs(F.col("p")[0] - F.col("before")[0]), F.lit(0.0))
    return d.select("channel", "frame_id", F.col("p")[0].alias("mean_p"), change.alias("change"), F.col("profile")[0].alias("profile"), "dropped")

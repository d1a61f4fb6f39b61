"""Streams of frames with delayed emission.

A frame's nodes come out once the watermark has passed the `radius` later
frames, with what a window of 2 * radius + 1 frames says about them; then they
are forgotten. Frames are event time, a second each, so a replay of the same
rows gives the same rows whatever the clock says, and the last frames come out
when a later frame of any track is seen. What comes later than that is dropped
from the windows already emitted, and counted (late_rows).

State is kept by Spark's own window aggregate: sums and the scores of a frame,
for each open window of a track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def smooth_batch(nodes: DataFrame, radius: int) -> DataFrame:
    """The same result from a finished table (track, frame, score): what the stream gives once it is flushed."""
    near = Window.partitionBy("track").orderBy("frame").rangeBetween(-radius, radius)
    return nodes.select("track", "frame", "score", F.avg("score").over(near).alias("smooth"), F.count("*").over(near).alias("n_window"))


def smooth_stream(nodes: DataFrame, radius: int, late: int = 0) -> DataFrame:
    """nodes: a stream (track long, frame long, score double) whose frames come at most `late` frames after later ones."""
    rows = nodes.select("track", "frame", "score", F.timestamp_seconds("frame").alias("ts")).withWatermark("ts", f"{late} seconds")
    rows = rows.select("track", "frame", "score", F.window("ts", f"{2 * radius + 1} seconds", "1 second").alias("w"))
    own = F.collect_list(F.when(F.col("frame") == F.unix_seconds("w.start") + radius, F.struct("frame", "score")))
    seen = rows.groupBy("track", "w").agg(own.alias("own"), F.avg("score").alias("smooth"), F.count("*").alias("n_window"))
    return seen.select("track", F.explode("own").alias("node"), "smooth", "n_window").select("track", "node.frame", "node.score", "smooth", "n_window")


def late_rows(query: StreamingQuery) -> int:
    """How often a row, summed up with others of its task and window, came too late for a window; over the progress that the query still holds."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def divisions_by_window(events: DataFrame, every: str, late: str) -> DataFrame:
    """Counts and mean of value by event type and time window, of a stream (ts, event_type, value); rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")

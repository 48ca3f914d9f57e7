"""The causal part of detection on a stream: threshold crossings gathered into sessions by event time.

Crossings at most `gap` apart form a region, as nearby regions merge in batch, with gaps in time in place of samples. Late rows
are dropped by the watermark; a session is emitted once the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold_sessions(stream: DataFrame, limits: DataFrame, gap: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    """stream: dataset, channel, ts, value. limits: dataset, channel, mu, threshold; one row per series, from a batch of baselines."""
    hits = stream.withWatermark("ts", delay).join(limits, ["dataset", "channel"]).filter(F.abs(F.col("value") - F.col("mu")) > F.col("threshold"))
    made = hits.groupBy("dataset", "channel", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("hits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(F.abs(F.col("value"))).alias("peak_abs"))
    return made.select("dataset", "channel", "first_ts", "last_ts", "hits", "peak_abs")

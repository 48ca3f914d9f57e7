"""Long series in blocks, so that one series isn't one task.

Operators with bounded row frames work on blocks of a series. Rows near a border are also dealt to the neighbour block, as many as the
frame reaches over; results are kept for a block's own rows. For series shorter than a block nothing is copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.config import SERIES

SAMPLES = 65_536


def with_halo(df: DataFrame, before: int, after: int, size: int = SAMPLES, keys: list[str] = SERIES) -> DataFrame:
    """Adds block and own; every block has its own rows and those up to `before` ahead of them and `after` behind."""
    i = F.col("sample_index")
    low, high = F.floor(F.greatest(i - after, F.lit(0)) / size), F.floor((i + before) / size)
    copied = df.withColumn("block", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    return copied.withColumn("own", F.col("block") == F.floor(i / size))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("own").drop("block", "own")


def frame(low: int, high: int, keys: list[str] = SERIES):
    return Window.partitionBy(*keys, "block").orderBy("sample_index").rowsBetween(low, high)


def ordered(keys: list[str] = SERIES):
    return Window.partitionBy(*keys, "block").orderBy("sample_index")

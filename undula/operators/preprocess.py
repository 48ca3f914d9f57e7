"""Cleaning, baseline and shift of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.config import SERIES
from undula.operators.blocks import SAMPLES


def clean(df: DataFrame, size: int = SAMPLES) -> DataFrame:
    """Values that aren't numbers become null; gaps are filled linearly by sample position, edges with the nearest value.

    Each block of a series looks for the last and next value within itself; what lies in other blocks comes from one row
    per block, so no window spans a whole series of samples.
    """
    v = F.expr("try_cast(value AS DOUBLE)")
    v = F.when(~F.isnan(v), v)
    base = df.withColumn("value", v).withColumn("block", F.floor(F.col("sample_index") / size))
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("sample_index").alias("i"), F.col("value").alias("v")))
    edges = base.groupBy(*SERIES, "block").agg(F.max(known).alias("last"), F.min(known).alias("first"))
    across = Window.partitionBy(*SERIES).orderBy("block")
    back = Window.partitionBy(*SERIES).orderBy(F.desc("block"))
    edges = edges.select(
        *SERIES,
        "block",
        F.last("last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.last("first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("after"),
    )
    # A frame that ends at the partition's end costs the square of its rows; the same from behind is one pass.
    inside = Window.partitionBy(*SERIES, "block").orderBy("sample_index")
    backwards = Window.partitionBy(*SERIES, "block").orderBy(F.desc("sample_index"))
    filled = base.join(edges, [*SERIES, "block"]).withColumn("known", known)
    left = F.coalesce(F.last("known", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("before"))
    right = F.coalesce(F.last("known", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0)), F.col("after"))
    filled = filled.withColumn("l", left).withColumn("r", right)
    share = (F.col("sample_index") - F.col("l.i")) / (F.col("r.i") - F.col("l.i"))
    value = (
        F.when(F.col("value").isNotNull(), F.col("value"))
        .when(F.col("l").isNull(), F.col("r.v"))
        .when(F.col("r").isNull(), F.col("l.v"))
        .otherwise(F.col("l.v") + (F.col("r.v") - F.col("l.v")) * share)
    )
    return filled.withColumn("value", value).drop("known", "before", "after", "block", "l", "r")


def baseline(df: DataFrame, n: int = 100, value: str = "value") -> DataFrame:
    """Per series: baseline (mean) and baseline_std (population) of its first n samples, n_samples, signal mean and std, extremes."""
    early = F.when(F.col("sample_index") < n, F.col(value))
    return df.groupBy(*SERIES).agg(
        F.avg(early).alias("baseline_mean"),
        F.stddev_pop(early).alias("baseline_std"),
        F.count("*").alias("n_samples"),
        F.avg(value).alias("signal_mean"),
        F.stddev_pop(value).alias("signal_std"),
        F.min(value).alias("signal_min"),
        F.max(value).alias("signal_max"),
    )


def wavelength_shift(df: DataFrame, n: int = 100) -> DataFrame:
    """Adds baseline and shift: value less the mean of the series' first n samples."""
    early = df.filter(F.col("sample_index") < n).groupBy(*SERIES).agg(F.avg("value").alias("baseline"))
    return df.join(early, SERIES, "left").withColumn("shift", F.col("value") - F.col("baseline"))


def preprocess(df: DataFrame, n: int = 100) -> DataFrame:
    """dataset, channel, sample_index, time, cleaned, baseline, value (the shift)."""
    shifted = wavelength_shift(clean(df), n)
    return shifted.select(*SERIES, "sample_index", "time", F.col("value").alias("cleaned"), "baseline", F.col("shift").alias("value"))

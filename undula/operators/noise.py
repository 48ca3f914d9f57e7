"""Noise metrics of filters and baseline statistics, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.config import FILTERS, SERIES
from undula.operators.filters import apply_all
from undula.operators.preprocess import preprocess


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def first_peak(index: Column, value: Column, *more: Column) -> Column:
    """Aggregate: (index, value, ...) of the first sample with the greatest absolute value."""
    return F.min_by(F.struct(index.alias("index"), value.alias("value"), *more), F.struct(-F.abs(value), index))


def long_filters(df: DataFrame, raw: str = "value", names: tuple[str, ...] = FILTERS) -> DataFrame:
    """One row per sample and filter: raw, filtered."""
    return df.unpivot([*SERIES, "sample_index", "time", raw], list(names), "filter", "filtered").withColumnRenamed(raw, "raw")


def noise_reduction(long: DataFrame, n: int = 100) -> DataFrame:
    """Over the first n samples of each series and filter: deviations, root mean squares, reduction in percent (0 for a flat raw series)."""
    early = long.filter(F.col("sample_index") < n).groupBy(*SERIES, "filter")
    raw, filtered = F.col("raw_noise_std"), F.col("filtered_noise_std")
    made = early.agg(
        F.stddev_pop("raw").alias("raw_noise_std"), F.stddev_pop("filtered").alias("filtered_noise_std"), rms(F.col("raw")).alias("raw_noise_rms"), rms(F.col("filtered")).alias("filtered_noise_rms")
    )
    return made.withColumn("noise_reduction_percent", F.when(raw == 0, F.lit(0.0)).otherwise((raw - filtered) / raw * 100))


def filter_evaluation(long: DataFrame, n: int = 100) -> DataFrame:
    """Noise over the first n samples, and over all: the filtered peak, how much of the raw peak is left, how far it moved in time."""
    early = F.col("sample_index") < n
    peak = lambda c: first_peak(F.col("sample_index"), F.col(c), F.col("time").alias("time"))
    made = long.groupBy(*SERIES, "filter").agg(
        F.stddev_pop(F.when(early, F.col("raw"))).alias("raw_noise_std"),
        F.stddev_pop(F.when(early, F.col("filtered"))).alias("filtered_noise_std"),
        peak("raw").alias("r"),
        peak("filtered").alias("f"),
    )
    return made.select(
        "raw_noise_std",
        "filtered_noise_std",
        F.col("f.value").alias("peak_value"),
        F.col("f.time").alias("peak_time"),
        F.coalesce(F.try_divide(F.abs("f.value"), F.abs("r.value")), F.lit(0.0)).alias("peak_preservation"),
        F.abs(F.col("r.time") - F.col("f.time")).alias("peak_time_error"),
        *SERIES,
        "filter",
    )


def drift(stats: DataFrame, flat: float = 1e-12) -> DataFrame:
    """Adds drift_std and excursion_std to `preprocess.baseline` statistics; 0 for a flat baseline."""
    mean, std = F.col("baseline_mean"), F.col("baseline_std")
    far = F.greatest(F.abs(F.col("signal_min") - mean), F.abs(F.col("signal_max") - mean))
    return stats.withColumn("drift_std", F.when(std > flat, F.abs(F.col("signal_mean") - mean) / std).otherwise(0.0)).withColumn("excursion_std", F.when(std > flat, far / std).otherwise(0.0))


def experiment_metrics(samples: DataFrame, n: int = 100) -> DataFrame:
    """`filter_evaluation` of every series and filter, from raw samples."""
    return filter_evaluation(long_filters(apply_all(preprocess(samples, n))), n)


def experiment_noise(samples: DataFrame, n: int = 100) -> DataFrame:
    """`noise_reduction` of every series and filter, from raw samples."""
    return noise_reduction(long_filters(apply_all(preprocess(samples, n))), n)

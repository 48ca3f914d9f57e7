"""The earlier four-detector study: regions of one detector with peak, recovery and confirmed end."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.config import METHODS, SERIES, Detectors
from undula.lineage import cut
from undula.operators.blocks import frame, own_rows, with_halo
from undula.operators.detectors import derivative_mask, derivative_summary, method_regions, threshold_mask
from undula.operators.islands import mask_to_regions
from undula.operators.matching import samples_of
from undula.operators.noise import first_peak
from undula.operators.preprocess import baseline

#: This study's threshold is lower than the ensemble's.
STUDY = replace(Detectors(), threshold_multiplier=3.0)


def find_peaks_in(regions: DataFrame, signal: DataFrame, keys: list[str]) -> DataFrame:
    """peak_index, peak_time, peak_value: the first greatest absolute value in each region."""
    peak = first_peak(F.col("sample_index"), F.col("value"), F.col("time").alias("time"))
    made = samples_of(regions.select(*keys, "start_index", "end_index"), signal).groupBy(*keys, "start_index", "end_index").agg(peak.alias("p"))
    return made.select(*keys, "start_index", "end_index", F.col("p.index").alias("peak_index"), F.col("p.time").alias("peak_time"), F.col("p.value").alias("peak_value"))


def simple_impacts(signal: DataFrame, n: int = 100, k: float = 4.0) -> DataFrame:
    """Runs beyond the threshold, uncleaned, with their peaks."""
    return find_peaks_in(mask_to_regions(threshold_mask(signal, n, k)), signal, SERIES)


def analyse_regions(regions: DataFrame, signal: DataFrame, n: int = 100, ratio: float = 0.20, confirmation: int = 5) -> DataFrame:
    """Each region with its peak, the first sample behind that within tolerance, and the first from there on where
    `confirmation` samples are quiet, which may lie behind the region; without one, the recovery; without that, the region's end."""
    stats = baseline(signal, n).select(*SERIES, "baseline_mean", "baseline_std")
    keys = [*SERIES, "method"]
    found = regions.select(*keys, "start_index", "end_index").join(find_peaks_in(regions, signal, keys), [*keys, "start_index", "end_index"]).join(stats, SERIES)
    away = F.abs(F.col("value") - F.col("baseline_mean"))
    tolerance = F.greatest(2.0 * F.col("baseline_std"), ratio * F.abs(F.col("peak_value") - F.col("baseline_mean")))
    behind = samples_of(found, signal, "peak_index", "end_index").filter((F.col("sample_index") > F.col("peak_index")) & (away <= tolerance))
    recovery = behind.groupBy(*keys, "start_index").agg(F.min_by(F.struct("sample_index", "time"), "sample_index").alias("r"))
    f = frame(0, confirmation - 1)
    quiet = with_halo(signal.join(stats, SERIES), 0, confirmation)
    quiet = own_rows(quiet.withColumn("ok", (F.count("*").over(f) == confirmation) & (F.max(away).over(f) <= 2.0 * F.col("baseline_std")))).filter("ok")
    quiet = quiet.select(*SERIES, F.col("sample_index").alias("at"), F.struct("sample_index", "time").alias("q"))
    asked = recovery.select(*SERIES, "method", "start_index", "r", F.col("r.sample_index").alias("at"))
    back = Window.partitionBy(*SERIES).orderBy(F.desc("at"), F.col("q").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(quiet, allowMissingColumns=True)
    # From behind, a quiet sample at the recovery itself comes before it.
    ends = both.withColumn("end", F.last("q", ignorenulls=True).over(back)).filter("method IS NOT NULL")
    ends = ends.select(*keys, "start_index", "r", F.coalesce("end", "r").alias("end"))
    times = signal.select(*SERIES, F.col("sample_index").alias("start_index"), F.col("time").alias("start_time"))
    last = signal.select(*SERIES, F.col("sample_index").alias("end_index"), F.col("time").alias("region_end_time"))
    made = found.join(ends, [*keys, "start_index"], "left").join(times, [*SERIES, "start_index"]).join(last, [*SERIES, "end_index"])
    end_time = F.coalesce("end.time", "region_end_time")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start_index"))
    return made.select(
        *keys, number.alias("impact_number"), "start_index", "start_time", "peak_index", "peak_time", "peak_value", F.col("r.sample_index").alias("recovery_index"), F.col("r.time").alias("recovery_time"),
        F.coalesce("end.sample_index", "end_index").alias("end_index"), end_time.alias("end_time"), (end_time - F.col("start_time")).alias("duration"),
    )


def study(signal: DataFrame, p: Detectors = STUDY) -> DataFrame:
    """The impacts of all four detectors in each series."""
    regions = None
    for m in METHODS:
        one = method_regions(signal, m, p)
        regions = one if regions is None else regions.unionByName(one)
    return analyse_regions(cut(regions, "regions"), signal, p.baseline_samples)


def study_summary(signal: DataFrame, impacts: DataFrame, p: Detectors = STUDY) -> DataFrame:
    """One row per series and detector: regions, baseline, threshold and the derivative's extremes."""
    parameter = {"peak": p.prominence_multiplier, "threshold": p.threshold_multiplier, "derivative": p.derivative_multiplier, "change_point": p.change_point_threshold}
    counts = impacts.groupBy(*SERIES, "method").agg(F.count("*").alias("detected_regions"))
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(v).alias("parameter")) for m, v in parameter.items()])).alias("m")
    stats = baseline(signal, p.baseline_samples).select(*SERIES, "baseline_mean", "baseline_std", rows).select(*SERIES, "baseline_mean", "baseline_std", "m.*")
    slopes = derivative_summary(derivative_mask(signal, p.baseline_samples, p.derivative_multiplier)).withColumn("method", F.lit("derivative"))
    made = stats.join(counts, [*SERIES, "method"], "left").join(slopes, [*SERIES, "method"], "left")
    threshold = F.when(F.col("method").isin("peak", "threshold"), F.col("parameter") * F.col("baseline_std"))
    return made.select(
        *SERIES, "method", F.coalesce("detected_regions", F.lit(0)).alias("detected_regions"), "baseline_mean", "baseline_std", threshold.alias("threshold"), "parameter", "max_derivative",
        F.col("max_deviation").alias("max_derivative_deviation"), "detected_samples",
    )

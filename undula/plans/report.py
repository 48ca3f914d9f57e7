"""Summaries for people: what a run found, as lines of text. Only tables with a few rows are collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

RULE = "=" * 70


def _shown(x) -> str:
    return "-" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)


def heading(text: str) -> list[str]:
    return [RULE, text, RULE]


def table(df: DataFrame, limit: int = 200) -> list[str]:
    """The first rows of a table in columns, and how many more there are."""
    rows = [[_shown(x) for x in r] for r in df.limit(limit + 1).collect()]
    more, rows = len(rows) > limit, [df.columns, *rows[:limit]]
    widths = [max(map(len, c)) for c in zip(*rows, strict=True)]
    lines = ["  ".join(x.rjust(n) for x, n in zip(r, widths, strict=True)) for r in rows]
    return lines + ["..."] * more


def evaluation(report: DataFrame, by_dataset: DataFrame, rejected: DataFrame, comparison: DataFrame) -> list[str]:
    """The evaluation without ground truth: `consistency_report`, `channel_consistency`, `rejections`, `compare_methods`."""
    metrics = report.filter(~F.col("metric").startswith("rejected_") & ~F.col("metric").startswith("cross_channel_")).orderBy("metric")
    return [
        *heading("EVALUATION"), "Ground truth: not available; figures are descriptive.", "", *table(metrics), "", "Channel consistency", *table(by_dataset.orderBy("dataset")), "",
        "Rejections", *(table(rejected) if not rejected.isEmpty() else ["none"]), "", *heading("METHODS"), *table(comparison.orderBy("dataset", "approach")),
    ]


def features(summary: Row) -> list[str]:
    """The summary of the features of all domains."""
    s = summary.asDict()
    return [
        *heading("FEATURES"),
        f"Accepted events         : {s['events']}",
        f"Successfully analyzed   : {s['ok_events']}",
        f"Partial analysis        : {s['partial_events']}",
        f"Failed analysis         : {s['failed_events']}",
        f"Valid STFT              : {s['valid_stft']}",
        f"Dominant frequency (Hz) : mean={_shown(s['dominant_frequency_mean'])} median={_shown(s['dominant_frequency_median'])} std={_shown(s['dominant_frequency_std'])}",
        f"Spectral energy         : mean={_shown(s['spectral_energy_mean'])} median={_shown(s['spectral_energy_median'])}",
        f"Spectral entropy (bits) : mean={_shown(s['spectral_entropy_mean'])} median={_shown(s['spectral_entropy_median'])}",
    ]


def shape(found: DataFrame, failed: DataFrame) -> list[str]:
    """How many accepted events have shape features, and how many have no residual."""
    s = found.agg(F.count("*").alias("n"), F.count("residual_shift").alias("residual"), F.count_distinct("dataset").alias("datasets")).first()
    return [
        *heading("SHAPE FEATURES"), f"Datasets with events    : {s['datasets']}", f"Accepted events         : {s['n']}", f"Events with residual    : {s['residual']}",
        f"Events without residual : {s['n'] - s['residual']}", f"Files that failed       : {failed.count()}",
    ]


def noise(reduction: DataFrame, failed: DataFrame) -> list[str]:
    """Mean noise reduction of each filter, and files that failed."""
    by_filter = reduction.groupBy("filter").agg(F.count("*").alias("signals"), F.avg("noise_reduction_percent").alias("mean_noise_reduction_percent")).orderBy("filter")
    return [*heading("FILTERS"), *table(by_filter), "", "Files that failed", *(table(failed.orderBy("file")) if not failed.isEmpty() else ["none"])]


def detection(summary: DataFrame) -> list[str]:
    return [*heading("DETECTION"), *table(summary)]

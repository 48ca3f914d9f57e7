"""Evaluation of events without ground truth, comparison of detectors, and choice of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.config import METHODS, PERMISSIVE, SERIES, Parameters
from undula.lineage import cut
from undula.operators.events import ensemble_events


def per_channel(events: DataFrame, signal: DataFrame) -> DataFrame:
    """Candidate, accepted and rejected events of every series, those without events too."""
    counts = events.groupBy(*SERIES).agg(F.count("*").alias("candidate_events"), F.count_if("accepted").alias("accepted_events"))
    made = signal.select(*SERIES).distinct().join(counts, SERIES, "left").fillna(0, ["candidate_events", "accepted_events"])
    return made.withColumn("rejected_events", F.col("candidate_events") - F.col("accepted_events"))


def characteristics(accepted: DataFrame, by: list[str] = ()) -> DataFrame:
    """Durations, peaks, deviations, evidence and methods of accepted events."""
    dev = F.when(F.col("baseline_std") > 0, F.abs(F.col("peak_value") - F.col("baseline_mean")) / F.col("baseline_std"))
    return accepted.groupBy(*by).agg(
        F.count("*").alias("n_events"),
        F.avg("duration").alias("duration_mean_s"),
        F.stddev_pop("duration").alias("duration_std_s"),
        F.avg("peak_value").alias("peak_value_mean"),
        F.max(F.abs("peak_value")).alias("peak_value_max"),
        F.avg(dev).alias("peak_dev_std_mean"),
        F.avg("evidence_score").alias("evidence_mean"),
        F.avg("method_count").alias("method_count_mean"),
    )


def agreement(accepted: DataFrame) -> DataFrame:
    """How many events so many methods support, and the mean over all events."""
    counts = accepted.groupBy("method_count").agg(F.count("*").alias("events"))
    w = Window.partitionBy()
    return counts.withColumn("mean_method_count", F.sum(F.col("method_count") * F.col("events")).over(w) / F.sum("events").over(w))


def timing(accepted: DataFrame, tolerance: int = 10) -> DataFrame:
    """Spread (population deviation, in samples) of the peaks that an event's methods imply, over events with two or more.

    Sums of whole numbers, from an event's first peak on, are exact: a spread that equals the tolerance is within it, in any order.
    """
    at = F.map_values("method_peak_indices")
    each = accepted.select(*SERIES, "event_id", F.explode(at).alias("at"), F.array_min(at).alias("least"))
    d, n = (F.col("at") - F.col("least")).cast("double"), F.count("*")
    s = F.sqrt(n * F.sum(d * d) - F.sum(d) * F.sum(d)) / n
    spread = each.groupBy(*SERIES, "event_id").agg(s.alias("s"), n.alias("n")).filter("n >= 2")
    n = accepted.agg(F.count("*").alias("n_events"))
    made = spread.agg(F.avg("s").alias("mean_spread_samples"), F.percentile("s", F.lit(0.5)).alias("median_spread_samples"), F.when(F.count("*") > 0, F.count_if(F.col("s") <= tolerance)).alias("events_within_tolerance"))
    return n.withColumn("one", F.lit(1)).join(made.withColumn("one", F.lit(1)), "one").drop("one")


def channel_consistency(accepted: DataFrame, signal: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Per dataset: accepted events, and those with one of another channel within `tolerance` seconds.

    The nearest event of another channel on either side is found by windows over time, not by pairing: the last before from another
    channel is the last of all, or, where that is of the same channel, the last before that run of it; so for what lies behind.
    """
    e = accepted.select("dataset", "channel", "event_id", "peak_time")
    w = Window.partitionBy("dataset").orderBy("peak_time", "channel", "event_id")
    back = Window.partitionBy("dataset").orderBy(F.desc("peak_time"), F.desc("channel"), F.desc("event_id"))
    e = e.withColumn("prev", F.lag(F.struct("channel", "peak_time")).over(w)).withColumn("next", F.lead(F.struct("channel", "peak_time")).over(w))
    starts = F.when(F.col("prev.channel") != F.col("channel"), F.col("prev.peak_time"))
    ends = F.when(F.col("next.channel") != F.col("channel"), F.col("next.peak_time"))
    e = e.withColumn("before", F.last(starts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.last(ends, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.coalesce((F.col("peak_time") - F.col("before") <= tolerance) | (F.col("after") - F.col("peak_time") <= tolerance), F.col("peak_time") - F.col("before") <= tolerance, F.col("after") - F.col("peak_time") <= tolerance, F.lit(False))
    counts = e.groupBy("dataset").agg(F.count("*").alias("n_events"), F.count_if(near).alias("events_with_cross_channel_support"))
    channels = signal.groupBy("dataset").agg(F.count_distinct("channel").alias("n_channels"))
    made = channels.join(counts, "dataset", "left").fillna(0, ["n_events", "events_with_cross_channel_support"])
    return made.withColumn("fraction_with_cross_channel_support", F.try_divide("events_with_cross_channel_support", "n_events"))


def rejections(events: DataFrame) -> DataFrame:
    """Rejected events by the rule's name, most first; a missing recovery keeps its whole text."""
    reason = F.coalesce("rejection_reason", F.lit("unknown"))
    name = F.when(reason.startswith("no_confirmed_recovery"), reason).otherwise(F.regexp_extract(reason, "^[a-z_]+", 0))
    return events.filter(~F.col("accepted")).groupBy(name.alias("rejection_reason")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "rejection_reason")


def single_method(signal: DataFrame, method: str, p: Parameters = Parameters()) -> DataFrame:
    """One detector's events through matching, under the permissive rules."""
    return ensemble_events(signal, (method,), p, PERMISSIVE)


def compare_methods(signal: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Per dataset and approach (the ensemble and each detector): the characteristics of its accepted events."""
    made = cut(ensemble_events(signal, p=p), "events").withColumn("approach", F.lit("ensemble"))
    for m in METHODS:
        made = made.unionByName(cut(single_method(signal, m, p), "events").withColumn("approach", F.lit(m)))
    spine = signal.select("dataset").distinct().withColumn("approach", F.explode(F.array(*[F.lit(a) for a in ("ensemble", *METHODS)])))
    found = characteristics(made.filter("accepted"), ["dataset", "approach"])
    return spine.join(found, ["dataset", "approach"], "left").fillna(0, ["n_events"])


def consistency_report(events: DataFrame, signal: DataFrame) -> DataFrame:
    """metric, value: all figures of the evaluation in one table."""
    accepted = events.filter("accepted")

    def stacked(df: DataFrame, prefix: str) -> DataFrame:
        cols = [c for c in df.columns]
        pairs = F.explode(F.array(*[F.struct(F.lit(prefix + c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("m")
        return df.select(pairs).select("m.*")

    totals = events.agg(F.count_if("accepted").alias("total_accepted_events"), F.count("*").alias("total_candidate_events"))
    out = stacked(totals, "").unionByName(stacked(characteristics(accepted), "")).unionByName(stacked(timing(accepted), "timing_"))
    by_count = agreement(accepted).select(F.concat(F.lit("agreement_"), F.col("method_count").cast("string")).alias("metric"), F.col("events").cast("double").alias("value"))
    by_reason = rejections(events).select(F.concat(F.lit("rejected_"), "rejection_reason").alias("metric"), F.col("count").cast("double").alias("value"))
    by_dataset = channel_consistency(accepted, signal).select(F.concat(F.lit("cross_channel_fraction_"), "dataset").alias("metric"), F.col("fraction_with_cross_channel_support").alias("value"))
    return out.unionByName(by_count).unionByName(by_reason).unionByName(by_dataset)


def evaluate_methods(signal: DataFrame, p: Parameters = Parameters(), low: float = 0.1, high: float = 3.0) -> DataFrame:
    """Per detector: accepted events, datasets covered, coverage, median deviation, share of plausible durations, score."""
    made = None
    for m in METHODS:
        one = cut(single_method(signal, m, p), "events").filter("accepted").select(F.lit(m).alias("method"), "dataset", "duration", F.when(F.col("deviation_std") < float("inf"), F.col("deviation_std")).alias("dev"))
        made = one if made is None else made.unionByName(one)
    total = signal.agg(F.count_distinct("dataset").alias("n_datasets")).withColumn("one", F.lit(1))
    spine = signal.sparkSession.createDataFrame([(i, m) for i, m in enumerate(METHODS)], "rank int, method string").withColumn("one", F.lit(1))
    found = made.groupBy("method").agg(
        F.count("*").alias("accepted_events"),
        F.count_distinct("dataset").alias("datasets_covered"),
        F.percentile("dev", F.lit(0.5)).alias("median_dev_std"),
        F.avg(F.col("duration").between(low, high).cast("double")).alias("plausible_fraction"),
    )
    all_ = spine.join(total, "one").join(found, "method", "left").fillna(0, ["accepted_events", "datasets_covered"]).fillna(0.0, ["median_dev_std", "plausible_fraction"])
    coverage = F.try_divide("datasets_covered", "n_datasets")
    return all_.withColumn("coverage", coverage).withColumn("score", F.col("coverage") * F.col("median_dev_std") * F.col("plausible_fraction")).select(
        "method", "accepted_events", "datasets_covered", "coverage", "median_dev_std", "plausible_fraction", "score", "rank"
    )


def select_best(evaluated: DataFrame) -> str:
    """The method with the highest score, the first in order of several."""
    top = evaluated.orderBy(F.desc("score"), "rank").limit(1).collect()
    if not top:
        raise RuntimeError("no method could be evaluated")
    return top[0]["method"]

"""Events from regions: evidence, boundaries, rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.config import METHODS, PERMISSIVE, SERIES, Parameters, Refinement, Rules, Weights
from undula.lineage import cut
from undula.operators.detectors import method_regions, run_detectors
from undula.operators.filters import prepared
from undula.operators.matching import match_groups, numbered, samples_of, split_groups
from undula.operators.noise import drift, first_peak
from undula.operators.preprocess import baseline

#: Exported columns; fixed values, as are the texts of the rejections.
COLUMNS = (
    "event_id", "dataset", "channel", "start_index", "peak_index", "end_index", "start_time", "peak_time", "end_time", "peak_value",
    "duration", "detection_methods", "method_count", "evidence_score", "accepted", "rejection_reason",
)


def evidence(methods: Column, weights: Weights = Weights()) -> Column:
    """Sum of the weights of the methods in an array, between 0 and 1; unknown ones weigh nothing."""
    w = F.create_map(*[x for k, v in weights.normalised().items() for x in (F.lit(k), F.lit(v))])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(methods, F.lit(0.0), lambda acc, m: acc + F.coalesce(F.try_element_at(w, m), F.lit(0.0)))))


def recovery_tolerance(sigma: Column, deviation: Column, p: Refinement = Refinement()) -> Column:
    return F.greatest(p.noise_std * sigma, p.recovery_ratio * deviation)


def deviation_std(peak: Column, mean: Column, sigma: Column, flat: float = 1e-12) -> Column:
    """Distance from the baseline mean in its deviations; infinite for a flat baseline."""
    return F.when(sigma <= flat, F.lit(float("inf"))).otherwise(F.abs(peak - mean) / sigma)


def invariants(events: DataFrame) -> DataFrame:
    """The events, or an error for one whose places, times or evidence are out of order."""
    ok = F.col("start_index").between(0, F.col("peak_index")) & (F.col("peak_index") <= F.col("end_index")) & F.col("peak_time").between(F.col("start_time"), F.col("end_time")) & F.col("evidence_score").between(0, 1)
    return events.withColumn("event_id", F.when(ok, F.col("event_id")).otherwise(F.raise_error(F.concat(F.lit("event out of order: "), "event_id")).cast("string")))


def group_peaks(groups: DataFrame, samples: DataFrame) -> DataFrame:
    """One candidate per (sub-)group: its hull, methods, first greatest absolute value, and the peak of each method's last region."""
    hull = groups.groupBy(*SERIES, "event_id", "k").agg(
        F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"), F.array_sort(F.collect_set("method")).alias("methods")
    )
    last = groups.groupBy(*SERIES, "event_id", "method").agg(F.max_by(F.struct("start_index", "end_index"), "region_idx").alias("r")).select(*SERIES, "event_id", "method", "r.*")
    peaks = samples_of(last, samples).groupBy(*SERIES, "event_id", "method").agg(first_peak(F.col("sample_index"), F.col("value")).alias("p"))
    implied = peaks.groupBy(*SERIES, "event_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "p.index")))).alias("method_peak_indices"))
    return hull.join(implied, [*SERIES, "event_id"])


def refine(candidates: DataFrame, samples: DataFrame, stats: DataFrame, p: Refinement = Refinement()) -> DataFrame:
    """Peak within the region, then both ends where the signal is back within the tolerance, then the peak within those.

    One range join brings an event's samples, with the few behind its end that a confirmed recovery may need.
    """
    c = p.confirmation
    base = candidates.join(stats.select(*SERIES, "baseline_mean", "baseline_std", "n_samples"), SERIES).withColumn("reach", F.col("end_index") + c - 1)
    wide = samples_of(base, samples, "start_index", "reach")
    key = [*SERIES, "event_id"]
    w = Window.partitionBy(*key)
    i, inside = F.col("sample_index"), F.col("sample_index") <= F.col("end_index")
    wide = wide.withColumn("p0", F.min_by(F.struct(i.alias("index"), F.col("value")), F.when(inside, F.struct(-F.abs("value"), i))).over(w))
    tolerance = recovery_tolerance(F.col("baseline_std"), F.abs(F.col("p0.value") - F.col("baseline_mean")), p)
    wide = wide.withColumn("tolerance", tolerance).withColumn("quiet", (F.abs(F.col("value") - F.col("baseline_mean")) <= F.col("tolerance")).cast("int"))
    ahead = w.orderBy("sample_index").rowsBetween(0, c - 1)
    wide = wide.withColumn("run", F.when(F.count("*").over(ahead) == c, F.sum("quiet").over(ahead)))
    start = F.coalesce(F.max(F.when((i < F.col("p0.index")) & (F.col("quiet") == 1), i)).over(w) + 1, F.col("start_index"))
    end_ok = (i >= F.col("p0.index")) & (i <= F.least(F.col("end_index"), F.col("n_samples") - c)) & (F.col("run") == c)
    end = F.coalesce(F.min(F.when(end_ok, i)).over(w), F.col("end_index"))
    wide = wide.withColumns({"new_start": start, "new_end": end}).filter(i.between(F.col("new_start"), F.col("new_end")))
    peak = first_peak(i, F.col("value"), F.col("time").alias("time"))
    again = wide.groupBy(*key).agg(
        peak.alias("p"), F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.first("new_start").alias("new_start"), F.first("new_end").alias("new_end"), F.first("tolerance").alias("recovery_tolerance")
    )
    kept = base.drop("reach").withColumnsRenamed({"start_index": "original_start_index", "end_index": "original_end_index"})
    return kept.join(again, key).select(
        *[c for c in kept.columns],
        F.col("new_start").alias("start_index"),
        F.col("p.index").alias("peak_index"),
        F.col("new_end").alias("end_index"),
        "start_time",
        F.col("p.time").alias("peak_time"),
        "end_time",
        F.col("p.value").alias("peak_value"),
        (F.col("end_time") - F.col("start_time")).alias("duration"),
        "recovery_tolerance",
    )


def classify(events: DataFrame, rules: Rules = Rules(), weights: Weights = Weights()) -> DataFrame:
    """Adds evidence_score, accepted and rejection_reason; the first rule that an event fails gives the reason."""
    events = events.withColumn("method_count", F.size("methods")).withColumn("evidence_score", evidence(F.col("methods"), weights))
    length = F.col("end_index") - F.col("start_index") + 1
    dev = deviation_std(F.col("peak_value"), F.col("baseline_mean"), F.col("baseline_std"), rules.flat_std)
    shown = F.when(dev == float("inf"), F.lit("inf")).otherwise(F.format_string("%.2f", dev))
    n, score = F.col("method_count"), F.col("evidence_score")
    reason = (
        F.when(length < rules.min_duration_samples, F.format_string(f"duration_below_min_samples (%d < {rules.min_duration_samples})", length))
        .when(F.col("end_index") >= F.col("n_samples") - rules.end_margin, F.format_string("no_confirmed_recovery (end_index=%d, signal_length=%d)", "end_index", "n_samples"))
        .when((n <= rules.noise_like_methods) & (dev <= rules.noise_like_std), F.format_string("noise_like_event (methods=%d, dev_std=%s)", n, shown))
        .when(dev < rules.min_deviation_std, F.format_string(f"low_amplitude (dev_std=%s < {rules.min_deviation_std})", shown))
        .when(n < rules.min_agreement, F.format_string(f"insufficient_method_agreement (%d < {rules.min_agreement})", n))
        .when(score < rules.min_evidence, F.format_string(f"evidence_below_minimum (%.3f < {rules.min_evidence})", score))
    )
    made = events.withColumn("rejection_reason", reason).withColumn("accepted", F.col("rejection_reason").isNull()).withColumn("deviation_std", dev)
    return made.withColumn("detection_methods", F.array_join("methods", "|"))


def as_table(events: DataFrame) -> DataFrame:
    """The sixteen exported columns; no reason is an empty string."""
    return events.withColumn("rejection_reason", F.coalesce("rejection_reason", F.lit(""))).select(*COLUMNS)


def ensemble_events(signal: DataFrame, methods: tuple[str, ...] = METHODS, p: Parameters = Parameters(), rules: Rules | None = None) -> DataFrame:
    """All candidates of all series of a filtered signal, accepted or rejected."""
    regions = cut(run_detectors(signal, methods, p.detectors), "regions")
    return events_from_regions(regions, signal, p, rules)


def events_from_regions(regions: DataFrame, signal: DataFrame, p: Parameters = Parameters(), rules: Rules | None = None) -> DataFrame:
    groups = numbered(split_groups(match_groups(regions, p.detectors.match_tolerance), p.detectors.split_min_gap))
    groups = cut(groups, "groups")
    stats = baseline(signal, p.sampling.baseline_samples)
    return invariants(classify(refine(group_peaks(groups, signal), signal, stats, p.refinement), rules or p.rules, p.weights))


def single_method_events(signal: DataFrame, method: str, p: Parameters = Parameters()) -> DataFrame:
    """One event per region of one detector, without matching, under the permissive rules."""
    regions = cut(method_regions(signal, method, p.detectors), "regions")
    stats = baseline(signal, p.sampling.baseline_samples)
    w = Window.partitionBy(*SERIES).orderBy("start_index")
    one = regions.withColumn("k", F.row_number().over(w)).withColumn("event_id", F.format_string("%s-%s-%03d", *SERIES, "k"))
    none = F.lit(None).cast("map<string,bigint>")
    candidates = one.select(*SERIES, "event_id", "k", "start_index", "end_index", F.array("method").alias("methods"), none.alias("method_peak_indices"))
    return invariants(classify(refine(candidates, signal, stats, p.refinement), PERMISSIVE, p.weights))


def channel_summary(signal: DataFrame, events: DataFrame, n: int = 100) -> DataFrame:
    """One row per series: baseline and signal statistics, drift, and its candidates, accepted and rejected events."""
    counts = events.groupBy(*SERIES).agg(F.count("*").alias("candidate_events"), F.count_if("accepted").alias("accepted_events"))
    stats = drift(baseline(signal, n)).join(counts, SERIES, "left").fillna(0, ["candidate_events", "accepted_events"])
    return stats.select(
        *SERIES, "baseline_mean", "baseline_std", "signal_mean", "signal_std", "drift_std", "excursion_std", "candidate_events", "accepted_events",
        (F.col("candidate_events") - F.col("accepted_events")).alias("rejected_events"),
    )


def ensemble(samples: DataFrame, filter_name: str = "butterworth", p: Parameters = Parameters()) -> tuple[DataFrame, DataFrame]:
    """The filtered signal and its events, from raw samples."""
    signal = cut(prepared(samples, filter_name, p.sampling.baseline_samples, p.filters), "signal")
    return signal, cut(ensemble_events(signal, p=p), "events")


def selected(samples: DataFrame, method: str = "peak", channel: str = "FBG2", p: Parameters = Parameters()) -> tuple[DataFrame, DataFrame]:
    """The selected channel's Savitzky-Golay signal and one detector's events."""
    signal = cut(prepared(samples.filter(F.col("channel") == channel), "savitzky_golay", p.sampling.baseline_samples, p.filters), "signal")
    return signal, cut(single_method_events(signal, method, p), "events")

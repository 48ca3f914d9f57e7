"""Queries over the star-schema tables, one or more for each family of operators, and the same in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.config import SERIES, Detectors, Parameters, Refinement, Rules, Sampling
from undula.functions import sql as sql_functions
from undula.lineage import cut, new_path
from undula.operators import detectors, evaluate, events, features, filters, islands, legacy, matching, noise
from undula.operators.preprocess import baseline, clean, preprocess, wavelength_shift
from undula.plans import plots
from undula.sources import readers, sinks

#: Event values are spread like an exponential; these give runs.
LOOSE = Detectors(threshold_multiplier=0.8, derivative_multiplier=0.3, change_point_threshold=1.0, min_samples=2)
LOOSE_ALL = Parameters(detectors=LOOSE, refinement=Refinement(noise_std=1.0), rules=Rules(min_deviation_std=0.5, noise_like_std=0.5))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and minus zero as zero, so that results compare exactly.

    As the SQL does it: times a power of ten, to whole numbers, and back. Rounding the decimal text of a double differs from that
    where the product is rounded to a half itself, in slopes of 1e9 for one.
    """
    power = 10.0**digits

    def one(x: Column) -> Column:
        y = F.round(x * power) / power
        return F.when(F.abs(y) < float("inf"), y).otherwise(x) + F.lit(0.0)

    return df.select(*[one(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _gaps(df: DataFrame) -> DataFrame:
    """The series with every seventh run of three samples missing."""
    i = F.col("sample_index")
    return df.withColumn("value", F.when((i % 7 < 2) | (i < 3), None).otherwise(F.col("value")))


def _segments(df: DataFrame) -> DataFrame:
    """Each series as one event over all of its samples."""
    w = df.groupBy(*SERIES).agg(F.min("sample_index").alias("start_index"), F.max("sample_index").alias("end_index"))
    return w.withColumn("event_id", F.concat_ws("-", *SERIES))


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    e = readers.emb(spark, sf)
    return e.select(*SERIES, F.concat_ws("-", *SERIES).alias("event_id"), F.col("sample_index").alias("pos"), F.count("*").over(_by_series()).alias("n"), "time", "value")


def _by_series():
    return Window.partitionBy(*SERIES)


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    """The regions of all detectors in the series by type, which are numbered once."""
    return cut(detectors.run_detectors(cut(readers.ev_type(spark, sf), "series"), p=LOOSE), "regions")


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    return cut(filters.apply_all(preprocess(readers.ev_type(spark, sf)).select(*SERIES, "sample_index", "time", "value")), "filtered")


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return noise.long_filters(_filtered(spark, sf))


_USER = replace(LOOSE_ALL, detectors=replace(LOOSE, baseline_samples=16), sampling=Sampling(baseline_samples=16))


def _found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    signal = cut(filters.savitzky_golay(readers.ev_user(spark, sf)).select(*SERIES, "sample_index", "time", F.col("savitzky_golay").alias("value")), "signal")
    return signal, cut(events.ensemble_events(signal, p=_USER), "events")


def _user_regions(s: DataFrame) -> DataFrame:
    return cut(detectors.method_regions(s, "threshold", replace(LOOSE, baseline_samples=16)), "regions")


def _recordings(spark: SparkSession, sf: str) -> str:
    """A folder with a recording for each type of event: the value, twice the value, and every fifth a word that isn't a number."""
    e = readers.ev_type(spark, sf)
    v = F.col("value").cast("string")
    cells = [F.col("time").cast("string"), *[F.lit("1")] * 4, v, (2 * F.col("value")).cast("string"), F.when(F.col("sample_index") % 5 == 0, "none").otherwise(v)]
    path = new_path(spark, "recordings")
    lines = e.repartition("channel").sortWithinPartitions("channel", "sample_index").select(F.col("channel").alias("name"), F.concat_ws("\t", *cells).alias("line"))
    lines.write.partitionBy("name").text(f"{path}/parts")
    sinks.gather_files(spark, f"{path}/parts", f"{path}/raw", ".txt")
    return f"{path}/raw"


def s_series(spark, sf):
    return rounded(readers.li_supp(spark, sf))


def p_clean(spark, sf):
    return rounded(clean(_gaps(readers.ev_type(spark, sf))))


def p_shift(spark, sf):
    return rounded(wavelength_shift(readers.ev_type(spark, sf)).select(*SERIES, "sample_index", "baseline", "shift"))


def f_moving_average(spark, sf):
    return rounded(filters.moving_average(readers.ev_type(spark, sf)).select(*SERIES, "sample_index", "moving_average"))


def f_savitzky_golay(spark, sf):
    return rounded(filters.savitzky_golay(readers.ev_type(spark, sf)).select(*SERIES, "sample_index", "savitzky_golay"))


def f_median(spark, sf):
    return rounded(filters.median(readers.ev_type(spark, sf)).select(*SERIES, "sample_index", "median"))


def f_butterworth(spark, sf):
    return rounded(filters.butterworth(readers.ev_type(spark, sf)).select(*SERIES, "sample_index", "butterworth"))


def s_recordings(spark, sf):
    """Written as recordings and read as such."""
    return rounded(readers.samples(readers.read_raw(spark, _recordings(spark, sf))))


def s_filtered(spark, sf):
    """All four filters, written as CSV and read again."""
    path = new_path(spark, "filtered")
    sinks.write_filtered(_filtered(spark, sf), f"{path}/parquet", f"{path}/csv")
    return rounded(readers.read_filtered(spark, f"{path}/csv"))


def s_events(spark, sf):
    """The events as CSV, read again; of what is empty there, the reason."""
    signal, found = _found(spark, sf)
    path = new_path(spark, "found")
    sinks.write_events(found, events.channel_summary(signal, found, 16), path)
    return rounded(spark.read.schema(events.as_table(found).schema).option("header", True).csv(f"{path}/events_all_datasets").fillna("", ["rejection_reason"]))


def j_summary(spark, sf):
    signal, found = _found(spark, sf)
    return rounded(events.channel_summary(signal, found, 16))


def n_experiment(spark, sf):
    """Filter metrics from recordings, all channels and filters."""
    samples = readers.samples(readers.read_raw(spark, _recordings(spark, sf)))
    return rounded(noise.experiment_metrics(samples))


def n_noise_reduction(spark, sf):
    return rounded(noise.noise_reduction(_long(spark, sf)))


def n_filter_evaluation(spark, sf):
    return rounded(noise.filter_evaluation(_long(spark, sf)))


def n_drift(spark, sf):
    return rounded(noise.drift(baseline(readers.ev_user(spark, sf), 16)))


def d_threshold(spark, sf):
    return detectors.method_regions(readers.ev_type(spark, sf), "threshold", LOOSE)


def d_derivative(spark, sf):
    return rounded(detectors.derivative(readers.ev_type(spark, sf)).select(*SERIES, "sample_index", "derivative"), 3)


def d_derivative_regions(spark, sf):
    return detectors.method_regions(readers.ev_type(spark, sf), "derivative", LOOSE)


def d_change_point(spark, sf):
    return detectors.method_regions(readers.ev_type(spark, sf), "change_point", LOOSE)


def d_peaks(spark, sf):
    return rounded(detectors.peaks(readers.ev_type(spark, sf)))


def d_simple_impacts(spark, sf):
    return rounded(legacy.simple_impacts(readers.ev_type(spark, sf), 100, 1.5))


def d_study(spark, sf):
    signal = filters.moving_average(readers.ev_type(spark, sf)).select(*SERIES, "sample_index", "time", F.col("moving_average").alias("value"))
    return rounded(legacy.study(cut(signal, "signal"), replace(LOOSE, threshold_multiplier=0.6)))


def r_islands(spark, sf):
    return islands.mask_to_regions(detectors.threshold_mask(readers.ev_type(spark, sf), 100, 0.8))


def r_persistent(spark, sf):
    s = detectors.threshold_mask(readers.ev_user(spark, sf), 16, 0.8).select(*SERIES, "sample_index", "mask")
    return islands.persistent(s, 2)


def m_match_groups(spark, sf):
    g = matching.match_groups(_regions(spark, sf), 5)
    return g.groupBy(*SERIES, "island").agg(F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"), F.count("*").alias("regions"), F.array_join(F.array_sort(F.collect_set("method")), "|").alias("methods")).drop("island")


def m_support_zones(spark, sf):
    return matching.support_zones(matching.match_groups(_regions(spark, sf), 5)).drop("island")


def m_events(spark, sf):
    g = matching.numbered(matching.split_groups(matching.match_groups(_regions(spark, sf), 5), 3))
    return g.groupBy("event_id").agg(F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"), F.count("*").alias("regions"))


def m_overlap(spark, sf):
    """All regions of the two methods that meet, by position."""
    sql_functions.register(spark)
    t = _regions(spark, sf).select(*SERIES, "method", "region_idx", "start_index", "end_index")
    both = matching.meeting(t.filter("method = 'threshold'"), t.filter("method = 'derivative'"), 5)
    cols = "a.start_index, a.end_index, b.start_index, b.end_index"
    return rounded(both.selectExpr("channel", "a.region_idx AS region_idx", "b.region_idx AS other_idx", f"overlap_fraction({cols}) AS overlap", f"regions_adjacent({cols}, 5) AS near"))


def e_evidence(spark, sf):
    g = matching.match_groups(_regions(spark, sf), 5).groupBy(*SERIES, "island").agg(F.collect_set("method").alias("methods"))
    return rounded(g.groupBy(*SERIES, events.evidence(F.col("methods")).alias("evidence")).agg(F.count("*").alias("groups")))


def b_refine(spark, sf):
    s = cut(readers.ev_user(spark, sf), "series")
    c = _user_regions(s).select(*SERIES, F.format_string("%s-%s-%03d", *SERIES, "region_idx").alias("event_id"), "start_index", "end_index")
    made = events.refine(c, s, baseline(s, 16), LOOSE_ALL.refinement)
    return rounded(made.select("event_id", "original_start_index", "original_end_index", "start_index", "peak_index", "end_index", "peak_value", "recovery_tolerance"))


def j_events(spark, sf):
    return rounded(events.as_table(_found(spark, sf)[1]))


def a_shape(spark, sf):
    signal, found = _found(spark, sf)
    return rounded(features.shape_features(found.filter("accepted"), signal), 3)


def a_trapezoid(spark, sf):
    return rounded(features.trapezoid(_windows(spark, sf)))


def a_entropy(spark, sf):
    return rounded(features.density_entropy(_windows(spark, sf)), 4)


def a_post_level(spark, sf):
    s = cut(readers.ev_user(spark, sf), "series")
    r = _user_regions(s).withColumn("event_id", F.format_string("%s-%s-%03d", *SERIES, "region_idx"))
    # Regions of one series are kept apart by making each series its own dataset.
    r, s = (x.withColumn("dataset", F.col("channel")) for x in (r, s))
    return rounded(features.post_level(r, s).select("event_id", "post_impact_level", "residual_n_samples", "residual_reason"))


def t_time_domain(spark, sf):
    return rounded(features.time_features(_windows(spark, sf)))


def q_sampling_frequency(spark, sf):
    return rounded(features.sampling_frequency(readers.ev_type(spark, sf)))


def q_spectrum(spark, sf):
    return rounded(features.spectra(_windows(spark, sf)))


def q_dft(spark, sf):
    return rounded(features.dft_spectra(_windows(spark, sf)))


def q_spectral_features(spark, sf):
    w = _windows(spark, sf)
    fs = features.sampling_frequency(readers.emb(spark, sf))
    return rounded(features.spectral_features(features.spectra(w), fs), 5)


def z_stft(spark, sf):
    return rounded(features.stft_features(_windows(spark, sf), features.sampling_frequency(readers.emb(spark, sf))))


def z_multidomain(spark, sf):
    signal, found = _found(spark, sf)
    accepted = found.filter("accepted")
    shape = cut(features.shape_features(accepted, signal), "shape")
    return rounded(features.multidomain_features(accepted, signal, shape))


def z_summary(spark, sf):
    return rounded(features.feature_summary(cut(z_multidomain(spark, sf), "features")))


def v_report(spark, sf):
    signal, found = _found(spark, sf)
    return rounded(evaluate.consistency_report(found, signal))


def v_per_channel(spark, sf):
    signal, found = _found(spark, sf)
    return evaluate.per_channel(found, signal)


def v_channel_consistency(spark, sf):
    signal, found = _found(spark, sf)
    return rounded(evaluate.channel_consistency(found.filter("accepted"), signal, 30.0))


def v_rejections(spark, sf):
    return evaluate.rejections(_found(spark, sf)[1])


def l_methods(spark, sf):
    signal = cut(filters.moving_average(readers.ev_type(spark, sf)).select(*SERIES, "sample_index", "time", F.col("moving_average").alias("value")), "signal")
    return rounded(evaluate.evaluate_methods(signal, LOOSE_ALL).drop("rank"))


def g_histogram(spark, sf):
    return rounded(plots.histogram(features.time_features(_windows(spark, sf)), "td_std"))


_NAMES = (
    "s_series s_recordings s_filtered s_events p_clean p_shift f_moving_average f_savitzky_golay f_median f_butterworth n_noise_reduction n_experiment n_filter_evaluation n_drift d_threshold d_derivative d_derivative_regions d_change_point d_peaks "
    "d_simple_impacts d_study r_islands r_persistent m_match_groups m_support_zones m_events m_overlap e_evidence b_refine j_events j_summary a_shape a_trapezoid a_entropy a_post_level t_time_domain "
    "q_sampling_frequency q_spectrum q_dft q_spectral_features z_stft z_multidomain z_summary v_report v_per_channel v_channel_consistency v_rejections l_methods g_histogram"
)


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()}

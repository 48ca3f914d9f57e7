"""Features of events in the time, frequency and time-frequency domains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.config import SERIES, Spectral
from undula.lineage import cut
from undula.operators.detectors import derivative
from undula.operators.matching import samples_of
from undula.operators.noise import rms

#: Exported columns; fixed values, as are the texts of all reasons.
SHAPE_COLUMNS = (
    "dataset", "fbg", "impact_id", "start_time", "peak_time", "end_time", "pre_impact_baseline", "peak_value", "peak_shift", "absolute_peak_shift", "post_impact_level",
    "residual_shift", "rise_time", "recovery_time", "peak_width", "max_slope", "rms", "signal_energy", "peak_to_peak", "variance", "standard_deviation", "entropy",
    "area_under_curve", "residual_n_samples", "residual_reason",
)
KEY = [*SERIES, "event_id"]


def event_samples(events: DataFrame, signal: DataFrame) -> DataFrame:
    """Each event's samples with pos, their place in it from 0, and n, their number."""
    made = samples_of(events.select(*KEY, "start_index", "end_index"), signal)
    return made.select(*KEY, (F.col("sample_index") - F.col("start_index")).alias("pos"), (F.col("end_index") - F.col("start_index") + 1).alias("n"), "time", "value")


def trapezoid(windows: DataFrame) -> DataFrame:
    """Per event: signal_energy and area_under_curve by the trapezoid rule."""
    w = Window.partitionBy(*KEY).orderBy("pos")
    x, t = F.col("value"), F.col("time")
    step, before = t - F.lag("time").over(w), F.lag("value").over(w)
    made = windows.withColumn("e", step * (x * x + before * before) / 2).withColumn("a", step * (F.abs(x) + F.abs(before)) / 2)
    return made.groupBy(*KEY).agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("signal_energy"), F.coalesce(F.sum("a"), F.lit(0.0)).alias("area_under_curve"))


def density_entropy(windows: DataFrame, bins: int = 20) -> DataFrame:
    """Per event: minus the sum of d log2 d over the densities d of a histogram between its extremes."""
    w = Window.partitionBy(*KEY)
    low, high = F.min("value").over(w), F.max("value").over(w)
    flat = low == high
    made = windows.select(*KEY, "value", F.when(flat, low - 0.5).otherwise(low).alias("low"), F.when(flat, high + 0.5).otherwise(high).alias("high"), F.count("*").over(w).alias("total"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.least(F.floor((F.col("value") - F.col("low")) / width), F.lit(bins - 1))
    counts = made.withColumn("width", width).groupBy(*KEY, place.alias("bin")).agg(F.count("*").alias("c"), F.first("total").alias("total"), F.first("width").alias("width"))
    d = F.col("c") / (F.col("total") * F.col("width"))
    return counts.groupBy(*KEY).agg((-F.sum(d * F.log2(d))).alias("entropy"))


def post_level(events: DataFrame, signal: DataFrame, gap: int = 5, window: int = 50, least: int = 5) -> DataFrame:
    """Per event: the median behind it, without samples of other events of its dataset, their number, and why there is none."""
    last = signal.groupBy(*SERIES).agg((F.max("sample_index") + 1).alias("length"))
    spans = events.select(*KEY, "start_index", "end_index").join(last, SERIES)
    spans = spans.withColumn("low", F.col("end_index") + gap).withColumn("high", F.least(F.col("end_index") + gap + window, F.col("length")) - 1)
    near = samples_of(spans.filter("low <= high").select(*KEY, "low", "high"), signal, "low", "high").select(*KEY, "sample_index", "value")
    others = events.select("dataset", F.col("event_id").alias("other"), "start_index", "end_index")
    # How many events hold a sample, from one step up at each start and one down behind each end; the event's own is no part of its window.
    steps = others.select("dataset", F.col("start_index").alias("at"), F.lit(1).alias("step")).unionByName(others.select("dataset", (F.col("end_index") + 1).alias("at"), F.lit(-1).alias("step")))
    steps = steps.groupBy("dataset", "at").agg(F.sum("step").alias("step")).select("dataset", "at", F.lit(0).alias("kind"), "step")
    asked = near.select("dataset", F.col("sample_index").alias("at")).distinct().select("dataset", "at", F.lit(1).alias("kind"), F.lit(0).alias("step"))
    line = Window.partitionBy("dataset").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    free = steps.unionByName(asked).withColumn("held", F.sum("step").over(line)).filter("kind = 1 AND held = 0").select("dataset", F.col("at").alias("sample_index"))
    level = near.join(free, ["dataset", "sample_index"]).groupBy(*KEY).agg(F.percentile("value", F.lit(0.5)).alias("level"), F.count("*").alias("k"))
    made = spans.join(level, KEY, "left").withColumn("k", F.coalesce("k", F.lit(0)))
    past = F.col("low") >= F.col("length")
    enough = F.col("k") >= least
    why = F.when(past, F.lit("insufficient_post_impact_samples(start_past_end)")).when(~enough, F.format_string(f"insufficient_post_impact_samples(%d<{least})", "k")).otherwise("")
    return made.select(*KEY, F.when(enough, F.col("level")).alias("post_impact_level"), F.col("k").alias("residual_n_samples"), why.alias("residual_reason"))


def shape_features(events: DataFrame, signal: DataFrame) -> DataFrame:
    """The 25 features of accepted events' windows. `events` are those accepted."""
    windows = cut(event_samples(events, signal), "event-samples")
    slopes = derivative(windows.withColumnRenamed("pos", "sample_index").filter("n > 1"), keys=KEY).groupBy(*KEY).agg(F.max(F.abs("derivative")).alias("max_slope"))
    sums = windows.groupBy(*KEY).agg(
        rms(F.col("value")).alias("rms"), (F.max("value") - F.min("value")).alias("peak_to_peak"), F.var_pop("value").alias("variance"), F.stddev_pop("value").alias("standard_deviation")
    )
    made = events.join(sums, KEY).join(trapezoid(windows), KEY).join(density_entropy(windows), KEY).join(slopes, KEY, "left").join(post_level(events, signal), KEY)
    shift = F.col("peak_value") - F.col("baseline_mean")
    return made.select(
        "dataset", F.col("channel").alias("fbg"), F.col("event_id").alias("impact_id"), "start_time", "peak_time", "end_time", F.col("baseline_mean").alias("pre_impact_baseline"), "peak_value",
        shift.alias("peak_shift"), F.abs(shift).alias("absolute_peak_shift"), "post_impact_level", (F.col("post_impact_level") - F.col("baseline_mean")).alias("residual_shift"),
        (F.col("peak_time") - F.col("start_time")).alias("rise_time"), (F.col("end_time") - F.col("peak_time")).alias("recovery_time"), (F.col("end_time") - F.col("start_time")).alias("peak_width"),
        "max_slope", "rms", "signal_energy", "peak_to_peak", "variance", "standard_deviation", "entropy", "area_under_curve", "residual_n_samples", "residual_reason",
    )


def time_features(windows: DataFrame, least: float = 1e-15) -> DataFrame:
    """Per event: moments and extremes; those that a short or flat window can't have are null, and td_reason says why all are."""
    x = F.col("value")
    n, s = F.count(x), F.stddev_pop(x)
    root = rms(x)
    made = windows.groupBy(*KEY).agg(
        F.count("*").alias("td_samples"),
        F.avg(x).alias("td_mean"),
        F.percentile(x, F.lit(0.5)).alias("td_median"),
        s.alias("td_std"),
        F.var_pop(x).alias("td_variance"),
        root.alias("td_rms"),
        F.min(x).alias("td_minimum"),
        F.max(x).alias("td_maximum"),
        (F.max(x) - F.min(x)).alias("td_peak_to_peak"),
        F.when((n >= 3) & (s >= least), F.skewness(x)).alias("td_skewness"),
        F.when((n >= 4) & (s >= least), F.kurtosis(x)).alias("td_kurtosis"),
        F.when(root >= least, F.max(F.abs(x)) / root).alias("td_crest_factor"),
        n.alias("known"),
    )
    why = F.when(F.col("td_samples") == 1, "single_sample_event").when(F.col("known") == 0, "all_nan_signal").otherwise("")
    names = [c for c in made.columns if c.startswith("td_") and c != "td_samples"]
    return made.withColumn("td_reason", why).select(*KEY, "td_samples", *[F.when(F.col("td_reason") == "", F.col(c)).alias(c) for c in names], "td_reason")


def sampling_frequency(signal: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Per series: one over the median positive step of time; null and a reason where there is none."""
    w = Window.partitionBy(*keys).orderBy("sample_index")
    steps = signal.select(*keys, (F.col("time") - F.lag("time").over(w)).alias("dt"))
    made = steps.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(F.when(F.col("dt") > 0, F.col("dt")), F.lit(0.5)).alias("dt"))
    why = F.when(F.col("n") < 2, "insufficient_timestamps(len<2)").when(F.col("dt").isNull(), "no_positive_time_differences").otherwise("")
    return made.select(*keys, (1 / F.col("dt")).alias("fs"), why.alias("fs_reason"))


def window_weight(name: str, pos: Column, n: Column) -> Column:
    """Symmetric window weights in closed form; an unknown name is hann, and a window of one sample is 1."""
    turn = 2 * np.pi * pos / F.when(n > 1, n - 1)
    w = {
        "none": F.lit(1.0),
        "hamming": 0.54 - 0.46 * F.cos(turn),
        "blackman": 0.42 - 0.5 * F.cos(turn) + 0.08 * F.cos(2 * turn),
    }.get(name, 0.5 - 0.5 * F.cos(turn))
    return F.when(n <= 2, 1.0).otherwise(w) if name not in ("none", "hamming") else F.coalesce(w, F.lit(1.0))


def filled(windows: DataFrame) -> DataFrame:
    """Adds value_reason, and value without gaps: nulls and values that aren't finite are filled linearly by position, beyond the first and last
    known value with that; a window with none or one known value isn't filled, and has a reason if anything is missing."""
    w = Window.partitionBy(*KEY)
    x = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    known = F.when(x.isNotNull(), F.struct(F.col("pos").alias("i"), x.alias("v")))
    made = windows.withColumns(
        {
            "_l": F.last(known, ignorenulls=True).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)),
            "_r": F.last(known, ignorenulls=True).over(w.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)),
            "_k": F.count(x).over(w),
            "_n": F.count("*").over(w),
        }
    )
    between = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * (F.col("pos") - F.col("_l.i")) / (F.col("_r.i") - F.col("_l.i"))
    value = F.when(x.isNotNull(), x).when(F.col("_l").isNull(), F.col("_r.v")).when(F.col("_r").isNull(), F.col("_l.v")).otherwise(between)
    why = F.when(F.col("_k") == 0, "all_nan_signal").when((F.col("_k") < 2) & (F.col("_k") < F.col("_n")), "insufficient_finite_samples").otherwise("")
    return made.withColumn("value_reason", why).withColumn("value", F.when(F.col("value_reason") == "", value)).drop("_l", "_r", "_k", "_n")


def _weighted(windows: DataFrame, config: Spectral) -> DataFrame:
    """v: the samples of windows that can be transformed, mean-free and weighted."""
    w = Window.partitionBy(*KEY)
    ready = filled(windows).filter("value_reason = ''")
    x = F.col("value") - F.avg("value").over(w) if config.remove_dc else F.col("value")
    return ready.withColumn("v", x * window_weight(config.window, F.col("pos"), F.col("n")))


def spectra(windows: DataFrame, config: Spectral = Spectral()) -> DataFrame:
    """k, mag of each event's one-sided spectrum, of the mean-free, windowed samples, from one FFT per event."""
    ready = _weighted(windows, config)
    arrays = ready.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("x")).filter(F.size("x") >= config.min_fft_samples)

    def run(batches):
        for b in batches:
            mags = [np.abs(np.fft.rfft(np.array(x, dtype=float))) for x in b.column(3).to_pylist()]
            counts = [len(m) for m in mags]
            take = pa.array(np.repeat(np.arange(b.num_rows), counts))
            flat = np.concatenate(mags) if mags else np.zeros(0)
            k = np.concatenate([np.arange(c) for c in counts]) if mags else np.zeros(0, dtype=np.int64)
            n = np.repeat([len(x) for x in b.column(3).to_pylist()], counts)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array(k, pa.int64()), pa.array(flat, pa.float64()), pa.array(n, pa.int64())], [*KEY, "k", "mag", "n"])

    return arrays.select(*KEY, "x").mapInArrow(run, "dataset string, channel string, event_id string, k long, mag double, n long")


def dft_spectra(windows: DataFrame, config: Spectral = Spectral()) -> DataFrame:
    """The same without Python, as sums of cosines and sines; for short windows."""
    ready = _weighted(windows.filter(F.col("n") >= config.min_fft_samples), config)
    each = ready.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 2))))
    angle = 2 * np.pi * ((F.col("k") * F.col("pos")) % F.col("n")) / F.col("n")
    made = each.groupBy(*KEY, "k", "n").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    return made.select(*KEY, "k", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("mag"), "n")


def spectral_features(spectrum: DataFrame, fs: DataFrame, config: Spectral = Spectral(), least: float = 1e-30) -> DataFrame:
    """Per event: dominant frequency, energy, entropy, centroid, bandwidth, flatness, rolloff. One pass over bins with
    window sums, one aggregate."""
    f = F.col("k") * F.col("fs") / F.col("n")
    power = F.col("mag") * F.col("mag")
    w = Window.partitionBy(*KEY)
    bins = spectrum.join(fs.select(*SERIES, "fs"), SERIES).withColumn("f", f).withColumn("p", power)
    bins = bins.withColumn("total", F.sum("p").over(w)).withColumn("cum", F.sum("p").over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    bins = bins.withColumn("centroid", F.when(F.col("total") >= least, F.sum(F.col("f") * F.col("p")).over(w) / F.col("total")))
    share = F.when((F.col("p") > 0) & (F.col("total") >= least), F.col("p") / F.col("total"))
    known = F.max("total") >= least
    log_mean = F.avg(F.when(F.col("p") > 0, F.ln("p")))
    return bins.groupBy(*KEY).agg(
        F.first("fs").alias("sampling_frequency_hz"),
        F.min_by("f", F.when(F.col("k") >= 1, F.struct(-F.col("mag"), F.col("k")))).alias("dominant_frequency_hz"),
        F.min_by("mag", F.when(F.col("k") >= 1, F.struct(-F.col("mag"), F.col("k")))).alias("dominant_magnitude"),
        F.first("n").alias("num_samples"),
        F.max("total").alias("spectral_energy"),
        F.when(known, -F.sum(share * F.log2(share))).alias("spectral_entropy"),
        F.first("centroid").alias("spectral_centroid_hz"),
        F.sqrt(F.sum((F.col("f") - F.col("centroid")) ** 2 * F.col("p")) / F.when(known, F.max("total"))).alias("spectral_bandwidth_hz"),
        F.when(known, F.exp(log_mean) / F.avg("p")).alias("spectral_flatness"),
        F.when(known, F.coalesce(F.min(F.when(F.col("cum") >= config.rolloff * F.col("total"), F.col("f"))), F.max("f"))).alias("spectral_rolloff_hz"),
    )


def stft_of(x: np.ndarray, fs: float, overlap: float = 0.5) -> tuple[float, float]:
    """The frequency of the greatest magnitude over all frames, and the energy of its frame. Periodic hann, zeros around."""
    n = len(x)
    seg = min(n, max(32, n // 4))
    hop = seg - min(int(seg * overlap), seg - 1)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(seg) / seg)
    wide = np.concatenate((np.zeros(seg // 2), x, np.zeros(seg // 2)))
    wide = np.concatenate((wide, np.zeros(-(len(wide) - seg) % hop)))
    frames = np.lib.stride_tricks.sliding_window_view(wide, seg)[::hop]
    mags = np.abs(np.fft.rfft(frames * w, axis=1)).T / w.sum()
    k, frame = np.unravel_index(int(np.argmax(mags)), mags.shape)
    return float(k * fs / seg), float((mags[:, frame] ** 2).sum())


def stft_features(windows: DataFrame, fs: DataFrame, config: Spectral = Spectral()) -> DataFrame:
    """Per event: stft_peak_frequency_hz, stft_max_energy, stft_valid, stft_reason."""
    arrays = filled(windows).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("x"), F.max("value_reason").alias("why"))
    arrays = arrays.join(fs.select(*SERIES, "fs"), SERIES).select(*KEY, "x", "fs", "why")

    def run(batches):
        for b in batches:
            out = []
            for x, rate, why in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                if not config.stft:
                    out.append((None, None, False, "stft_disabled"))
                elif why:
                    out.append((None, None, False, why))
                elif len(x) < config.min_stft_samples:
                    out.append((None, None, False, f"event_too_short({len(x)}<{config.min_stft_samples})"))
                elif rate is None or not np.isfinite(rate) or rate <= 0:
                    out.append((None, None, False, "invalid_sampling_frequency"))
                else:
                    out.append((*stft_of(np.array(x, dtype=float), rate, config.stft_overlap), True, ""))
            types = [pa.float64(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))], [*KEY, "stft_peak_frequency_hz", "stft_max_energy", "stft_valid", "stft_reason"])

    return arrays.mapInArrow(run, "dataset string, channel string, event_id string, stft_peak_frequency_hz double, stft_max_energy double, stft_valid boolean, stft_reason string")


#: Shape features that the other domains' table repeats, and its columns. Fixed values.
SHARED = ("peak_shift", "residual_shift", "rise_time", "recovery_time")
FEATURE_COLUMNS = (
    "dataset", "fbg", "impact_id", "start_time", "peak_time", "end_time", "duration", "peak_shift", "residual_shift", "rise_time", "recovery_time", "mean", "median", "std", "variance", "rms", "minimum",
    "maximum", "peak_to_peak", "skewness", "kurtosis", "crest_factor", "sampling_frequency_hz", "num_samples", "dominant_frequency_hz", "dominant_magnitude", "spectral_energy", "spectral_entropy",
    "spectral_centroid_hz", "spectral_bandwidth_hz", "spectral_flatness", "spectral_rolloff_hz", "stft_peak_frequency_hz", "stft_max_energy", "stft_valid", "feature_status", "failure_reason",
)


def multidomain_features(events: DataFrame, signal: DataFrame, shape: DataFrame, config: Spectral = Spectral()) -> DataFrame:
    """All domains of accepted events in one row, with status and failure_reason."""
    windows = cut(event_samples(events, signal), "event-samples")
    fs = sampling_frequency(signal)
    spectrum = spectral_features(spectra(windows, config), fs, config)
    lookup = shape.select(F.col("dataset"), F.col("impact_id").alias("event_id"), *SHARED)
    made = events.select(*KEY, "start_time", "peak_time", "end_time", "peak_value", "duration", "baseline_mean").join(lookup, ["dataset", "event_id"], "left").join(time_features(windows), KEY)
    made = made.join(spectrum.drop("sampling_frequency_hz"), KEY, "left").join(stft_features(windows, fs, config), KEY).join(fs, SERIES).withColumn("sampling_frequency_hz", F.col("fs"))
    short = F.col("td_samples") < config.min_fft_samples
    gaps = filled(windows).groupBy(*KEY).agg(F.max("value_reason").alias("value_reason"))
    made = made.join(gaps, KEY)
    fd = F.when(F.col("fs").isNull(), "invalid_sampling_frequency").when(F.col("value_reason") != "", F.col("value_reason")).when(short, F.format_string(f"insufficient_samples(%d<{config.min_fft_samples})", "td_samples")).otherwise("")
    made = made.withColumn("fd_reason", fd)
    bad_stft = (F.col("stft_reason") != "") & (F.col("stft_reason") != "stft_disabled")
    why = F.concat_ws("; ", *[F.when(c, F.concat(F.lit(f"{n}:"), F.col(r))) for c, n, r in ((F.col("td_reason") != "", "time_domain", "td_reason"), (fd != "", "frequency_domain", "fd_reason"), (bad_stft, "stft", "stft_reason"))])
    status = F.when(F.col("fs").isNull(), "failed").when(why != "", "partial").otherwise("ok")
    made = made.withColumn("failure_reason", F.when(F.col("fs").isNull(), F.concat(F.lit("sampling_freq:"), F.col("fs_reason"))).otherwise(why)).withColumn("feature_status", status)
    made = made.withColumnsRenamed({f"td_{c}": c for c in FEATURE_COLUMNS if f"td_{c}" in made.columns} | {"channel": "fbg", "event_id": "impact_id"})
    return made.withColumn("num_samples", F.coalesce("num_samples", F.lit(0))).select(*FEATURE_COLUMNS)


def feature_summary(features: DataFrame) -> DataFrame:
    """One row: events by status, valid STFTs, and means, medians and deviations over finite values."""

    def finite(c: str) -> Column:
        return F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))

    dominant, energy, entropy = finite("dominant_frequency_hz"), finite("spectral_energy"), finite("spectral_entropy")
    return features.agg(
        F.count("*").alias("events"),
        *[F.count_if(F.col("feature_status") == s).alias(f"{s}_events") for s in ("ok", "partial", "failed")],
        F.count_if("stft_valid").alias("valid_stft"),
        F.avg(dominant).alias("dominant_frequency_mean"),
        F.percentile(dominant, F.lit(0.5)).alias("dominant_frequency_median"),
        F.stddev_pop(dominant).alias("dominant_frequency_std"),
        F.avg(energy).alias("spectral_energy_mean"),
        F.percentile(energy, F.lit(0.5)).alias("spectral_energy_median"),
        F.avg(entropy).alias("spectral_entropy_mean"),
        F.percentile(entropy, F.lit(0.5)).alias("spectral_entropy_median"),
    )

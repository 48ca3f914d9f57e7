"""Four detectors. Each gives regions (dataset, channel, method, region_idx, start_index, end_index) from filtered series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.config import METHODS, SERIES, Detectors
from undula.operators.blocks import SAMPLES, frame, ordered, own_rows, with_halo
from undula.operators.islands import clean_regions, merge_nearby
from undula.operators.noise import first_peak


def baseline_statistics(df: DataFrame, n: int, value: str = "value") -> DataFrame:
    """Mean and population deviation of each series' first n samples."""
    return df.filter(F.col("sample_index") < n).groupBy(*SERIES).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma"))


def threshold_mask(df: DataFrame, n: int = 100, k: float = 4.0) -> DataFrame:
    """mask: further than k deviations of the baseline from its mean. `threshold` is that distance."""
    made = df.join(baseline_statistics(df, n), SERIES).withColumn("threshold", k * F.col("sigma"))
    return made.withColumn("mask", F.abs(F.col("value") - F.col("mu")) > F.col("threshold"))


def _quotient(a: Column, b: Column) -> Column:
    """a / b as floating point has it, where b isn't negative: over zero infinite with a's sign, and NaN for zero."""
    return F.when(b == 0, a * float("inf")).otherwise(F.try_divide(a, b))


def derivative(df: DataFrame, value: str = "value", keys: list[str] = SERIES, size: int = SAMPLES) -> DataFrame:
    """derivative: second-order differences over uneven time, first-order at the ends. Samples of equal time have the infinite slope of their
    step, or NaN without one; time must not fall."""
    w = ordered(keys)
    halo = with_halo(df, 1, 1, size, keys)
    x, t = F.col(value), F.col("time")
    xl, xr, tl, tr = F.lag(value).over(w), F.lead(value).over(w), F.lag("time").over(w), F.lead("time").over(w)
    halo = halo.withColumns({"xl": xl, "xr": xr, "hs": t - tl, "hd": tr - t})
    bad = (F.col("hs") < 0) | (F.col("hd") < 0)
    hs, hd = F.col("hs"), F.col("hd")
    inner = _quotient(hs * hs * F.col("xr") + (hd * hd - hs * hs) * x - hd * hd * F.col("xl"), hs * hd * (hs + hd))
    slope = F.when(bad, F.raise_error(F.lit("time must not fall")).cast("double")).when(hs.isNull(), _quotient(F.col("xr") - x, hd)).when(hd.isNull(), _quotient(x - F.col("xl"), hs)).otherwise(inner)
    return own_rows(halo.withColumn("derivative", slope).drop("xl", "xr", "hs", "hd"))


def derivative_mask(df: DataFrame, n: int = 100, k: float = 3.0) -> DataFrame:
    """mask: the derivative is further than k of its baseline deviations from its baseline mean."""
    made = derivative(df)
    made = made.join(baseline_statistics(made, n, "derivative"), SERIES)
    return made.withColumn("mask", F.abs(F.col("derivative") - F.col("mu")) > k * F.col("sigma"))


def derivative_summary(masked: DataFrame) -> DataFrame:
    """Per series: the first greatest absolute derivative, its place, the greatest deviation, the number of hits."""
    peak = first_peak(F.col("sample_index"), F.col("derivative"), F.col("time").alias("time"))
    made = masked.groupBy(*SERIES).agg(peak.alias("p"), F.max(F.abs(F.col("derivative") - F.col("mu"))).alias("max_deviation"), F.count_if("mask").alias("detected_samples"))
    return made.select(*SERIES, F.abs("p.value").alias("max_derivative"), F.col("p.index").alias("max_index"), F.col("p.time").alias("max_time"), "max_deviation", "detected_samples")


def change_point_mask(df: DataFrame, window: int = 20, threshold: float = 3.0) -> DataFrame:
    """mask: further than `threshold` deviations of the `window` samples before from their mean. Flat windows have none."""
    f = frame(-window, -1)
    halo = with_halo(df, window, 0)
    halo = halo.withColumns({"m": F.avg("value").over(f), "s": F.stddev_pop("value").over(f), "c": F.count("value").over(f), "flat": F.max("value").over(f) == F.min("value").over(f)})
    z = F.when((F.col("c") == window) & ~F.col("flat") & (F.col("s") > 0), F.abs(F.col("value") - F.col("m")) / F.col("s"))
    return own_rows(halo.withColumn("z", z).withColumn("mask", F.coalesce(z > threshold, F.lit(False))).drop("m", "s", "c", "flat"))


def _local_maxima(x: np.ndarray) -> np.ndarray:
    """Middles (rounded down) of plateaus that are higher than both neighbours; ends don't count."""
    if len(x) < 3:
        return np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    ends = np.concatenate((starts[1:] - 1, [len(x) - 1]))
    level = x[starts]
    top = np.zeros(len(starts), dtype=bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (starts[top] + ends[top]) // 2


def _spaced(peaks: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Without peaks closer than `distance` to a higher one that stays; the later of equal ones stays."""
    keep = np.ones(len(peaks), dtype=bool)
    for j in np.argsort(height, kind="stable")[::-1]:
        if keep[j]:
            low, high = np.searchsorted(peaks, [peaks[j] - distance + 1, peaks[j] + distance])
            keep[low:high] = False
            keep[j] = True
    return peaks[keep]


def _prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height over the higher of the two lowest points before a higher sample, or the end, on either side."""

    def lowest(y: np.ndarray) -> np.ndarray:
        # A stack of samples that no later one exceeds; each carries the least value since the one below it.
        out = np.empty(len(y))
        stack: list[tuple[float, float]] = []
        for i, v in enumerate(y.tolist()):
            least = v
            while stack and stack[-1][0] <= v:
                least = min(least, stack.pop()[1])
            out[i] = least
            stack.append((v, least))
        return out

    left, right = lowest(x), lowest(x[::-1])[::-1]
    return x[peaks] - np.maximum(left[peaks], right[peaks])


def peaks(df: DataFrame, n: int = 100, k: float = 3.0, distance: int = 5) -> DataFrame:
    """sample_index, type, prominence of peaks of either sign at least k baseline deviations prominent.

    Suppression by distance goes from the highest peak down and a prominence may reach over a whole series, so a series is one group here.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("sample_index")
        x, index, time = t.column("value").to_numpy().astype(float), t.column("sample_index").to_numpy(), t.column("time").to_numpy()
        low = k * float(np.std(x[:n]))
        found = []
        for sign, name in ((1.0, "positive"), (-1.0, "negative")):
            y = sign * (x - x[:n].mean())
            at = _local_maxima(y)
            at = _spaced(at, y[at], distance)
            if not len(at):
                continue
            p = _prominences(y, at)
            found += [(int(i), name, float(q)) for i, q in zip(at, p, strict=True) if q >= low]
        found.sort(key=lambda f: f[0])
        at = [f[0] for f in found]
        m = len(found)
        return pa.table(
            {
                "dataset": pa.array([t.column("dataset")[0].as_py()] * m, pa.string()),
                "channel": pa.array([t.column("channel")[0].as_py()] * m, pa.string()),
                "sample_index": pa.array(index[at], pa.int64()),
                "time": pa.array(time[at], pa.float64()),
                "value": pa.array(x[at], pa.float64()),
                "type": pa.array([f[1] for f in found], pa.string()),
                "prominence": pa.array([f[2] for f in found], pa.float64()),
            }
        )

    schema = "dataset string, channel string, sample_index long, time double, value double, type string, prominence double"
    return df.select(*SERIES, "sample_index", "time", "value").groupBy(*SERIES).applyInArrow(run, schema)


def peak_regions(df: DataFrame, p: Detectors = Detectors()) -> DataFrame:
    """A box around each peak, clipped to the series; boxes that touch are one; short ones go, near ones merge."""
    last = df.groupBy(*SERIES).agg(F.max("sample_index").alias("last"))
    found = peaks(df, p.baseline_samples, p.prominence_multiplier, p.peak_distance).join(last, SERIES)
    boxes = found.select(*SERIES, F.greatest(F.col("sample_index") - p.peak_before, F.lit(0)).alias("start_index"), F.least(F.col("sample_index") + p.peak_after, F.col("last")).alias("end_index"))
    whole = merge_nearby(boxes, 0)
    return merge_nearby(whole.filter(F.col("end_index") - F.col("start_index") + 1 >= p.min_samples), p.peak_gap)


def method_regions(df: DataFrame, method: str, p: Detectors = Detectors()) -> DataFrame:
    if method == "peak":
        made = peak_regions(df, p)
    elif method == "threshold":
        made = clean_regions(threshold_mask(df, p.baseline_samples, p.threshold_multiplier), p.min_samples, p.threshold_gap)
    elif method == "derivative":
        # Runs shorter than the persistence are shorter than the least region too, or they go here.
        least = max(p.min_samples, p.derivative_persistence)
        made = clean_regions(derivative_mask(df, p.baseline_samples, p.derivative_multiplier), least, p.derivative_gap)
    elif method == "change_point":
        made = clean_regions(change_point_mask(df, p.change_point_window, p.change_point_threshold), p.min_samples, p.change_point_gap)
    else:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
    index = (F.row_number().over(Window.partitionBy(*SERIES).orderBy("start_index")) - 1).cast("long")
    return made.select(*SERIES, F.lit(method).alias("method"), index.alias("region_idx"), "start_index", "end_index")


def run_detectors(df: DataFrame, methods: tuple[str, ...] = METHODS, p: Detectors = Detectors()) -> DataFrame:
    """The regions of several detectors, with method_rank, their order."""
    out = None
    for rank, m in enumerate(methods):
        one = method_regions(df, m, p).withColumn("method_rank", F.lit(rank))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no methods")
    return out

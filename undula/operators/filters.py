"""Low-pass filters of series: three as row-frame windows, the zero-phase recursive one as a grouped Arrow function."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.config import FILTERS, SERIES, Filters
from undula.operators.blocks import frame, ordered, own_rows, with_halo


def _moving_average(halo: DataFrame, window: int, value: str, out: str) -> DataFrame:
    half = window // 2
    f = frame(-half, window - 1 - half)
    made = halo.withColumn(out, F.when(F.count(value).over(f) == window, F.avg(value).over(f)))
    return made.withColumn(out, F.coalesce(F.col(out), F.first(out, ignorenulls=True).over(frame(0, half)), F.last(out, ignorenulls=True).over(frame(-half, 0))))


def moving_average(df: DataFrame, window: int = 5, value: str = "value", out: str = "moving_average") -> DataFrame:
    """Centred mean of full windows; the rows without one take the nearest that has."""
    return own_rows(_moving_average(with_halo(df, window, window), window, value, out))


def savgol_rows(window: int = 11, order: int = 3) -> np.ndarray:
    """Row j: weights of the window's samples for the value at its place j of the polynomial fitted to them."""
    at = np.arange(window) - window // 2
    a = np.vander(at, order + 1, increasing=True).astype(float)
    return a @ np.linalg.pinv(a)


def _savitzky_golay(halo: DataFrame, window: int, order: int, value: str, out: str) -> DataFrame:
    half, rows = window // 2, savgol_rows(window, order)
    w = ordered()
    halo = halo.withColumn("ahead", F.count("*").over(frame(-(window - 1), -1))).withColumn("behind", F.count("*").over(frame(1, window - 1)))

    def at(k: int) -> Column:
        return F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w) if k else F.col(value)

    cols = {f"_{k + window}": at(k) for k in range(-(window - 1), window)}
    halo = halo.withColumns(cols)

    def fit(place: int) -> Column:
        """The value at `place` of the window that starts `place` samples ahead."""
        return sum((F.col(f"_{k - place + window}") * float(rows[place][k]) for k in range(1, window)), F.col(f"_{window - place}") * float(rows[place][0]))

    whole = F.col("ahead") + F.col("behind") + 1 >= window
    result = F.when(~whole, None)
    for j in range(half):
        result = result.when(F.col("ahead") == j, fit(j)).when(F.col("behind") == j, fit(window - 1 - j))
    return halo.withColumn(out, result.otherwise(fit(half))).drop("ahead", "behind", *cols)


def savitzky_golay(df: DataFrame, window: int = 11, order: int = 3, value: str = "value", out: str = "savitzky_golay") -> DataFrame:
    """The fitted polynomial's value at each sample; near the ends, that of the first or last window. Null in shorter series."""
    return own_rows(_savitzky_golay(with_halo(df, window, window), window, order, value, out))


def _median(halo: DataFrame, window: int, value: str, out: str) -> DataFrame:
    half, w = window // 2, ordered()
    zero = F.lit(0.0)
    around = [F.lag(value, k, 0.0).over(w) for k in range(1, half + 1)] + [F.lead(value, k, 0.0).over(w) for k in range(1, half + 1)]
    return halo.withColumn(out, F.array_sort(F.array(*[F.coalesce(x, zero) for x in around], F.col(value)))[half])


def median(df: DataFrame, window: int = 5, value: str = "value", out: str = "median") -> DataFrame:
    """The middle of each centred window, with zeros beyond the ends."""
    return own_rows(_median(with_halo(df, window, window), window, value, out))


def butterworth_coefficients(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the digital low-pass; cutoff as a share of half the sampling frequency."""
    warped = 2 * np.tan(np.pi * cutoff / 2)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    digital = (2 + poles) / (2 - poles)
    a = np.real(np.poly(digital))
    b = np.poly(-np.ones(order)) * np.real(np.prod(1 - digital)) / 2**order
    return b, a


def impulse_response(b: np.ndarray, a: np.ndarray, least: float = 1e-18) -> np.ndarray:
    """What the filter gives for a one and zeros, until nothing of it is left in double precision."""
    out, state = [], np.zeros(len(a) - 1)
    x, quiet = 1.0, 0
    while quiet < len(a):
        y = b[0] * x + state[0]
        state = np.append(state[1:], 0.0) + b[1:] * x - a[1:] * y
        out.append(float(y))
        x, quiet = 0.0, quiet + 1 if max(abs(y), np.abs(state).max()) < least else 0
    return np.array(out)


def _pass(x: np.ndarray, response: np.ndarray) -> np.ndarray:
    """The filter's output if the first value had always been there before; it lets constants through as they are."""
    return x[0] + np.convolve(x - x[0], response)[: len(x)]


def zero_phase(x: np.ndarray, b: np.ndarray, a: np.ndarray, response: np.ndarray | None = None) -> np.ndarray:
    """Forward and backward, over an odd extension of three times the filter's length."""
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        raise ValueError(f"a series must have over {pad} samples")
    response = impulse_response(b, a) if response is None else response
    wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    return _pass(_pass(wide, response)[::-1], response)[::-1][pad:-pad]


def butterworth(df: DataFrame, cutoff: float = 5.0, frequency: float = 50.0, order: int = 4, value: str = "value", out: str = "butterworth", halo: int = 1024) -> DataFrame:
    """Zero-phase low-pass. A block's halo is long enough for what lies beyond it to fade out below the last digit."""
    if not 0 < cutoff < frequency / 2:
        raise ValueError("the cutoff must lie below half the sampling frequency")
    b, a = butterworth_coefficients(order, cutoff / (frequency / 2))
    response = impulse_response(b, a)
    narrow = with_halo(df.select(*SERIES, "sample_index", value), halo, halo)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("sample_index")
        x = t.column(value).to_numpy().astype(float)
        y = zero_phase(x, b, a, response) if len(x) > 3 * len(a) else [None] * len(x)  # too short to be filtered
        t = t.select([*SERIES, "sample_index", "own"]).append_column(out, pa.array(y, pa.float64()))
        return t.filter(t.column("own")).drop_columns(["own"])

    made = narrow.groupBy(*SERIES, "block").applyInArrow(run, f"dataset string, channel string, sample_index long, {out} double")
    return df.join(made, [*SERIES, "sample_index"])


def apply_filter(df: DataFrame, name: str, p: Filters = Filters(), frequency: float = 50.0) -> DataFrame:
    """One filter as a further column of its name."""
    if name == "moving_average":
        return moving_average(df, p.window)
    if name == "butterworth":
        return butterworth(df, p.cutoff, frequency, p.order)
    if name == "savitzky_golay":
        return savitzky_golay(df, p.savgol_window, p.savgol_order)
    if name == "median":
        return median(df, p.window)
    raise ValueError(f"unknown filter {name!r}; there are {', '.join(FILTERS)}")


def apply_all(df: DataFrame, p: Filters = Filters(), frequency: float = 50.0) -> DataFrame:
    """All four. The row-frame filters share one halo, so one partitioning and one sort."""
    reach = max(p.window, p.savgol_window)
    halo = _moving_average(with_halo(df, reach, reach), p.window, "value", "moving_average")
    halo = _median(_savitzky_golay(halo, p.savgol_window, p.savgol_order, "value", "savitzky_golay"), p.window, "value", "median")
    return butterworth(own_rows(halo), p.cutoff, frequency, p.order)


def prepared(df: DataFrame, name: str, n: int = 100, p: Filters = Filters()) -> DataFrame:
    """Cleaned, shifted and filtered series: value is the filtered shift."""
    from undula.operators.preprocess import preprocess

    made = apply_filter(preprocess(df, n).select(*SERIES, "sample_index", "time", "value"), name, p)
    return made.select(*SERIES, "sample_index", "time", F.col(name).alias("value"))

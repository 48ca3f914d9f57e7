"""The data behind plots, and the plots of a run: a few events of each dataset, histograms, a scatter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.config import SERIES
from undula.operators.filters import apply_all
from undula.operators.matching import samples_of
from undula.operators.preprocess import preprocess
from undula.plans import draw


def event_window(events: DataFrame, signal: DataFrame, before: int = 20, after: int = 80) -> DataFrame:
    """Each event's samples with `before` ahead and `after` behind, marked where they are inside the event."""
    wide = events.select(*SERIES, "event_id", F.col("start_index").alias("s"), F.col("end_index").alias("e"), (F.col("start_index") - before).alias("low"), (F.col("end_index") + after).alias("high"))
    return samples_of(wide, signal, "low", "high").select(*SERIES, "event_id", "sample_index", "time", "value", F.col("sample_index").between(F.col("s"), F.col("e")).alias("inside"))


def diagnostic(events: DataFrame, regions: DataFrame, signal: DataFrame) -> DataFrame:
    """Each event's samples with the detectors whose regions hold them."""
    held = samples_of(regions.select(*SERIES, "method", "start_index", "end_index"), signal).groupBy(*SERIES, "sample_index").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    return event_window(events, signal).join(held, [*SERIES, "sample_index"], "left")


def raw_shift_and_filters(samples: DataFrame, n: int = 100) -> DataFrame:
    """Time, cleaned value, shift and the four filters of every sample."""
    return apply_all(preprocess(samples, n))


def histogram(features: DataFrame, column: str) -> DataFrame:
    """bin, low, high, count with a third as many bins as rows, at least 5 and at most 30."""
    x = F.col(column)
    known = features.filter(x.isNotNull())
    limits = known.agg(F.min(x).alias("low"), F.max(x).alias("high"), F.least(F.greatest(F.floor(F.count(x) / 3), F.lit(5)), F.lit(30)).alias("bins")).withColumn("one", F.lit(1))
    width = (F.col("high") - F.col("low")) / F.col("bins")
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((x - F.col("low")) / width), F.col("bins") - 1)).otherwise(0)
    made = known.withColumn("one", F.lit(1)).join(F.broadcast(limits), "one").withColumn("bin", place.cast("long")).withColumn("width", width)
    return made.groupBy("bin").agg((F.first("low") + F.first("bin") * F.first("width")).alias("low"), (F.first("low") + (F.first("bin") + 1) * F.first("width")).alias("high"), F.count("*").alias("count"))


def scatter(features: DataFrame, x: str = "dominant_frequency_hz", y: str = "peak_shift") -> DataFrame:
    return features.select("dataset", "impact_id", F.col(x).alias("x"), F.abs(F.col(y)).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")


def first_events(events: DataFrame, per_dataset: int) -> DataFrame:
    """So many events of each dataset, the first in time."""
    w = Window.partitionBy("dataset").orderBy("start_index", "channel", "event_id")
    return events.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_dataset).drop("_k")


def event_plots(events: DataFrame, signal: DataFrame, regions: DataFrame | None = None, per_dataset: int = 3) -> dict[str, str]:
    """name: SVG, of at most per_dataset events of each dataset, with where detectors' regions lie if they are given."""
    chosen = first_events(events, per_dataset)
    rows = (event_window(chosen, signal) if regions is None else diagnostic(chosen, regions, signal)).orderBy("event_id", "sample_index").collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["event_id"], []).append(r)
    made = {}
    for name, own in out.items():
        series = {"signal": [r["value"] for r in own]}
        for m in sorted({m for r in own for m in (r["methods"] or [])} if regions is not None else ()):
            series[m] = [r["value"] if m in (r["methods"] or []) else None for r in own]
        made[f"event_{name}"] = draw.lines(name, [r["time"] for r in own], series, [r["inside"] for r in own])
    return made


def feature_plots(features: DataFrame) -> dict[str, str]:
    """Histograms of the dominant frequency and the spectral energy, and the greatest shift over the frequency."""
    made = {}
    for column in ("dominant_frequency_hz", "spectral_energy"):
        rows = histogram(features, column).orderBy("bin").collect()
        made[f"histogram_{column}"] = draw.bars(column, [r["low"] for r in rows], [r["high"] for r in rows], [r["count"] for r in rows], column)
    rows = scatter(features).limit(5000).collect()
    made["scatter"] = draw.points("peak shift over dominant frequency", [r["x"] for r in rows], [r["y"] for r in rows], "Hz", "shift")
    return made

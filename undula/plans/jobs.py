"""Runs from a folder of recordings to written results: python -m undula.plans.jobs NAME --data DIR --out DIR"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.config import FILTERS, METHODS, Parameters, Spectral
from undula.lineage import cut
from undula.operators import detectors, evaluate, events, features, filters, legacy, noise
from undula.operators.preprocess import preprocess
from undula.plans import plots, report
from undula.sources import readers, sinks


def _say(lines: list[str]) -> None:
    print("\n".join(lines))


def _samples(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame]:
    raw = readers.read_raw(spark, data)
    return readers.samples(raw), readers.failed_files(raw)


def noise_run(spark: SparkSession, data: str, out: str, csv: bool = True, **_) -> None:
    samples, failed = _samples(spark, data)
    filtered = cut(filters.apply_all(preprocess(samples)), "run")
    sinks.write_filtered(filtered.select("dataset", "channel", "sample_index", "time", "value", *FILTERS), f"{out}/filtered", f"{out}/filtered_csv" if csv else None)
    long = noise.long_filters(filtered)
    reduction = cut(noise.noise_reduction(long), "run")
    sinks.write_noise(reduction, noise.filter_evaluation(long), failed, out)
    _say(report.noise(reduction, failed))


def ensemble_run(spark: SparkSession, data: str, out: str, filter_name: str = "butterworth", plots_per_dataset: int = 0, **_) -> None:
    samples, failed = _samples(spark, data)
    signal, found = events.ensemble(samples, filter_name)
    summary = cut(events.channel_summary(signal, found), "run")
    sinks.write_events(found, summary, out)
    sinks.write_csv(failed, f"{out}/failed_files", one_file=True)
    if plots_per_dataset:
        sinks.write_texts(spark, plots.event_plots(found.filter("accepted"), signal, detectors.run_detectors(signal), plots_per_dataset), f"{out}/plots", ".svg")
    _say([*report.heading("EVENTS"), *report.table(summary.orderBy("dataset", "channel"))])


def _selected(spark: SparkSession, data: str, method: str | None, p: Parameters) -> tuple[DataFrame, DataFrame, str]:
    samples, _ = _samples(spark, data)
    if method:
        return *events.selected(samples, method, p=p), method
    signal = cut(filters.prepared(samples.filter("channel = 'FBG2'"), "savitzky_golay"), "run")
    method = evaluate.select_best(evaluate.evaluate_methods(signal, p))
    return signal, cut(events.single_method_events(signal, method, p), "run"), method


def selected_run(spark: SparkSession, data: str, out: str, method: str | None = None, **_) -> None:
    signal, found, method = _selected(spark, data, method, Parameters())
    sinks.write_events(found, events.channel_summary(signal, found).withColumn("method", F.lit(method)), out)


def _shape(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    signal, found, _ = _selected(spark, data, "peak", Parameters())
    accepted = found.filter("accepted")
    if accepted.isEmpty():
        raise SystemExit("no accepted events")
    return signal, accepted, cut(features.shape_features(accepted, signal), "run")


def shape_run(spark: SparkSession, data: str, out: str, plots_per_dataset: int = 3, **_) -> None:
    """The shape features of the selected channel's accepted events, by themselves."""
    signal, accepted, shape = _shape(spark, data)
    sinks.write_csv(shape.select(*features.SHAPE_COLUMNS), f"{out}/shape_features", ["dataset", "impact_id"])
    if plots_per_dataset:
        sinks.write_texts(spark, plots.event_plots(accepted, signal, per_dataset=plots_per_dataset), f"{out}/plots", ".svg")
    _say(report.shape(shape, _samples(spark, data)[1]))


def features_run(spark: SparkSession, data: str, out: str, stft: bool = True, plots_per_dataset: int = 3, **_) -> None:
    config = Spectral(stft=stft)
    signal, accepted, shape = _shape(spark, data)
    many = cut(features.multidomain_features(accepted, signal, shape, config), "run")
    summary = cut(features.feature_summary(many), "run")
    sinks.write_features(shape, many, summary, out, config)
    if plots_per_dataset:
        sinks.write_texts(spark, plots.event_plots(accepted, signal, per_dataset=plots_per_dataset) | plots.feature_plots(many), f"{out}/plots", ".svg")
    _say(report.features(summary.first()))


def evaluation_run(spark: SparkSession, data: str, out: str, filter_name: str = "butterworth", **_) -> None:
    samples, _failed = _samples(spark, data)
    signal, found = events.ensemble(samples, filter_name)
    figures, comparison = cut(evaluate.consistency_report(found, signal), "run"), cut(evaluate.compare_methods(signal), "run")
    sinks.write_evaluation(figures, comparison, out)
    _say(report.evaluation(figures, evaluate.channel_consistency(found.filter("accepted"), signal), evaluate.rejections(found), comparison))


def study_run(spark: SparkSession, data: str, out: str, filter_name: str = "butterworth", **_) -> None:
    """data: filtered signals as the noise run leaves them."""
    filtered = readers.read_filtered(spark, data)
    signal = cut(filtered.select("dataset", "channel", "sample_index", "time", F.col(filter_name).alias("value")), "run")
    impacts = cut(legacy.study(signal), "run")
    summary = cut(legacy.study_summary(signal, impacts), "run")
    sinks.write_study(impacts, summary, out)
    _say(report.detection(summary.orderBy("dataset", "channel", "method")))


RUNS = {"noise": noise_run, "ensemble": ensemble_run, "selected": selected_run, "shape": shape_run, "features": features_run, "evaluation": evaluation_run, "study": study_run}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("run", choices=RUNS)
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--filter", dest="filter_name", choices=FILTERS, default="butterworth")
    p.add_argument("--method", choices=METHODS)
    p.add_argument("--no-stft", dest="stft", action="store_false")
    p.add_argument("--no-csv", dest="csv", action="store_false", help="leave out the CSV of the filtered signals")
    p.add_argument("--max-plots-per-dataset", dest="plots_per_dataset", type=int, default=3)
    p.add_argument("--no-plots", dest="plots_per_dataset", action="store_const", const=0)
    args = vars(p.parse_args(argv))
    run = RUNS[args.pop("run")]
    spark = SparkSession.builder.appName("undula").getOrCreate()
    run(spark, **args)
    return 0


if __name__ == "__main__":
    sys.exit(main())

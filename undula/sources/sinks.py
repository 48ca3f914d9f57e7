"""Writers. Parquet is the store; CSV and JSON are exports, a folder of part files each unless one file is asked for."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.config import FILTERS, SERIES, Spectral
from undula.operators.events import as_table
from undula.operators.features import FEATURE_COLUMNS, SHAPE_COLUMNS


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, one_file: bool = False) -> None:
    """CSV with a header. order ranges rows over the files; one_file is for reports with few rows."""
    if order:
        df = df.orderBy(*order)
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_texts(spark: SparkSession, texts: dict[str, str], path: str, suffix: str) -> None:
    """Small texts as files of their names, wherever the path is."""
    jvm = spark.sparkContext._jvm
    for name, text in texts.items():
        to = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}{suffix}")
        out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
        out.write(bytearray(text.encode()))
        out.close()


def gather_files(spark: SparkSession, parts: str, to: str, suffix: str) -> None:
    """Of folders that one task each has written, parts/key=name/, the files as to/name + suffix. Nothing is read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(parts).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(to))
    for folder in fs.globStatus(path(f"{parts}/*=*")):
        for i, file in enumerate(fs.globStatus(path(folder.getPath(), "part-*"))):
            name = folder.getPath().getName().split("=", 1)[1]
            fs.rename(file.getPath(), path(f"{to}/{name}{f'-{i}' if i else ''}{suffix}"))


def write_filtered(filtered: DataFrame, path: str, csv: str | None = None) -> None:
    """time, raw_wavelength_shift and the four filters, by dataset and channel."""
    made = filtered.select(*SERIES, "sample_index", "time", F.col("value").alias("raw_wavelength_shift"), *FILTERS)
    made.write.mode("overwrite").partitionBy(*SERIES).parquet(path)
    if csv:
        made.repartition(*SERIES).sortWithinPartitions(*SERIES, "sample_index").drop("sample_index").write.mode("overwrite").partitionBy(*SERIES).option("header", True).csv(csv)


def write_events(events: DataFrame, summary: DataFrame, out: str) -> None:
    """All events and those accepted as CSV, the summary, and JSON by dataset."""
    table = as_table(events)
    write_csv(table, f"{out}/events_all_datasets", ["dataset", "channel", "event_id"])
    write_csv(table.filter("accepted"), f"{out}/accepted_events_all_datasets", ["dataset", "channel", "event_id"])
    write_csv(summary, f"{out}/summary", SERIES, one_file=True)
    table.withColumn("of", F.col("dataset")).repartition("of").sortWithinPartitions("of", "channel", "event_id").write.mode("overwrite").partitionBy("of").json(f"{out}/events_json")


def write_noise(reduction: DataFrame, evaluation: DataFrame, failed: DataFrame, out: str) -> None:
    keys = ["dataset", "channel", "filter"]
    write_csv(reduction.withColumnRenamed("dataset", "experiment").orderBy("experiment", "channel", "filter"), f"{out}/filter_noise", one_file=True)
    write_csv(evaluation, f"{out}/filter_evaluation", keys, one_file=True)
    write_csv(failed, f"{out}/failed_files", ["file"], one_file=True)


def write_study(impacts: DataFrame, summary: DataFrame, out: str) -> None:
    write_csv(impacts, f"{out}/impacts", ["dataset", "channel", "method", "impact_number"])
    write_csv(summary, f"{out}/detection_summary", ["dataset", "channel", "method"], one_file=True)


def write_features(shape: DataFrame, features: DataFrame, summary: DataFrame, out: str, config: Spectral = Spectral()) -> None:
    write_csv(shape.select(*SHAPE_COLUMNS), f"{out}/shape_features", ["dataset", "impact_id"])
    write_csv(features.select(*FEATURE_COLUMNS), f"{out}/multidomain_features", ["dataset", "impact_id"])
    write_csv(summary, f"{out}/summary", one_file=True)
    spark = shape.sparkSession
    spark.createDataFrame([asdict(config)]).coalesce(1).write.mode("overwrite").json(f"{out}/config")


def write_evaluation(report: DataFrame, comparison: DataFrame, out: str) -> None:
    write_csv(report, f"{out}/consistency_report", ["metric"], one_file=True)
    write_csv(comparison, f"{out}/method_comparison", ["dataset", "approach"], one_file=True)

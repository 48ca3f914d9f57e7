"""Recordings as rows (dataset, channel, sample_index, time, value), and the same shape over other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.config import CHANNELS, FILTERS, SERIES
from undula.numbering import numbered_in

RAW = "time STRING, channel_id STRING, peak_count STRING, scan_status STRING, error_flag STRING, " + ", ".join(f"{c} STRING" for c in CHANNELS) + ", _corrupt STRING"


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Every .txt recording of a folder: tab-separated, no header, eight columns; dataset is the file's stem. `block` is
    the start of the part of the file that a row was read in, `row` rises along such a part."""
    raw = (
        spark.read.schema(RAW)
        .option("sep", "\t")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("columnPruning", False)  # else a row with too many fields passes where few columns are asked for
        .option("pathGlobFilter", "*.txt")
        .csv(folder)
    )
    return raw.select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("dataset"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def failed_files(raw: DataFrame) -> DataFrame:
    """file, error: recordings with a malformed row or a time that isn't a number. A whole file fails, never the run."""
    bad = F.max(F.col("_corrupt").isNotNull())
    no_time = F.max(F.expr("try_cast(time AS DOUBLE)").isNull())
    checked = raw.groupBy("dataset").agg(bad.alias("ragged"), no_time.alias("no_time")).filter("ragged OR no_time")
    return checked.select(F.concat("dataset", F.lit(".txt")).alias("file"), F.when(F.col("ragged"), "a row has the wrong number of fields").otherwise("a time is not a number").alias("error"))


def samples(raw: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Long rows of the recordings that can be read; cells that aren't numbers are null. Samples are in the order of
    their file; each block of a file is numbered by itself, behind those before it."""
    failed = failed_files(raw).select(F.regexp_replace("file", r"\.txt$", "").alias("dataset"))
    good = raw.join(failed, "dataset", "left_anti")
    timed = good.select("dataset", "block", "row", F.expr("try_cast(time AS DOUBLE)").alias("time"), *[F.nanvl(F.expr(f"try_cast({c} AS DOUBLE)"), F.lit(None).cast("double")).alias(c) for c in channels])
    indexed = numbered_in(timed, ["row"], ["dataset"], F.col("block"), "sample_index").drop("block", "row")
    return indexed.unpivot(["dataset", "sample_index", "time"], list(channels), "channel", "value").select("dataset", "channel", "sample_index", "time", "value")


def read_filtered(spark: SparkSession, path: str) -> DataFrame:
    """Filtered signals as `sinks.write_filtered` leaves them, Parquet or CSV; needs time and takes the filters that are there. Samples of a CSV
    are in the order of their files' names and rows."""
    csv = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select("path")
    if not csv.isEmpty():  # only names are read
        return _read_filtered_csv(spark, path)
    df = spark.read.parquet(path)
    there = _filters_of(df)
    return df.select(*SERIES, "sample_index", "time", *there)


def _filters_of(df: DataFrame) -> list[str]:
    if "time" not in df.columns:
        raise ValueError("filtered signals need a time column")
    there = [c for c in FILTERS if c in df.columns]
    if not there:
        raise ValueError("no filtered signal found")
    return there


def _read_filtered_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    there = _filters_of(df)
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in SERIES], *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("time", *there)], F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start")).alias("block"), F.monotonically_increasing_id().alias("row"))
    made = numbered_in(rows, ["row"], SERIES, F.col("block"), "sample_index")
    return made.select(*SERIES, F.col("sample_index").cast("long").alias("sample_index"), "time", *there)


def events_by(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """The event table as series by event_type or user_id; time in seconds from a series' first event. Days are numbered by themselves."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("channel"), "ts", "event_id", "value")
    first = e.groupBy("channel").agg(F.min("ts").alias("first"))
    placed = numbered_in(e, ["ts", "event_id"], ["channel"], F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date")), "sample_index").join(first, "channel")
    seconds = F.timestamp_diff("MICROSECOND", F.col("first"), F.col("ts")) / 1e6
    return placed.select(F.lit("events").alias("dataset"), "channel", F.col("sample_index").cast("long").alias("sample_index"), seconds.alias("time"), "value")


def ev_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_by(spark, sf_dir, "event_type")


def ev_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_by(spark, sf_dir, "user_id")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a series."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = e.select(F.col("label").cast("string").alias("dataset"), F.col("vec_id").cast("string").alias("channel"), F.posexplode("embedding").alias("sample_index", "value"))
    return e.select("dataset", "channel", F.col("sample_index").cast("long").alias("sample_index"), (F.col("sample_index") / 50.0).alias("time"), F.col("value").cast("double").alias("value"))


def li_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended prices of each supplier in the order of shipping."""
    cols = ["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*cols)
    month = F.coalesce(F.trunc(F.col("l_shipdate").cast("date"), "month"), F.lit("0001-01-01").cast("date"))
    li = numbered_in(li.withColumn("channel", F.coalesce(F.col("l_suppkey").cast("string"), F.lit(""))), [*cols[1:], "l_extendedprice"], ["channel"], month, "sample_index")
    return li.select(F.lit("lineitem").alias("dataset"), "channel", F.col("sample_index").cast("long").alias("sample_index"), (F.col("sample_index") / 50.0).alias("time"), F.col("l_extendedprice").alias("value"))

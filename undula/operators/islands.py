"""Interval algebra over regions (start_index, end_index, both inclusive): gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.config import SERIES
from undula.operators.blocks import SAMPLES


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length of the intersection over that of the shorter region; 0 if they are apart."""
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1
    shorter = F.least(a_end - a_start, b_end - b_start) + 1
    return F.when(shared > 0, shared / shorter).otherwise(0.0)


def adjacent(a_start: Column, a_end: Column, b_start: Column, b_end: Column, tolerance: int = 5) -> Column:
    """Whether at most `tolerance` samples lie between the regions."""
    return F.greatest(a_start, b_start) - F.when(a_start <= b_start, a_end).otherwise(b_end) - 1 <= tolerance


def regions_to_mask(regions: DataFrame, samples: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """The samples with `mask`: whether any region holds them. Regions are clipped; inverted ones don't count."""
    inside = regions.filter("start_index <= end_index").select(*keys, F.explode(F.sequence(F.greatest("start_index", F.lit(0)), "end_index")).alias("sample_index")).distinct()
    return samples.join(inside.withColumn("mask", F.lit(True)), [*keys, "sample_index"], "left").withColumn("mask", F.coalesce("mask", F.lit(False)))


def merge_nearby(regions: DataFrame, gap: int = 2, keys: list[str] = SERIES) -> DataFrame:
    """Regions with at most `gap` samples between them become one."""
    w = Window.partitionBy(*keys).orderBy("start_index", "end_index")
    reach = F.max("end_index").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = regions.withColumn("opens", F.when(F.col("start_index") <= reach + gap + 1, 0).otherwise(1))
    grouped = opened.withColumn("_run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_run").agg(F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index")).drop("_run")


def mask_to_regions(samples: DataFrame, mask: str = "mask", keys: list[str] = SERIES, size: int = SAMPLES) -> DataFrame:
    """Maximal runs of true samples. Runs are found block by block and joined where they touch across a border."""
    w = Window.partitionBy(*keys, "block").orderBy("sample_index")
    true = samples.filter(F.col(mask)).select(*keys, "sample_index", F.floor(F.col("sample_index") / size).alias("block"))
    run = true.withColumn("run", F.col("sample_index") - F.row_number().over(w))
    parts = run.groupBy(*keys, "block", "run").agg(F.min("sample_index").alias("start_index"), F.max("sample_index").alias("end_index"))
    return merge_nearby(parts.select(*keys, "start_index", "end_index"), 0, keys)


def drop_short(regions: DataFrame, least: int = 3) -> DataFrame:
    return regions.filter(F.col("end_index") - F.col("start_index") + 1 >= least)


def clean_regions(samples: DataFrame, least: int = 3, gap: int = 2, mask: str = "mask", keys: list[str] = SERIES) -> DataFrame:
    """Runs of the mask, without short ones, merged over gaps; in this order."""
    return merge_nearby(drop_short(mask_to_regions(samples, mask, keys), least), gap, keys)


def persistent(samples: DataFrame, k: int = 2, mask: str = "mask", keys: list[str] = SERIES) -> DataFrame:
    """The mask without runs shorter than k."""
    kept = drop_short(mask_to_regions(samples, mask, keys), k)
    return regions_to_mask(kept, samples.drop(mask), keys).withColumnRenamed("mask", mask)

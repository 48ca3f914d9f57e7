"""Places of rows in an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.lineage import cut


def numbered(df: DataFrame, order: list[Column | str], by: list[str] = (), out: str = "place", name: str = "ranges") -> DataFrame:
    """df with `out`, a row's place in the order among the rows of its group, from 0.

    Rows are dealt by ranges of group and order, so a large group is many ranges; each range counts its rows by group (a row for every
    range and group that it holds), and the sums of those before it are added to the places within it. The order must be total.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), name)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    starts = counts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by_{c}") for c in by], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy("_range", *by).orderBy(*order)
    placed = ranged.withColumn(out, F.row_number().over(inside) - 1).join(starts, same)
    return placed.withColumn(out, F.col(out) + F.col("_start")).drop("_range", "_r", "_start", *[f"_by_{c}" for c in by])


def numbered_in(df: DataFrame, order: list[Column | str], by: list[str], bucket: Column, out: str = "place") -> DataFrame:
    """The same without writing anything, where a bucket of the order is at hand: an expression that never falls along it, and of which no
    value holds too many rows of a group. Groups must not be null."""
    ready = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = ready.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    starts = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    placed = ready.withColumn(out, F.row_number().over(inside) - 1).join(starts, [*by, "_bucket"])
    return placed.withColumn(out, F.col(out) + F.col("_start")).drop("_bucket", "_start")

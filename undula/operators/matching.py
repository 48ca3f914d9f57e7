"""Matching of regions across detectors, splitting of bridged groups, and range joins of events with samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.config import SERIES
from undula.operators.islands import merge_nearby

#: Samples in a bucket of a range join.
BUCKET = 1024


def samples_of(events: DataFrame, samples: DataFrame, low: str = "start_index", high: str = "end_index", keys: list[str] = SERIES) -> DataFrame:
    """Each event (or region) with the samples from low to high: an equi-join on buckets of sample_index, then the exact bounds."""
    dealt = events.withColumn("bucket", F.explode(F.sequence(F.floor(F.greatest(F.col(low), F.lit(0)) / BUCKET), F.floor(F.greatest(F.col(high), F.lit(0)) / BUCKET))))
    s = samples.select(*keys, "sample_index", "time", "value", F.floor(F.col("sample_index") / BUCKET).alias("bucket"))
    return dealt.join(s, [*keys, "bucket"]).filter(F.col("sample_index").between(F.col(low), F.col(high))).drop("bucket")


def meeting(a: DataFrame, b: DataFrame, tolerance: int = 5, keys: list[str] = SERIES) -> DataFrame:
    """Each pair of a region of a and one of b that overlap or have at most `tolerance` samples between, once: keys, a and b (structs). A
    pair is found in the first bucket that both reach."""
    wide = tolerance + 1

    def dealt(regions: DataFrame, name: str, more: int) -> DataFrame:
        low, high = F.floor((F.col("start_index") - more) / BUCKET), F.floor((F.col("end_index") + more) / BUCKET)
        return regions.filter("start_index <= end_index").select(*keys, F.struct(*[c for c in regions.columns if c not in keys]).alias(name), F.explode(F.sequence(low, high)).alias("bucket"))

    both = dealt(a, "a", wide).join(dealt(b, "b", 0), [*keys, "bucket"])
    first = F.floor(F.greatest(F.col("a.start_index") - wide, F.col("b.start_index")) / BUCKET)
    near = (F.col("b.start_index") <= F.col("a.end_index") + wide) & (F.col("b.end_index") >= F.col("a.start_index") - wide)
    return both.filter(near & (F.col("bucket") == first)).drop("bucket")


def match_groups(regions: DataFrame, tolerance: int = 5) -> DataFrame:
    """Adds island, the group of regions linked by at most `tolerance` samples between, and island_rank, its place by the
    first detector's first region."""
    w = Window.partitionBy(*SERIES).orderBy("start_index", "end_index", "method_rank", "region_idx")
    reach = F.max("end_index").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = regions.withColumn("opens", F.when(F.col("start_index") <= reach + tolerance + 1, 0).otherwise(1))
    grouped = opened.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")
    return grouped.withColumn("island_rank", F.min(F.struct("method_rank", "region_idx")).over(Window.partitionBy(*SERIES, "island")))


def support_zones(groups: DataFrame, least: int = 2) -> DataFrame:
    """Runs of samples that regions of at least `least` methods of a group cover, from a sweep over their ends."""
    keys = [*SERIES, "island"]
    covered = merge_nearby(groups.select(*keys, "method", "start_index", "end_index"), 0, [*keys, "method"])
    steps = covered.select(*keys, F.col("start_index").alias("at"), F.lit(1).alias("step")).unionByName(covered.select(*keys, (F.col("end_index") + 1).alias("at"), F.lit(-1).alias("step")))
    steps = steps.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(*keys).orderBy("at")
    steps = steps.withColumn("support", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("at").over(w))
    zones = steps.filter(F.col("support") >= least).select(*keys, F.col("at").alias("start_index"), (F.col("next") - 1).alias("end_index"))
    return merge_nearby(zones, 0, keys)


def split_groups(groups: DataFrame, min_gap: int = 20) -> DataFrame:
    """Adds cluster: groups whose zones of common support lie further apart than `min_gap` fall into one per stretch.
    A region goes to the first cluster it meets, else to the nearest, the earlier of two as near."""
    keys = [*SERIES, "island"]
    clusters = merge_nearby(support_zones(groups), min_gap, keys)
    w = Window.partitionBy(*keys)
    clusters = clusters.withColumn("cluster", F.row_number().over(w.orderBy("start_index")) - 1).withColumn("n", F.count("*").over(w)).filter("n > 1")
    zone = F.struct("cluster", F.col("start_index").alias("start"), F.col("end_index").alias("end"))
    marks = clusters.select(*keys, F.col("end_index").alias("at"), F.lit(1).alias("kind"), zone.alias("zone"))
    # Clusters are apart and in order, so a region's candidates are the first that ends at or behind its start and the one before.
    region = F.struct("island_rank", "method", "method_rank", "region_idx", "start_index", "end_index")
    both = groups.select(*keys, F.col("start_index").alias("at"), F.lit(0).alias("kind"), region.alias("region")).unionByName(marks, allowMissingColumns=True)
    line = w.orderBy("at", "kind")
    back = w.orderBy(F.desc("at"), F.desc("kind"))
    both = both.withColumn("after", F.last("zone", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("before", F.last("zone", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))).filter("kind = 0")
    picked = both.select(*keys, "region.*", "after", "before")

    def away(zone: str):
        return F.least(F.abs(F.col("start_index") - F.col(f"{zone}.end")), F.abs(F.col("end_index") - F.col(f"{zone}.start")))

    meets = F.col("after.start") <= F.col("end_index")
    cluster = F.when(meets, F.col("after.cluster")).when(F.col("after").isNull() | (away("before") <= away("after")), F.col("before.cluster")).otherwise(F.col("after.cluster"))
    return picked.withColumn("cluster", F.coalesce(cluster, F.lit(0))).drop("after", "before")


def numbered(groups: DataFrame) -> DataFrame:
    """Adds k, the number of each (sub-)group within its series, from 1 in group order, and event_id."""
    w = Window.partitionBy(*SERIES).orderBy("island_rank", "cluster")
    made = groups.withColumn("k", F.dense_rank().over(w))
    return made.withColumn("event_id", F.format_string("%s-%s-%03d", *SERIES, "k"))

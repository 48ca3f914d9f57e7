"""Scalar functions that spark.sql can call. They are SQL functions, so the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, result, expression)
FUNCTIONS = {
    "overlap_fraction": (
        "a_start BIGINT, a_end BIGINT, b_start BIGINT, b_end BIGINT",
        "DOUBLE",
        "CASE WHEN least(a_end, b_end) >= greatest(a_start, b_start) THEN (least(a_end, b_end) - greatest(a_start, b_start) + 1) / (least(a_end - a_start, b_end - b_start) + 1) ELSE 0D END",
    ),
    "regions_adjacent": (
        "a_start BIGINT, a_end BIGINT, b_start BIGINT, b_end BIGINT, tolerance BIGINT",
        "BOOLEAN",
        "greatest(a_start, b_start) - CASE WHEN a_start <= b_start THEN a_end ELSE b_end END - 1 <= tolerance",
    ),
    "hull_start": ("a_start BIGINT, b_start BIGINT", "BIGINT", "least(a_start, b_start)"),
    "hull_end": ("a_end BIGINT, b_end BIGINT", "BIGINT", "greatest(a_end, b_end)"),
    "recovery_tolerance": ("sigma DOUBLE, deviation DOUBLE", "DOUBLE", "greatest(2D * sigma, 0.2D * deviation)"),
    "deviation_std": ("peak DOUBLE, mean DOUBLE, sigma DOUBLE", "DOUBLE", "CASE WHEN sigma <= 1e-12 THEN double('Infinity') ELSE abs(peak - mean) / sigma END"),
    "noise_reduction": ("raw_std DOUBLE, filtered_std DOUBLE", "DOUBLE", "CASE WHEN raw_std = 0 THEN 0D ELSE (raw_std - filtered_std) / raw_std * 100 END"),
    "peak_preservation": ("raw_peak DOUBLE, filtered_peak DOUBLE", "DOUBLE", "coalesce(try_divide(abs(filtered_peak), abs(raw_peak)), 0D)"),
    "hann_weight": ("pos BIGINT, n BIGINT", "DOUBLE", "CASE WHEN n <= 2 THEN 1D ELSE 0.5D - 0.5D * cos(2 * pi() * pos / (n - 1)) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; gives their names."""
    for name, (parameters, result, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression}")
    return list(FUNCTIONS)

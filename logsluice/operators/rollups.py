"""Distinct counts and percentiles over long ranges from sketches that are kept per minute and merged.

A minute and group has one HyperLogLog sketch per counted column and one KLL sketch per measured one; hours and days merge those of their minutes, so no event is read
twice and what is kept grows with minutes and groups, not with events. Counts and sums are exact. A distinct count is within about
1.04 / sqrt(2 ** LG_K) of the true one (one standard deviation); the rank of a percentile is within ERROR of the asked one, nearly always.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the registers of a HyperLogLog sketch, size of a KLL sketch, and the rank error that it stands for.
LG_K, KLL_K, ERROR = 12, 400, 0.01


def sketched(events: DataFrame, by: Sequence[str], distinct: Sequence[str] = (), measured: Sequence[str] = (), unit: str = "minute", time: str = "timestamp") -> DataFrame:
    """One row per bucket of time and group: bucket, by, n, d_<column> (sketch of its distinct values), m_<column> (sketch of its values), c_<column> (how many)."""
    bucket = F.date_trunc(unit, F.col(time)).alias("bucket")
    return events.where(F.col(time).isNotNull()).groupBy(bucket, *by).agg(
        F.count("*").alias("n"),
        *[F.hll_sketch_agg(F.col(c).cast("string"), LG_K).alias(f"d_{c}") for c in distinct],
        *[x for c in measured for x in (F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_K)).alias(f"m_{c}"), F.count(c).alias(f"c_{c}"))],
    )


def merged(sketches: DataFrame, by: Sequence[str], unit: str | None) -> DataFrame:
    """Sketches of longer buckets (unit None: of all time) from those of shorter ones. by: the groups that stay."""
    at = [F.date_trunc(unit, "bucket").alias("bucket")] if unit else []
    of = lambda head: [c for c in sketches.columns if c.startswith(head)]
    return sketches.groupBy(*at, *by).agg(
        F.sum("n").alias("n"), *[F.hll_union_agg(c).alias(c) for c in of("d_")], *[F.kll_merge_agg_double(c, F.lit(KLL_K)).alias(c) for c in of("m_")], *[F.sum(c).alias(c) for c in of("c_")]
    )


def distinct_count(column: str) -> Column:
    return F.hll_sketch_estimate(f"d_{column}").alias(f"n_{column}")


def percentile(column: str, p: float) -> Column:
    return F.when(F.col(f"c_{column}") > 0, F.kll_sketch_get_quantile_double(f"m_{column}", F.lit(p)))

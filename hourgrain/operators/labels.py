"""Block labels from training-only calendar-month thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hourgrain.operators import ordering as O


def month_thresholds(fit: DataFrame, keys: Sequence[str], value: str, ts: str, at_least: int = 30, **kw) -> DataFrame:
    """Lower and upper quartile per calendar month of the fit rows, with support."""
    v = F.col(value)
    out = O.quantiles(
        fit, [*keys, "month"], {"low_threshold": (v, 0.25), "high_threshold": (v, 0.75)},
        {"n_fit_blocks": F.count(v), "n_fit_days": F.count_distinct(F.to_date(ts))}, **kw,
    )
    return out.withColumn("supported", F.col("n_fit_blocks") >= at_least)


def pooled_thresholds(fit: DataFrame, keys: Sequence[str], value: str, **kw) -> DataFrame:
    v = F.col(value)
    return O.quantiles(fit, keys, {"pooled_low": (v, 0.25), "pooled_high": (v, 0.75)}, **kw)


def is_high(value: Column, threshold: Column) -> Column:
    """A missing value or threshold is not high."""
    return F.coalesce(value >= threshold, F.lit(False))


def is_low(value: Column, threshold: Column) -> Column:
    return F.coalesce(value <= threshold, F.lit(False))


def with_thresholds(rows: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """High and low labels per month; unsupported months get NULL thresholds and false labels."""
    t = thresholds.select(
        *keys, "month", *[F.when(F.col("supported"), F.col(c)).alias(c) for c in ("low_threshold", "high_threshold")]
    )
    return rows.join(t, [*keys, "month"], "left")


def block_hours(hourly: DataFrame, thresholds: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, maximum, hours at or above the month threshold, share of the largest hour, all-high.

    A block has at most six hours, so its percentile is a bounded aggregate.
    """
    t = thresholds.select(*keys, "month", F.col("high_threshold").alias("__t"))
    v = F.col(value)
    return hourly.join(t, [*keys, "month"], "left").groupBy(*keys, "block_start").agg(
        F.percentile(v, F.lit(0.5)).alias("median_value"),
        F.max(v).alias("max_value"),
        F.count_if(v >= F.col("__t")).alias("hours_ge_threshold"),
        (F.max(v) / F.nullif(F.sum(v), F.lit(0.0))).alias("max_hour_share"),
        ((F.count(v) == 6) & F.coalesce(F.bool_and(F.coalesce(v >= F.col("__t"), F.lit(False))), F.lit(False))).alias("sustained_high"),
    )

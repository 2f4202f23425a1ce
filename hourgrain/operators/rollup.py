"""Hourly weather rollups and grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hourgrain.operators import ordering as O


def right_closed_hour(ts: Column) -> Column:
    """Label of the hour (h-1, h] that holds a time."""
    back = F.date_trunc("HOUR", ts - F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp_ntz")
    return back + F.expr("INTERVAL 1 HOUR")


def hourly_means(minutes: DataFrame, keys: Sequence[str], ts: str, columns: dict[str, Column], at_least: int = 45,
                 totals: dict[str, Column] | None = None, full: int = 60) -> DataFrame:
    """Mean per right-closed hour when ``at_least`` minutes are present, sums only for full hours,
    and the minute counts behind both."""
    means = [F.when(F.count(c) >= at_least, F.avg(c)).alias(n) for n, c in columns.items()]
    counts = [F.count(c).alias(f"n_{n}") for n, c in columns.items()]
    sums = [F.when(F.count(c) == full, F.sum(c)).alias(n) for n, c in (totals or {}).items()]
    counts += [F.count(c).alias(f"n_{n}") for n, c in (totals or {}).items()]
    return minutes.groupBy(*keys, right_closed_hour(F.col(ts)).alias("origin")).agg(*means, *sums, *counts)


def gain_summary(gains: DataFrame, keys: Sequence[str], gain: str, low: str, **kw) -> DataFrame:
    """Median gain, groups with a positive gain and groups with a positive lower bound."""
    return O.quantiles(
        gains, keys, {"median_gain": (F.col(gain), 0.5)},
        {"n": F.count("*"), "n_positive": F.count_if(F.col(gain) > 0), "n_positive_lower": F.count_if(F.col(low) > 0)}, **kw,
    )


def r2(y: Column, p: Column) -> Column:
    """1 - SSE / SST as one aggregate; SST by the stable central moment. NULL without variance."""
    both = F.when(y.isNotNull() & p.isNotNull(), y)
    sst = F.var_pop(both) * F.count(both)
    return F.when(sst > 0, 1 - F.sum((y - p) * (y - p)) / sst)


def physical_bridge(df: DataFrame, keys: Sequence[str], target: str, n82: str, future_target: str, future_n82: str, **kw) -> DataFrame:
    """Target over N82 now and later, persistence and look-ahead R2, and the typical change of N82."""
    t, n, ft, fn = (F.col(c) for c in (target, n82, future_target, future_n82))
    ln, lfn, lft = F.log1p(n), F.log1p(fn), F.log1p(ft)
    now = t / F.nullif(n, F.lit(0.0))
    return O.quantiles(
        df, keys,
        {
            "ratio_now_q10": (now, 0.1), "ratio_now_median": (now, 0.5), "ratio_now_q90": (now, 0.9),
            "ratio_future_median": (ft / F.nullif(fn, F.lit(0.0)), 0.5),
            "median_abs_log_change": (F.abs(lfn - ln), 0.5),
        },
        {
            "n": F.count("*"), "r2_persistence": r2(lfn, ln), "r2_lookahead": r2(lft, lfn), "r2_from_now": r2(lft, ln),
        },
        **kw,
    )


def stratified_contrast(df: DataFrame, stratum: str, n: str, f: str, outcome: str, at_least: int = 20, **kw) -> DataFrame:
    """Per stratum: keep the fit rows' middle 40 % of ``n``, split the test rows of that range by the
    fit quartiles of ``f`` and compare the outcome medians of the two outer groups."""
    tagged = contrast_groups(df, stratum, n, f, **kw)
    low, high = F.col("group") == "low", F.col("group") == "high"
    v = {}
    for name, c in (("n", n), ("f", f), ("outcome", outcome)):
        v[f"{name}_low_median"] = (F.when(low, F.col(c)), 0.5)
        v[f"{name}_high_median"] = (F.when(high, F.col(c)), 0.5)
    out = O.quantiles(
        tagged, [stratum], v,
        {
            "n_fit_middle": F.count_if(F.col("fit") & F.col("middle")), "n_test_middle": F.count_if(F.col("test") & F.col("middle")),
            "n_test_low": F.count_if(low), "n_test_high": F.count_if(high),
        },
        **kw,
    )
    enough = F.least("n_test_low", "n_test_high") >= at_least
    out = out.withColumn("status", F.when(enough, "contrast").otherwise("insufficient_test_groups"))
    out = out.withColumn("outcome_ratio", F.col("outcome_high_median") / F.nullif(F.col("outcome_low_median"), F.lit(0.0)))
    out = out.withColumn("outcome_difference", F.col("outcome_high_median") - F.col("outcome_low_median"))
    values = [*v, "outcome_ratio", "outcome_difference"]
    return out.select(*[c for c in out.columns if c not in values], *[F.when(enough, F.col(c)).alias(c) for c in values])


def contrast_groups(df: DataFrame, stratum: str, n: str, f: str, **kw) -> DataFrame:
    """Tag rows as middle range and, among test rows, as low / high group of ``f``."""
    edges = O.quantiles(df.where("fit"), [stratum], {"n_q30": (F.col(n), 0.3), "n_q70": (F.col(n), 0.7)}, **kw)
    mid = df.join(edges, stratum).withColumn("middle", F.col(n).between(F.col("n_q30"), F.col("n_q70")))
    cuts = O.quantiles(mid.where("fit AND middle"), [stratum], {"f_q25": (F.col(f), 0.25), "f_q75": (F.col(f), 0.75)}, **kw)
    t = mid.join(cuts, stratum, "left")
    inside = F.col("test") & F.col("middle")
    return t.withColumn(
        "group", F.when(inside & (F.col(f) >= F.col("f_q75")), "high").when(inside & (F.col(f) <= F.col("f_q25")), "low")
    )

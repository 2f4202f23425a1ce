"""Scores of predictions. Every score is one grouped aggregate with map-side partial sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hourgrain.functions import scalars as S
from hourgrain.operators import ordering as O
from hourgrain.operators.rollup import r2


def regression_columns(y: Column, p: Column) -> dict[str, Column]:
    """Log-scale R2 and MAE, MAE and mean bias after expm1."""
    return {
        "r2_log": r2(y, p),
        "mae_log": F.avg(F.abs(y - p)),
        "mae_raw": F.avg(F.abs(F.expm1(y) - F.expm1(p))),
        "mean_bias": F.avg(F.expm1(p) - F.expm1(y)),
    }


def regression_scores(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    cols = regression_columns(F.col(y), F.col(p))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in cols.items()])


def probability_scores(df: DataFrame, keys: Sequence[str], event: str, p: str, prior: str | None = None) -> DataFrame:
    """Brier score, skill against a constant prior column, events and distinct probabilities.

    Distinct values are counted from (group, p) cells, which combine on the map side.
    """
    e, q = F.col(event).cast("double"), F.col(p)
    base = (F.col(prior) - e) * (F.col(prior) - e) if prior else F.lit(None).cast("double")
    cells = df.groupBy(*keys, p).agg(
        F.count("*").alias("__n"), F.sum(e).alias("__e"), F.sum((q - e) * (q - e)).alias("__b"), F.sum(base).alias("__r")
    )
    out = cells.groupBy(*keys).agg(
        F.sum("__n").alias("n"), F.sum("__e").cast("bigint").alias("events"), (F.sum("__b") / F.sum("__n")).alias("brier"),
        F.count("*").alias("distinct_probabilities"), (F.sum("__r") / F.sum("__n")).alias("__prior"),
    )
    if prior:
        out = out.withColumn("brier_skill", 1 - F.col("brier") / F.nullif(F.col("__prior"), F.lit(0.0)))
    return out.drop("__prior")


def average_precision(df: DataFrame, keys: Sequence[str], event: str, p: str, **kw) -> DataFrame:
    """Step-wise average precision: tied scores enter together; NULL without events."""
    cells = df.groupBy(*keys, p).agg(F.count("*").alias("__n"), F.sum(F.col(event).cast("bigint")).alias("__h"))
    cum = O.running_totals(cells, keys, p, ["__n", "__h"], **kw)
    gained = F.sum(F.col("__h") * F.col("cum___h") / F.col("cum___n"))
    return cum.groupBy(*keys).agg((gained / F.nullif(F.sum("__h"), F.lit(0))).alias("average_precision"))


def alarm_counts(df: DataFrame, keys: Sequence[str], event: str, alarm: str) -> DataFrame:
    e, a = F.col(event).cast("boolean"), F.col(alarm)
    return df.groupBy(*keys).agg(
        F.count_if(a & e).alias("hits"), F.count_if(~a & e).alias("misses"), F.count_if(a & ~e).alias("false_alarms"),
        (F.count_if(a & ~e) / F.nullif(F.count_if(~e), F.lit(0))).alias("false_alarm_rate"),
    )


def reliability(df: DataFrame, keys: Sequence[str], event: str, p: str) -> DataFrame:
    """Ten probability bins per group; empty bins stay in the table."""
    b = F.least(F.floor(F.col(p) * 10), F.lit(9)).cast("int")
    have = df.groupBy(*keys, b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_probability"), F.avg(F.col(event).cast("double")).alias("observed_frequency")
    )
    frame = have.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return O.join_groups(frame, have, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def seasonal_gain(df: DataFrame, keys: Sequence[str], ts: str, y: str, p0: str, p1: str, min_rows: int = 100, min_days: int = 30) -> DataFrame:
    """Scores of two models per season; all four seasons stay, with a support flag."""
    yy, a, b = F.col(y), F.col(p0), F.col(p1)
    err = lambda q: F.abs(F.expm1(yy) - F.expm1(q))
    have = df.groupBy(*keys, S.season_of(F.month(ts)).alias("season")).agg(
        F.count("*").alias("n_rows"), F.count_distinct(F.to_date(ts)).alias("n_days"),
        F.count_distinct(F.date_format(ts, "yyyy-MM")).alias("n_months"),
        r2(yy, a).alias("r2_base"), r2(yy, b).alias("r2_added"), (r2(yy, b) - r2(yy, a)).alias("delta_r2"),
        F.avg(err(a)).alias("mae_base"), F.avg(err(b)).alias("mae_added"), F.avg(err(a) - err(b)).alias("mae_gain"),
    )
    frame = have.select(*keys).distinct().withColumn("season", F.explode(F.array(*[F.lit(s) for s in S.SEASONS])))
    out = O.join_groups(frame, have, [*keys, "season"], "left")
    for c in ("n_rows", "n_days", "n_months"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    return out.withColumn("supported", (F.col("n_rows") >= min_rows) & (F.col("n_days") >= min_days))


def stratum_brier(df: DataFrame, keys: Sequence[str], stratum: Column, event: str, p0: str, p1: str) -> DataFrame:
    """Brier scores of two models per stratum (season, year, closure class)."""
    e = F.col(event).cast("double")
    a, b = (F.col(p0) - e) * (F.col(p0) - e), (F.col(p1) - e) * (F.col(p1) - e)
    return df.groupBy(*keys, stratum.alias("stratum")).agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("bigint")).alias("events"), F.avg(a).alias("brier_base"),
        F.avg(b).alias("brier_added"), F.avg(a - b).alias("brier_gain"),
    )


def paired_regression_gain(df: DataFrame, keys: Sequence[str], y: str, p0: str, p1: str) -> DataFrame:
    """Added minus base on equal rows: R2 change and reduction of the raw mean absolute error."""
    yy, a, b = F.col(y), F.col(p0), F.col(p1)
    return df.where(yy.isNotNull() & a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), r2(yy, a).alias("r2_base"), r2(yy, b).alias("r2_added"),
        (r2(yy, b) - r2(yy, a)).alias("delta_r2"),
        F.avg(F.abs(F.expm1(yy) - F.expm1(a)) - F.abs(F.expm1(yy) - F.expm1(b))).alias("mae_reduction"),
    )


def paired_probability_gain(df: DataFrame, keys: Sequence[str], event: str, p0: str, p1: str, ties: Sequence[str], fraction: float = 0.1, **kw) -> DataFrame:
    """Brier, average-precision and top-budget precision gains of two models on equal rows."""
    from hourgrain.operators.ranking import flag_pair, melt

    e = F.col(event).cast("double")
    flagged = flag_pair(df, keys, p0, p1, ties, fraction, **kw)
    gain = flagged.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("bigint")).alias("events"),
        F.avg((F.col(p0) - e) * (F.col(p0) - e) - (F.col(p1) - e) * (F.col(p1) - e)).alias("brier_gain"),
        F.count_if("in_base").alias("selected"),
        F.sum(F.when(F.col("in_base"), e).otherwise(0)).cast("bigint").alias("hits_base"),
        F.sum(F.when(F.col("in_added"), e).otherwise(0)).cast("bigint").alias("hits_added"),
    )
    ap = average_precision(melt(df, [*keys, event], {"base": p0, "added": p1}, "__side", "__p"), [*keys, "__side"], event, "__p", **kw)
    of = lambda side: F.max(F.when(F.col("__side") == side, F.col("average_precision")))
    ap = ap.groupBy(*keys).agg((of("added") - of("base")).alias("ap_gain"))
    out = O.join_groups(gain, ap, keys, "left").withColumn("additional_hits", F.col("hits_added") - F.col("hits_base"))
    return out.withColumn("precision_gain", F.col("additional_hits") / F.col("selected"))

"""Leakage-free chronological cohorts: purged splits, cut dates, folds, support tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hourgrain.functions import scalars as S
from hourgrain.operators.ordering import join_groups

# First test time per site (UTC).
TEST_BOUNDARIES = {
    "ANX": "2020-03-23 00:00:00",
    "COR": "2019-02-23 00:00:00",
    "ENA": "2023-09-01 00:00:00",
    "GUC": "2023-01-06 05:00:00",
    "MAO": "2014-12-03 00:00:00",
    "MOS": "2020-06-27 02:00:00",
    "SBS_CP": "2011-02-28 00:00:00",
    "SBS_SPL": "2011-02-27 00:00:00",
    "SGP": "2021-11-23 00:00:00",
}


def site_boundary(site: Column) -> Column:
    """The site's boundary as an expression: nine fixed entries need no join."""
    table = F.create_map(*[F.lit(x) for kv in TEST_BOUNDARIES.items() for x in kv])
    return F.try_element_at(table, site).cast("timestamp_ntz")


def hourly_split(ts: Column, lead_h: Column, eligible: Column, cut: Column) -> tuple[Column, Column]:
    """(fit, test): a fit label must end strictly before the cut, a test origin starts at or after it."""
    ok = S.known_true(eligible)
    return (
        ok & S.known_true(ts + S.hours_interval(lead_h) < cut),
        ok & S.known_true(ts >= cut),
    )


def block_partition(start: Column, end: Column, origin: Column, cut: Column, outer: Column, eligible: Column) -> Column:
    """'fit', 'calibration', 'test' or NULL for a six-hour block; straddling blocks belong nowhere."""
    ok = S.known_true(eligible)
    return (
        F.when(ok & (end <= cut), "fit")
        .when(ok & (start >= cut) & (end <= outer), "calibration")
        .when(ok & (origin >= outer), "test")
    )


def inner_partition(start: Column, end: Column, inner: Column) -> Column:
    """Chronological train / validation inside the fit rows."""
    return F.when(end <= inner, "train").when(start >= inner, "validation")


def date_fraction_cut(df: DataFrame, key: str, ts: str, fraction: float, out: str = "cut") -> DataFrame:
    """The floor(f*n)-th (from 0) of a key's distinct dates. DOUBLE arithmetic decides the index.

    Only distinct (key, date) pairs are gathered, so the list is bounded by the calendar.
    """
    days = df.where(F.col(ts).isNotNull()).select(key, S.floor_day(F.col(ts)).alias("__day")).distinct()
    listed = days.groupBy(key).agg(F.array_sort(F.collect_list("__day")).alias("__days"))
    at = F.floor(F.lit(float(fraction)) * F.size("__days").cast("double")).cast("int")
    return listed.select(key, F.get("__days", at).alias(out), F.size("__days").cast("bigint").alias("n_days"))


def common_origins(df: DataFrame, keys: Sequence[str], leads: Sequence[int], eligible: str = "eligible") -> DataFrame:
    """Origins eligible at every lead of the set."""
    chosen = df.where(F.col("lead_h").isin(list(leads)))
    g = chosen.groupBy(*keys).agg(F.count_if(eligible).alias("__n"))
    return g.where(F.col("__n") == len(set(leads))).select(*keys)


def fold_plan(days: DataFrame, key: str, ts: str, end: str, shares: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Forward-chaining folds per key: fit before ``left``, score [left, right). ``end`` is a column."""
    d = days.groupBy(key).agg(
        F.array_sort(F.collect_set(S.floor_day(F.col(ts)))).alias("__d"), F.max(end).alias("__end")
    )
    n = F.size("__d")
    cut = [F.get("__d", F.least(n - 1, F.floor(n.cast("double") * F.lit(q)).cast("int"))) for q in shares]
    right = cut[1:] + [F.col("__end")]
    folds = F.array(*[F.struct(F.lit(i).alias("fold"), a.alias("left"), b.alias("right")) for i, (a, b) in enumerate(zip(cut, right))])
    return d.select(key, F.inline(folds))


def assign_folds(df: DataFrame, folds: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows once per fold they serve, with role 'fit' (earlier) or 'score' (inside).

    The few folds of a key travel as one array, so this is an equi-join followed by a generator.
    """
    packed = folds.groupBy(key).agg(F.collect_list(F.struct("fold", "left", "right")).alias("__f"))
    j = df.join(packed, key).withColumn("__f", F.explode("__f"))
    role = F.when(F.col(ts) < F.col("__f.left"), "fit").when(F.col(ts) < F.col("__f.right"), "score")
    return j.withColumn("fold", F.col("__f.fold")).withColumn("role", role).drop("__f").where("role IS NOT NULL")


def support_table(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", min_fit: int = 100, min_test: int = 100,
                  extra: dict[str, Column] | None = None) -> DataFrame:
    """Counts, dates and first/last test time per group, with a status. Needs fit and test flags."""
    day = F.to_date(ts)
    out = df.groupBy(*keys).agg(
        F.count_if("fit").alias("n_fit"),
        F.count_if("test").alias("n_test"),
        F.count_distinct(F.when(F.col("test"), day)).alias("n_test_dates"),
        F.min(F.when(F.col("test"), F.col(ts))).alias("test_start"),
        F.max(F.when(F.col("test"), F.col(ts))).alias("test_end"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    return out.withColumn(
        "status",
        F.when((F.col("n_fit") >= min_fit) & (F.col("n_test") >= min_test), "supported").otherwise("insufficient_hours"),
    )


def boundary_crossings(blocks: DataFrame, boundaries: dict[str, str]) -> DataFrame:
    """Blocks whose origin lies before a boundary and whose end lies after it."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("boundary_name"), F.col(c).alias("boundary")) for n, c in boundaries.items()]))
    b = blocks.withColumn("__b", each)
    return (
        b.withColumn("boundary_name", F.col("__b.boundary_name")).withColumn("boundary", F.col("__b.boundary")).drop("__b")
        .where((F.col("origin") < F.col("boundary")) & (F.col("block_end") > F.col("boundary")))
    )


def monthly_coverage(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], month: str = "month") -> DataFrame:
    """All twelve months per group; absent months count zero."""
    have = df.groupBy(*keys, F.col(month).cast("int").alias("month")).agg(*[c.alias(n) for n, c in aggregates.items()])
    frame = have.select(*keys).distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    out = join_groups(frame, have, [*keys, "month"], "left")
    return out.select(*keys, "month", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in aggregates])


def class_support(df: DataFrame, keys: Sequence[str], partition: str, event: str, at_least: int = 15) -> DataFrame:
    """Events and non-events per partition and whether both reach the minimum."""
    g = df.groupBy(*keys, partition).agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("bigint")).alias("n_events")
    )
    return g.withColumn("supported", (F.col("n_events") >= at_least) & (F.col("n") - F.col("n_events") >= at_least))


def matched_rows(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Rows where every predictor is present, so all compared models see the same sample."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in predictors]))


def complete_cohort(now: DataFrame, spectra: DataFrame, key: str, lead: int, cut: Column) -> DataFrame:
    """Hours with a usable spectrum and target both now and ``lead`` hours later, split at ``cut``.

    ``now(key, timestamp, target, target_ok, spectrum_ok)`` are aligned hours and
    ``spectra(key, timestamp, mapped_ok)`` the mapped spectra.
    """
    future = now.select(
        key, F.col("timestamp").alias("future_ts"), F.col("target").alias("future_target"), F.col("target_ok").alias("future_ok")
    )
    mapped_now = spectra.select(key, "timestamp", F.col("mapped_ok").alias("now_ok"))
    mapped_later = spectra.select(key, F.col("timestamp").alias("future_ts"), F.col("mapped_ok").alias("later_ok"))
    j = (
        now.withColumn("future_ts", F.col("timestamp") + S.hours_interval(lead))
        .join(future, [key, "future_ts"], "left")
        .join(mapped_now, [key, "timestamp"], "left")
        .join(mapped_later, [key, "future_ts"], "left")
    )
    ok = reduce(lambda a, b: a & b, [S.known_true(F.col(c)) for c in ("spectrum_ok", "target_ok", "future_ok", "now_ok", "later_ok")])
    ok = ok & S.usable_value(F.col("target")) & S.usable_value(F.col("future_target"))
    fit, test = hourly_split(F.col("timestamp"), F.lit(lead), ok, cut)
    return j.withColumn("fit", fit).withColumn("test", test).where("fit OR test")

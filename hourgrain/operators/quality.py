"""Duplicate rules, gates and replay checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hourgrain.functions import scalars as S
from hourgrain.operators import ordering as O

# Gate tolerances.
MEDIAN_TOLERANCE = 0.03
TAIL_TOLERANCE = 0.05
TOTAL_TOLERANCE = 0.05
MIN_MAPPED_VALID_FRACTION = 0.95
WIDTH_METHODS = (
    "instrument_documented_bin_edges",
    "source_processing_code_conversion_weights",
    "source_density_to_bin_conversion_delta_log10_dp",
    "source_forward_spacing_scale_crosschecked_delta_log10_dp",
)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in ``order``.

    An aggregate instead of a window: map-side combine folds copies before the shuffle, so a key
    with very many copies costs one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return picked.select(*keys, "__row.*").select(df.columns)


def duplicate_conflicts(df: DataFrame, keys: Sequence[str], values: Sequence[str], tol: float = 1e-8) -> DataFrame:
    """Per key: copies, and whether any value differs between them (missing equals missing)."""
    spread = [
        F.coalesce(F.max(v) - F.min(v) > F.lit(tol), F.lit(False)) | ((F.count(v) > 0) & (F.count(v) < F.count("*")))
        for v in values
    ]
    return df.groupBy(*keys).agg(
        F.count("*").alias("copies"), reduce(lambda a, b: a | b, spread).alias("conflict")
    )


def series_checks(df: DataFrame, key: str, ts: str, seq: str, step_micros: int) -> DataFrame:
    """Per series: duplicate times, out-of-order rows, gaps, and times off the step grid."""
    rows = df.select(key, ts, seq, S.micros(F.col(ts)).alias("__t"))
    dup = rows.groupBy(key, ts).agg(F.count("*").alias("c")).groupBy(key).agg(
        F.sum("c").alias("n_rows"), F.sum(F.col("c") - 1).alias("n_duplicate_rows")
    )
    order = O.previous_in_order(rows, [key], seq, "__t", 65536, "__p").groupBy(key).agg(
        F.count_if(F.col("__t") < F.col("__p")).alias("n_out_of_order"),
        F.count_if(F.col("__t") % F.lit(step_micros) != 0).alias("n_off_grid"),
    )
    times = rows.select(key, "__t").distinct().withColumn("__u", F.col("__t"))
    gaps = O.previous_in_order(times, [key], "__t", "__u", step_micros * 4096, "__p").groupBy(key).agg(
        F.count_if(F.col("__t") - F.col("__p") != F.lit(step_micros)).alias("n_uneven_steps")
    )
    return O.join_groups(O.join_groups(dup, order, [key]), gaps, [key])


def gate_columns(q05: Column, median: Column, q95: Column, median_tol: float, tail_tol: float) -> Column:
    """A ratio passes when its median and both tails are close enough to one."""
    return F.coalesce(
        (F.abs(median - 1.0) <= F.lit(median_tol)) & (q05 >= F.lit(1.0 - tail_tol)) & (q95 <= F.lit(1.0 + tail_tol)),
        F.lit(False),
    )


def ratio_gate(
    df: DataFrame, keys: Sequence[str], ratio: Column, median_tol: float = MEDIAN_TOLERANCE, tail_tol: float = TAIL_TOLERANCE,
    extra: dict[str, Column] | None = None, **kw,
) -> DataFrame:
    stats = O.quantiles(
        df, keys, {"q05": (ratio, 0.05), "median": (ratio, 0.5), "q95": (ratio, 0.95)}, extra, **kw
    )
    return stats.withColumn("passed", gate_columns(F.col("q05"), F.col("median"), F.col("q95"), median_tol, tail_tol))


def agreement_gate(df: DataFrame, keys: Sequence[str], ratio: Column, extra: dict[str, Column] | None = None, **kw) -> DataFrame:
    """Mapped against native totals: tails in 0.95-1.05, median in 0.97-1.03, all three two-sided."""
    stats = O.quantiles(df, keys, {"q05": (ratio, 0.05), "median": (ratio, 0.5), "q95": (ratio, 0.95)}, extra, **kw)
    inside = F.col("q05").between(0.95, 1.05) & F.col("median").between(0.97, 1.03) & F.col("q95").between(0.95, 1.05)
    return stats.withColumn("passed", F.coalesce(inside, F.lit(False)))


def cohort_checks(df: DataFrame, key: str, bins: Column, ts: str = "timestamp") -> DataFrame:
    """One gate row per site over a cohort with boolean fit/val/test and target columns."""
    per_time = df.select(
        key, ts, "fit", "val", "test", "target", "current", bins.alias("__bins")
    ).withColumn(
        "__bad", ~F.coalesce(F.forall("__bins", lambda v: F.coalesce(v >= 0, F.lit(False))), F.lit(False))
    )
    unique = per_time.groupBy(key, ts).agg(F.count("*").alias("c")).groupBy(key).agg(
        F.count_if(F.col("c") > 1).alias("n_repeated_times")
    )
    flags = [F.col(c) for c in ("fit", "val", "test")]
    both = (flags[0] & flags[1]) | (flags[0] & flags[2]) | (flags[1] & flags[2])
    out = per_time.groupBy(key).agg(
        F.count("*").alias("n_rows"),
        F.count_if("fit").alias("n_fit"),
        F.count_if("val").alias("n_val"),
        F.count_if("test").alias("n_test"),
        F.count_if(both).alias("n_overlap"),
        F.count_if("__bad").alias("n_bad_bins"),
        F.count_if(F.col("target").isNull() | F.col("current").isNull()).alias("n_bad_labels"),
        F.max(F.when(F.col("fit"), F.col(ts))).alias("last_fit"),
        F.min(F.when(F.col("test"), F.col(ts))).alias("first_test"),
    )
    out = O.join_groups(out, unique, [key])
    return out.withColumn(
        "passed",
        (F.col("n_overlap") == 0) & (F.col("n_bad_bins") == 0) & (F.col("n_bad_labels") == 0)
        & (F.col("n_repeated_times") == 0) & F.coalesce(F.col("last_fit") < F.col("first_test"), F.lit(False)),
    )


def closure_checks(df: DataFrame, key: str, bins: Column, total: str, n82: str, f82: str, origin: str, start: str) -> DataFrame:
    from hourgrain.functions.spectra import array_sum

    return df.groupBy(key).agg(
        F.count("*").alias("n_rows"),
        F.max(F.abs(array_sum(bins) / F.col(total) - 1)).alias("max_total_error"),
        F.count_if(F.abs(F.col(n82) - F.col(total) * F.col(f82)) > F.lit(1e-4) + F.lit(1e-5) * F.abs(F.col(n82))).alias("n_n82_errors"),
        F.count_if(~(F.col(origin) < F.col(start))).alias("n_leaking_origins"),
    )


def replay_check(new: DataFrame, old: DataFrame, keys: Sequence[str], values: Sequence[str], atol: float) -> DataFrame:
    """Archived against recomputed rows: unmatched keys on either side and the largest differences."""
    a = new.select(*keys, *[F.col(v).alias(f"__a_{v}") for v in values], F.lit(True).alias("__in_a"))
    b = old.select(*keys, *[F.col(v).alias(f"__b_{v}") for v in values], F.lit(True).alias("__in_b"))
    j = a.join(b, list(keys), "full_outer")
    diffs = [F.max(F.abs(F.col(f"__a_{v}") - F.col(f"__b_{v}"))).alias(f"max_abs_{v}") for v in values]
    out = j.agg(
        F.count_if(F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()).alias("n_matched"),
        F.count_if(F.col("__in_b").isNull()).alias("n_only_new"),
        F.count_if(F.col("__in_a").isNull()).alias("n_only_old"),
        *diffs,
    )
    close = reduce(lambda x, y: x & y, [F.coalesce(F.col(f"max_abs_{v}") <= F.lit(atol), F.lit(True)) for v in values])
    return out.withColumn("reproduced", (F.col("n_only_new") == 0) & (F.col("n_only_old") == 0) & close)


def channel_coverage(df: DataFrame, key: str, spectrum: str, diameters: Sequence[float]) -> DataFrame:
    d = F.array(*[F.lit(float(x)) for x in diameters])
    return (
        df.select(key, F.posexplode(spectrum).alias("j", "v"))
        .groupBy(key, "j")
        .agg(F.count("v").alias("n_finite"), F.count_if(F.col("v") >= 0).alias("n_nonnegative"))
        .select(key, F.col("j").cast("bigint").alias("j"), F.get(d, F.col("j").cast("int")).alias("diameter_nm"), "n_finite", "n_nonnegative")
    )


def minute_qc_coverage(df: DataFrame, var: str, value: str, qc: str) -> DataFrame:
    rows = df.select(
        var,
        F.explode(
            F.array(
                F.struct(F.lit("primary").alias("p"), F.when(S.qc_bits_ok(F.col(qc)), F.col(value)).alias("v")),
                F.struct(F.lit("strict").alias("p"), F.when(S.qc_bits_ok(F.col(qc), True), F.col(value)).alias("v")),
            )
        ).alias("s"),
    )
    return rows.groupBy(F.col("s.p").alias("policy"), var).agg(
        F.count("*").alias("n_minutes"), F.count("s.v").alias("n_valid")
    )


def representation_contract(df: DataFrame) -> DataFrame:
    """Declared (``declared_*``) against embedded (``embedded_*``) metadata of each dataset."""
    fields = ("semantics", "unit", "diameter_definition", "width_method", "width_evidence")
    conflict = [
        F.coalesce(F.col(f"declared_{f}") != F.col(f"embedded_{f}"), F.lit(False)) for f in fields
    ]
    for f in fields:
        df = df.withColumn(f"resolved_{f}", F.coalesce(f"declared_{f}", f"embedded_{f}"))
    methods = F.array(*[F.lit(m) for m in WIDTH_METHODS])
    bad_method = F.coalesce(~F.array_contains(methods, F.col("resolved_width_method")), F.lit(False))
    per_bin = F.col("resolved_semantics") == "bin_concentration"
    widths_ok = F.col("has_widths") & F.col("resolved_width_method").isNotNull() & (
        F.coalesce(F.length("resolved_width_evidence"), F.lit(0)) > 0
    )
    complete = (
        (F.coalesce(F.length("resolved_unit"), F.lit(0)) > 0)
        & F.coalesce(F.col("resolved_diameter_definition") == "midpoint_nm", F.lit(False))
        & (F.col("semantics_evidence").isNotNull() | F.col("has_total"))
        & (~F.coalesce(per_bin, F.lit(False)) | widths_ok)
    )
    return df.withColumn(
        "status",
        F.when(reduce(lambda a, b: a | b, conflict), "conflict")
        .when(bad_method, "unsupported_width_method")
        .when(~complete, "incomplete")
        .otherwise("passed"),
    )

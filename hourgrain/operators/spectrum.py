"""Table-level spectrum operators: axis tables, audits, range extension, profiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hourgrain.functions import scalars as S, spectra as P
from hourgrain.operators import ordering as O, quality as Q


def channel_edges(channels: DataFrame, key: str, d: str) -> DataFrame:
    """Edges and width of every channel of every site; ``valid_axis`` is false for a bad axis.

    One row per site and channel, so a window holds one instrument's axis (tens of rows).
    """
    w = W.partitionBy(key).orderBy(d)
    c, p, n = F.log10(d), F.lag(F.log10(d)).over(w), F.lead(F.log10(d)).over(w)
    t = channels.withColumn("__c", c).withColumn("__p", p).withColumn("__n", n)
    t = t.withColumn("edge_lo", F.coalesce((F.col("__c") + F.col("__p")) / 2, F.col("__c") - (F.col("__n") - F.col("__c")) / 2))
    t = t.withColumn("edge_hi", F.coalesce((F.col("__c") + F.col("__n")) / 2, F.col("__c") + (F.col("__c") - F.col("__p")) / 2))
    ok = (F.col(d) > 0) & (F.coalesce(F.col("__c") > F.col("__p"), F.lit(True))) & (F.col("__p").isNotNull() | F.col("__n").isNotNull())
    return t.withColumn("width", F.col("edge_hi") - F.col("edge_lo")).withColumn(
        "valid_axis", F.min(F.coalesce(ok, F.lit(False))).over(W.partitionBy(key))
    ).drop("__c", "__p", "__n")


def target_bounds(grid: Sequence[float], semantics: str) -> tuple[float, float]:
    """Diameters (nm) that bound the mapped grid under the semantics' cell convention."""
    if semantics == "bin_concentration":
        return grid[0], 10 ** (math.log10(grid[-1]) + P.log10_widths(grid)[-1])
    e = P.log10_edges(grid)
    return 10 ** e[0], 10 ** e[-1]


def width_gate(diameters: Sequence[float], grid: Sequence[float], widths: Sequence[float] | None) -> bool:
    """Explicit widths must be usable on two or more channels that span the grid."""
    if widths is None:
        return True
    used = [d for d, w in zip(diameters, widths) if w is not None and math.isfinite(w) and w > 0]
    return len(used) >= 2 and min(used) <= grid[0] and max(used) >= grid[-1]


def audit(
    df: DataFrame,
    keys: Sequence[str],
    spectrum: str,
    valid: Column,
    diameters: Sequence[float],
    grid: Sequence[float],
    semantics: str = "dndlog10dp",
    supplied: Column | None = None,
    widths: Sequence[float] | None = None,
    **kw,
) -> DataFrame:
    """One report row per key: coverage, conservation, agreement with a supplied total, negatives.

    Row-local work first, then a single grouped aggregate.
    """
    x = F.col(spectrum)
    low, high = target_bounds(grid, semantics)
    full = P.full_integral(x, diameters, semantics, widths)
    rows = df.select(
        *keys,
        F.coalesce(valid, F.lit(False)).alias("__ok"),
        P.array_sum(P.regrid(x, diameters, grid, semantics, widths)).alias("__mapped"),
        P.range_integral(x, diameters, semantics, low, high, widths).alias("__native"),
        F.size(F.filter(x, lambda v: v < 0)).alias("__neg"),
        full.alias("__full"),
        (supplied if supplied is not None else F.lit(None).cast("double")).alias("__supplied"),
        (
            P.array_sum(P.regrid(x, diameters, grid, semantics, widths, scale=False))
            if semantics == "bin_concentration" else F.lit(None).cast("double")
        ).alias("__direct"),
    )
    mapped_ok = F.col("__ok") & F.col("__mapped").isNotNull()
    usable = mapped_ok & (F.col("__native") > 0)
    ratio = F.when(usable, F.col("__mapped") / F.col("__native"))
    total = F.when(F.col("__ok") & (F.col("__full") > 0) & (F.col("__supplied") > 0), F.col("__full") / F.col("__supplied"))
    bias = F.when(usable, F.col("__direct") / F.col("__native"))
    wanted = {}
    for name, value in (("conservation", ratio), ("total", total), ("direct", bias)):
        wanted |= {f"{name}_q05": (value, 0.05), f"{name}_median": (value, 0.5), f"{name}_q95": (value, 0.95)}
    out = O.quantiles(
        rows, keys, wanted,
        {
            "n_rows": F.count("*"),
            "n_input_valid": F.count_if("__ok"),
            "n_mapped_valid": F.count_if(mapped_ok),
            "n_usable": F.count_if(usable),
            "n_negative_cells": F.coalesce(F.sum(F.when(F.col("__ok"), F.col("__neg"))), F.lit(0)),
        },
        **kw,
    )
    out = out.withColumn("mapped_valid_fraction", F.col("n_mapped_valid") / F.greatest(F.col("n_input_valid"), F.lit(1)))
    gate = lambda n, m, t: Q.gate_columns(F.col(f"{n}_q05"), F.col(f"{n}_median"), F.col(f"{n}_q95"), m, t)
    out = out.withColumn("conservation_gate", gate("conservation", Q.MEDIAN_TOLERANCE, Q.TAIL_TOLERANCE))
    out = out.withColumn(
        "total_gate", gate("total", Q.TOTAL_TOLERANCE, Q.TOTAL_TOLERANCE) if supplied is not None else F.lit(True)
    )
    out = out.withColumn("coverage_gate", F.col("mapped_valid_fraction") >= F.lit(Q.MIN_MAPPED_VALID_FRACTION))
    return out.withColumn(
        "passed",
        F.col("conservation_gate") & F.col("total_gate") & F.col("coverage_gate") & (F.col("n_usable") > 0)
        & (F.col("n_negative_cells") == 0) & F.lit(width_gate(diameters, grid, widths)),
    )


def audit_struct(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nested manifest form of an audit report."""
    q = lambda n: F.struct(*[F.col(f"{n}_{p}").alias(p) for p in ("q05", "median", "q95")]).alias(n)
    rest = [c for c in report.columns if c not in keys and not c.startswith(("conservation_q", "conservation_m", "total_q", "total_m", "direct_"))]
    return report.select(*keys, q("conservation"), q("total"), q("direct"), *rest)


def extend_range(df: DataFrame, spectrum: str, diameters: Sequence[float], low: float = 15.0, mid: float = 300.0, high: float = 500.0) -> DataFrame:
    """Add the native integral above ``mid`` to N and N82; rows without the full range get NULL."""
    x = F.col(spectrum)
    ok = P.channels_complete(x, diameters, low, high) & ~F.exists(x, lambda v: F.coalesce(v < 0, F.lit(False)))
    tail = P.range_integral(x, diameters, "dndlog10dp", mid, high)
    out = df.withColumn("extended_ok", F.coalesce(ok, F.lit(False)))
    out = out.withColumn("tail", F.when(F.col("extended_ok"), tail))
    out = out.withColumn("total_ext", F.col("total") + F.col("tail")).withColumn("n82_ext", F.col("n82") + F.col("tail"))
    return out.withColumn("f82_ext", F.col("n82_ext") / F.nullif(F.col("total_ext"), F.lit(0.0)))


def tail_contribution(df: DataFrame, key: str, ts: str, is_test: Column, **kw) -> DataFrame:
    """Quantiles of four tail ratios over all/fit/test rows and each season (a row counts in three)."""
    period = F.explode(
        F.array(F.lit("all"), F.when(is_test, "test").otherwise("fit"), S.season_of(F.month(ts)))
    )
    ratios = {
        "tail_over_total": F.col("tail") / F.nullif(F.col("total"), F.lit(0.0)),
        "tail_over_n82": F.col("tail") / F.nullif(F.col("n82"), F.lit(0.0)),
        "tail_share": F.col("tail") / F.nullif(F.col("total_ext"), F.lit(0.0)),
        "fraction_change": F.col("f82_ext") - F.col("f82"),
    }
    metric = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("v")) for n, v in ratios.items()]))
    rows = df.where("extended_ok").select(key, period.alias("period"), metric.alias("m"))
    rows = rows.select(key, "period", F.col("m.metric").alias("metric"), F.col("m.v").alias("v")).where("v IS NOT NULL")
    v = F.col("v")
    return O.quantiles(
        rows, [key, "period", "metric"], {"q05": (v, 0.05), "median": (v, 0.5), "q95": (v, 0.95)}, {"n": F.count("*")}, **kw
    )


def profiles(df: DataFrame, keys: Sequence[str], bins: Column, grid: Sequence[float], **kw) -> DataFrame:
    """Median and quartiles per diameter of spectra normalised to their own total."""
    total = F.nullif(P.array_sum(bins), F.lit(0.0))
    scaled = F.zip_with(bins, P.array_lit(P.log10_widths(grid)), lambda v, w: v / total / w)
    rows = df.select(*keys, F.posexplode(scaled).alias("k", "v"))
    v = F.col("v")
    out = O.quantiles(rows, [*keys, "k"], {"q25": (v, 0.25), "median": (v, 0.5), "q75": (v, 0.75)}, {"n": F.count("v")}, **kw)
    return out.withColumn("diameter_nm", F.get(P.array_lit(grid), F.col("k")))


def with_cutoffs(df: DataFrame, bins: Column, grid: Sequence[float], cutoffs: Sequence[float]) -> DataFrame:
    """One row per spectrum and cutoff with the count and the fraction above it."""
    total = F.nullif(P.array_sum(bins), F.lit(0.0))
    each = F.explode(
        F.array(*[F.struct(F.lit(float(c)).alias("cutoff_nm"), P.count_above(bins, grid, c).alias("count")) for c in cutoffs])
    )
    return df.withColumn("__c", each).select(
        *df.columns, F.col("__c.cutoff_nm").alias("cutoff_nm"), F.col("__c.count").alias("count_above"),
        (F.col("__c.count") / total).alias("fraction_above"),
    )

"""Fit-row statistics for model inputs: medians, moments, and the predictor sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hourgrain.functions import spectra as P
from hourgrain.operators import ordering as O
from hourgrain.session import cut_lineage


def fit_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fit: str = "fit", **kw) -> DataFrame:
    """Exact median of each predictor over the fit rows, as an array; all-missing predictors give NULL."""
    q = O.quantiles(df.where(fit), keys, {f"__m{i}": (F.col(c), 0.5) for i, c in enumerate(columns)}, **kw)
    return q.select(*keys, F.array(*[F.col(f"__m{i}") for i in range(len(columns))]).alias("medians"))


def shifted(columns: Sequence[str]) -> list[Column]:
    """Predictors after median imputation, measured from that median; dropped predictors are 0.

    Sums of products of shifted values keep their digits where raw sums would cancel.
    """
    m = [F.get("medians", F.lit(i)) for i in range(len(columns))]
    return [F.coalesce(F.col(c).cast("double") - m[i], F.lit(0.0)) for i, c in enumerate(columns)]


def moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fit: str = "fit") -> DataFrame:
    """Fit mean and population SD of the imputed predictors; a zero SD becomes 1."""
    z = shifted(columns)
    rows = df.where(fit).select(*keys, *[c.alias(f"__z{i}") for i, c in enumerate(z)])
    agg = rows.groupBy(*keys).agg(
        *[F.avg(f"__z{i}").alias(f"__a{i}") for i in range(len(z))], *[F.stddev_pop(f"__z{i}").alias(f"__s{i}") for i in range(len(z))]
    )
    sd = [F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")).otherwise(1.0) for i in range(len(z))]
    return agg.select(
        *keys, F.array(*[F.col(f"__a{i}") for i in range(len(z))]).alias("means"), F.array(*sd).alias("sds")
    )


def standardise(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fit: str = "fit", **kw) -> DataFrame:
    """Add ``z``: imputed and scaled predictors, with statistics from the fit rows only.

    The statistics (one row per group) are stored before they meet the rows again.
    """
    med = fit_medians(df, keys, columns, fit, **kw)
    stats = O.join_groups(med, moments(O.join_groups(df, med, keys), keys, columns, fit), keys)
    both = O.join_groups(df, cut_lineage(stats), keys)
    z = [(c - F.get("means", F.lit(i))) / F.get("sds", F.lit(i)) for i, c in enumerate(shifted(columns))]
    return both.withColumn("z", F.array(*z)).drop("medians", "means", "sds")


def predictor_sets(calendar: Sequence[str], total: str, n82: str, f82: str) -> dict[str, list[str]]:
    """Column lists of the compared representations."""
    c = list(calendar)
    return {
        "calendar": c,
        "calendar_total": [*c, total],
        "calendar_total_f82": [*c, total, f82],
        "calendar_N82": [*c, n82],
    }


def history_features(representation: str, context: str, calendar: Column, n: Column, n82: Column, f82: Column, fractions: Column) -> Column:
    """Feature array of a block from six-step histories (oldest first).

    ``n``, ``n82``, ``f82`` are ARRAY<DOUBLE>, ``fractions`` is ARRAY<ARRAY<DOUBLE>>; 'current'
    takes the last step, 'history6' flattens all steps.
    """
    one = lambda a: F.transform(a, lambda v: F.array(v))
    steps = {
        "N": one(n),
        "N82": one(n82),
        "N_plus_f82": F.zip_with(n, f82, lambda a, b: F.array(a, b)),
        "full24": F.zip_with(n, fractions, lambda a, b: F.concat(F.array(a), b)),
    }
    if representation not in steps:
        raise ValueError(f"unknown representation {representation!r}")
    s = steps[representation]
    if context == "current":
        particle = F.element_at(s, -1)
    elif context == "history6":
        particle = F.flatten(s)
    else:
        raise ValueError(f"unknown context {context!r}")
    return F.concat(calendar, particle)


def fraction_columns(bins: Column, keep: int) -> list[Column]:
    share = P.bin_fractions(bins, keep)
    return [F.get(share, F.lit(i)).alias(f"share_{i}") for i in range(keep)]

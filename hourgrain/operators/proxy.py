"""Two-stage forecasts: a concurrent proxy of the target, carried forward or fed to a second model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hourgrain.operators import cohort as C, linear as L
from hourgrain.session import cut_lineage


def out_of_fold(df: DataFrame, key: str, ts: str, cut: str, sets: dict[str, Sequence[str]], y: str, eligible: str) -> DataFrame:
    """Proxy of the concurrent target before the cut, each row predicted from strictly earlier rows.

    All folds of all keys are one grouped fit with (key, fold) as the group.
    """
    pool = df.where(F.col(eligible) & (F.col(ts) < F.col(cut)))
    folds = C.fold_plan(pool, key, ts, cut)
    rows = C.assign_folds(pool, folds, key, ts)
    rows = rows.withColumn("fit", F.col("role") == "fit").withColumn("test", F.col("role") == "score")
    p = L.fit_predict(rows, [key, "fold"], sets, y)
    return p.select(key, ts, *[F.col(f"p_{n}").alias(f"proxy_{n}") for n in sets])


def frozen(df: DataFrame, key: str, ts: str, cut: str, sets: dict[str, Sequence[str]], y: str, eligible: str, usable: str) -> DataFrame:
    """Proxy after the cut from one model fitted on everything before it."""
    rows = df.withColumn("fit", F.col(eligible) & (F.col(ts) < F.col(cut))).withColumn("test", F.col(usable) & (F.col(ts) >= F.col(cut)))
    p = L.fit_predict(rows, [key], sets, y)
    return p.select(key, ts, *[F.col(f"p_{n}").alias(f"proxy_{n}") for n in sets])


def proxies(df: DataFrame, key: str, ts: str, cut: str, sets: dict[str, Sequence[str]], y: str, eligible: str, usable: str) -> DataFrame:
    """Out-of-fold before the cut, frozen after it; rows in the first fifth have none."""
    df = cut_lineage(df)
    return out_of_fold(df, key, ts, cut, sets, y, eligible).unionByName(frozen(df, key, ts, cut, sets, y, eligible, usable))


def transition_routes(rows: DataFrame, keys: Sequence[str], sets: dict[str, Sequence[str]], common: Sequence[str], y: str) -> DataFrame:
    """Four forecasts per representation on the test rows of (site, lead) groups.

    ``rows`` carry fit/test, the predictors and ``proxy_<set>``: the carried proxy, the direct model
    on all fit rows, the direct model on rows that have a proxy, and the model of proxy and ``common``.
    """
    by = list(keys)
    first = next(iter(sets))
    rows = cut_lineage(rows.withColumn("matched", F.col("fit") & F.col(f"proxy_{first}").isNotNull()))
    out = L.fit_predict(rows, by, sets, y).select(
        *rows.columns, *[F.col(f"p_{n}").alias(f"direct_full_{n}") for n in sets], *[F.col(f"proxy_{n}").alias(f"persistence_{n}") for n in sets]
    )
    # all proxies exist on the same rows, so both matched routes of every set share one fit
    second = {f"direct_matched_{n}": list(cs) for n, cs in sets.items()} | {f"transition_{n}": [f"proxy_{n}", *common] for n in sets}
    out = L.ridge_predict(out, L.ridge_fit(rows, by, second, y, fit="matched"), by, second)
    for n in second:
        out = out.withColumnRenamed(f"p_{n}", n)
    return out

"""Ridge regression for many groups, predictor sets and penalties from one pass over the fit rows.

The pass sums the products of all predictors (map-side combined, one row per group). Every set and
penalty is then a sub-matrix of that row, solved in a task; no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from hourgrain.operators import ordering as O
from hourgrain.operators.preparation import fit_medians, shifted
from hourgrain.session import cut_lineage


def gram_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str, fit: str = "fit") -> DataFrame:
    """n, sums, products and target products of the shifted predictors over the fit rows."""
    p = len(columns)
    rows = df.where(fit).select(*keys, F.col(y).cast("double").alias("__y"), *[c.alias(f"__z{i}") for i, c in enumerate(shifted(columns))])
    rows = rows.where(F.col("__y").isNotNull())
    z = [F.col(f"__z{i}") for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.sum("__y").alias("__sy"),
        *[F.sum(z[i]).alias(f"__s{i}") for i in range(p)],
        *[F.sum(z[i] * F.col("__y")).alias(f"__q{i}") for i in range(p)],
        *[F.sum(z[i] * z[j]).alias(f"__g{i}_{j}") for i, j in pairs],
    )
    return agg.select(
        *keys, "__n", "__sy",
        F.array(*[F.col(f"__s{i}") for i in range(p)]).alias("__s"),
        F.array(*[F.col(f"__q{i}") for i in range(p)]).alias("__q"),
        F.array(*[F.col(f"__g{i}_{j}") for i, j in pairs]).alias("__g"),
    )


def _solve(n: float, sy: float, s: np.ndarray, q: np.ndarray, g: np.ndarray, use: list[int], alpha: float):
    """Raw-scale coefficients of ridge on standardised predictors; constant predictors get 0."""
    p = len(s)
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = g
    full = full + np.triu(full, 1).T
    mean = s / n
    cov = full / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    floor = 1e-12 * np.sqrt(np.clip(np.diag(full) / n, 0, None))
    sd = np.where(sd > floor, sd, 1.0)
    a = (cov / np.outer(sd, sd) * n)[np.ix_(use, use)] + alpha * np.eye(len(use))
    b = ((q - mean * sy) / sd)[use]
    coef = np.zeros(p)
    coef[use] = np.linalg.solve(a, b) / sd[use]
    return float(sy / n - coef @ mean), coef, sd


def ridge_fit(
    df: DataFrame, keys: Sequence[str], sets: dict[str, Sequence[str]], y: str, alphas: Sequence[float] = (10.0,), fit: str = "fit", **kw
) -> DataFrame:
    """One row per group with ``medians`` and, per model name, intercept and coefficients.

    The fitted rows are stored, so that predicting does not fit again. The model name is the set name, or ``set@alpha`` when several penalties are fitted.
    """
    columns = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    med = fit_medians(df, keys, columns, fit, **kw)
    sums = gram_sums(O.join_groups(df, med, keys), keys, columns, y, fit)
    plan = [
        (name if len(alphas) == 1 else f"{name}@{alpha:g}", float(alpha), [columns.index(c) for c in cs])
        for name, cs in sets.items() for alpha in alphas
    ]
    key_fields = [f for f in sums.schema.fields if f.name in keys]
    model = T.StructType([
        T.StructField("name", T.StringType()), T.StructField("intercept", T.DoubleType()),
        T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("sd", T.ArrayType(T.DoubleType())),
    ])
    schema = T.StructType([*key_fields, T.StructField("n_fit", T.LongType()), T.StructField("models", T.ArrayType(model))])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                s, q, g = (np.asarray(row[c], dtype=float) for c in ("__s", "__q", "__g"))
                models = []
                for name, alpha, use in plan:
                    b0, coef, sd = _solve(float(row["__n"]), row["__sy"], s, q, g, use, alpha)
                    models.append({"name": name, "intercept": b0, "coef": coef.tolist(), "sd": sd.tolist()})
                out.append({**{k: row[k] for k in keys}, "n_fit": row["__n"], "models": models})
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return cut_lineage(O.join_groups(sums.mapInPandas(solve, schema), med, keys))


def model_names(sets: dict[str, Sequence[str]], alphas: Sequence[float] = (10.0,)) -> list[str]:
    return [n if len(alphas) == 1 else f"{n}@{a:g}" for n in sets for a in alphas]


def linear_predictor(columns: Sequence[str], name: str):
    """intercept + coefficients * shifted predictors, from the joined ``models`` array."""
    m = F.get(F.filter("models", lambda s: s["name"] == name), F.lit(0))
    out = m["intercept"]
    for i, c in enumerate(shifted(columns)):
        out = out + F.get(m["coef"], F.lit(i)) * c
    return out


def ridge_predict(df: DataFrame, fitted: DataFrame, keys: Sequence[str], sets: dict[str, Sequence[str]], alphas: Sequence[float] = (10.0,)) -> DataFrame:
    """Add ``p_<model>`` for every fitted model; groups without a fit are dropped."""
    columns = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    j = O.join_groups(df, fitted, keys)
    return j.select(*df.columns, "n_fit", *[linear_predictor(columns, n).alias(f"p_{n}") for n in model_names(sets, alphas)])


def fit_predict(df: DataFrame, keys: Sequence[str], sets: dict[str, Sequence[str]], y: str, alphas: Sequence[float] = (10.0,),
                fit: str = "fit", score: str = "test", **kw) -> DataFrame:
    """Fit on the fit rows of each group and predict its score rows."""
    fitted = ridge_fit(df, keys, sets, y, alphas, fit, **kw)
    return ridge_predict(df.where(score), fitted, keys, sets, alphas)


def slope_table(fitted: DataFrame, df: DataFrame, keys: Sequence[str], sets: dict[str, Sequence[str]], name: str, column: str, fit: str = "fit", **kw) -> DataFrame:
    """Raw-scale slope of one predictor and the model ratio between its fit quartiles."""
    columns = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    m = F.get(F.filter("models", lambda s: s["name"] == name), F.lit(0))
    beta = fitted.select(*keys, F.get(m["coef"], F.lit(columns.index(column))).alias("slope"))
    q = O.quantiles(df.where(fit), keys, {"fit_q25": (F.col(column), 0.25), "fit_q75": (F.col(column), 0.75)}, **kw)
    return O.join_groups(beta, q, keys).withColumn(
        "ratio_q75_q25", F.exp(F.col("slope") * (F.col("fit_q75") - F.col("fit_q25")))
    )

"""Penalised logistic regression for many groups and predictor sets at once.

Newton's method over all groups: each step is one grouped aggregate of weighted products (map-side
combined), and only the coefficient rows - one per group and set - are checkpointed between steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hourgrain.operators import ordering as O
from hourgrain.operators.preparation import standardise
from hourgrain.session import cut_lineage

MAX_STEPS = 60
TOLERANCE = 1e-10
#: Mean loss below which rows count as separated by their predictors.
SEPARATED = 1e-6


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _named(name: str):
    return lambda s: s["name"] == F.lit(name)


def _score(p: int) -> Column:
    out = F.get("beta", F.lit(0))
    for i in range(p):
        out = out + F.get("beta", F.lit(i + 1)) * F.get("z", F.lit(i))
    return out


def newton(rows: DataFrame, keys: Sequence[str], uses: dict[str, list[int]], p: int, penalty: float = 1.0) -> DataFrame:
    """``rows(keys, z array of p, label)`` -> (keys, name, beta of p+1, converged).

    Minimises the log loss plus penalty/2 * |beta|^2 without penalising the intercept. A predictor outside a set keeps
    coefficient 0. A step that does not lower the loss is halved. ``converged`` is false where the data have no finite
    optimum (separable or one-class rows without a penalty: the fit stops once the mean loss is below ``SEPARATED``) or where
    ``MAX_STEPS`` passes did not suffice; the coefficients are then the best ones met.
    """
    keys = list(keys)
    rows = cut_lineage(rows.select(*keys, "z", F.col("label").cast("double").alias("label")))
    names = F.explode(F.array(*[F.lit(n) for n in uses]))
    zero = F.array_repeat(F.lit(0.0), p + 1)
    state = rows.select(*keys).distinct().withColumn("name", names).select(
        *keys, "name", zero.alias("beta"), zero.alias("best"), F.lit(float("inf")).alias("loss"), zero.alias("move"), F.lit(1.0).alias("scale"), F.lit(False).alias("done"), F.lit(False).alias("converged")
    )
    state = cut_lineage(state)
    fields = [f for f in state.schema.fields if f.name in keys]
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *fields, T.StructField("name", T.StringType()), T.StructField("beta", numbers), T.StructField("best", numbers), T.StructField("loss", T.DoubleType()),
        T.StructField("move", numbers), T.StructField("scale", T.DoubleType()), T.StructField("done", T.BooleanType()), T.StructField("converged", T.BooleanType()),
    ])
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    upper = np.triu_indices(p + 1)

    def advance(row: dict) -> dict:
        """The state after the sums at ``beta`` are known: accept it and propose a full step, or halve the last one."""
        out = {k: row[k] for k in (*keys, "name", "beta", "best", "loss", "move", "scale", "done", "converged")}
        if row["done"]:
            return out
        b = np.array(row["beta"], dtype=float)
        use = [0, *[i + 1 for i in uses[row["name"]]]]
        ridge = penalty * np.r_[0.0, np.ones(p)]
        loss = row["__loss"] + 0.5 * float(np.sum(ridge * b * b))
        if loss <= row["loss"] + 1e-9 * max(1.0, abs(row["loss"])) or not np.isfinite(row["loss"]):
            h = np.zeros((p + 1, p + 1))
            h[upper] = np.asarray(row["__h"], dtype=float)
            h = h + np.triu(h, 1).T + np.diag(ridge)
            move = np.zeros(p + 1)
            g = np.asarray(row["__g"], dtype=float) + ridge * b
            move[use] = np.linalg.lstsq(h[np.ix_(use, use)] + 1e-12 * np.eye(len(use)), g[use], rcond=None)[0]
            small = float(np.max(np.abs(move))) < TOLERANCE
            apart = penalty == 0 and row["__loss"] < SEPARATED * row["__n"]
            last = b - move if small else b
            return out | {"best": last.tolist(), "loss": loss, "beta": (b - move).tolist(), "move": move.tolist(), "scale": 1.0, "done": small or apart, "converged": small and not apart}
        scale = row["scale"] / 2
        best, move = np.array(row["best"], dtype=float), np.array(row["move"], dtype=float)
        short = scale * float(np.max(np.abs(move))) < TOLERANCE
        return out | {"beta": (best - scale * move).tolist(), "scale": scale, "done": short, "converged": short}

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([advance(row) for row in pdf.to_dict("records")], columns=[f.name for f in schema.fields])

    by = [*keys, "name"]
    for _ in range(MAX_STEPS):
        j = O.join_groups(rows, state.where("NOT done").select(*by, "beta"), keys)
        s = _score(p)
        q = sigmoid(s)
        cost = F.log1p(F.exp(-F.abs(s))) + F.greatest(s, F.lit(0.0)) - s * F.col("label")
        j = j.select(*by, F.concat(F.array(F.lit(1.0)), "z").alias("x"), (q - F.col("label")).alias("__r"), (q * (1 - q)).alias("__w"), cost.alias("__c"))
        x = [F.get("x", F.lit(i)) for i in range(p + 1)]
        sums = j.groupBy(*by).agg(
            F.count("*").alias("__n"), F.sum("__c").alias("__loss"),
            *[F.sum(F.col("__r") * x[i]).alias(f"__g{i}") for i in range(p + 1)],
            *[F.sum(F.col("__w") * x[i] * x[k]).alias(f"__h{i}_{k}") for i, k in pairs],
        ).select(
            *by, "__n", "__loss", F.array(*[F.col(f"__g{i}") for i in range(p + 1)]).alias("__g"), F.array(*[F.col(f"__h{i}_{k}") for i, k in pairs]).alias("__h")
        )
        state = cut_lineage(O.join_groups(state, sums, by, "left").mapInPandas(update, schema))
        if state.where("NOT done").isEmpty():
            break
    return state.select(*by, F.col("best").alias("beta"), "converged")


def fit_predict(
    df: DataFrame, keys: Sequence[str], sets: dict[str, Sequence[str]], label: str, fit: str = "fit", score: str | None = None,
    penalty: float = 1.0, prefix: str = "p_", **kw,
) -> DataFrame:
    """Impute and scale by fit-row statistics, fit every set, add ``p_<set>`` to the scored rows."""
    columns = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    ready = standardise(df, keys, columns, fit, **kw)
    uses = {n: [columns.index(c) for c in cs] for n, cs in sets.items()}
    beta = newton(ready.where(fit).withColumn("label", F.col(label).cast("double")), keys, uses, len(columns), penalty)
    packed = beta.groupBy(*keys).agg(F.collect_list(F.struct("name", "beta")).alias("__models"))
    out = O.join_groups(ready if score is None else ready.where(score), packed, keys)
    for n in sets:
        m = F.get(F.filter("__models", _named(n)), F.lit(0))
        out = out.withColumn("beta", m["beta"]).withColumn(f"{prefix}{n}", sigmoid(_score(len(columns))))
    return out.drop("beta", "__models", "z")


def clipped_logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.when(p.isNotNull(), F.log(q / (1 - q)))  # the bounds alone would make a number of NULL


def calibrate(df: DataFrame, keys: Sequence[str], p: str, label: str, cal: str, out: str = "p_calibrated") -> DataFrame:
    """Monotone Platt map fitted on the calibration rows: sigmoid(a + b*logit(p)) with b >= 0.

    The loss is convex, so where the free slope is negative the bounded optimum has slope 0 and the
    calibration frequency as its constant. Groups without a finite optimum (one class, separable rows) get that constant
    too, with the frequency held half a row away from 0 and 1; ``cal_converged`` is false for them. Rows without a
    probability train nothing; groups without calibration rows that have one are left out.
    """
    rows = df.withColumn("__logit", clipped_logit(F.col(p)))
    train = rows.where(F.col(cal) & F.col("__logit").isNotNull()).select(*keys, F.array("__logit").alias("z"), F.col(label).cast("double").alias("label"))
    beta = newton(train, keys, {"platt": [0]}, 1, penalty=0.0)
    half = 0.5 / F.count("*")
    rate = train.groupBy(*keys).agg(F.greatest(half, F.least(1 - half, F.avg("label"))).alias("__rate"))
    ab = O.join_groups(beta, rate, keys)
    free = (F.get("beta", F.lit(1)) >= 0) & F.col("converged")
    ab = ab.select(
        *keys,
        F.when(free, F.get("beta", F.lit(0))).otherwise(F.log(F.col("__rate") / (1 - F.col("__rate")))).alias("cal_intercept"),
        F.when(free, F.get("beta", F.lit(1))).otherwise(0.0).alias("cal_slope"), F.col("converged").alias("cal_converged"),
    )
    j = O.join_groups(rows, ab, keys)
    return j.withColumn(out, sigmoid(F.col("cal_intercept") + F.col("cal_slope") * F.col("__logit"))).drop("__logit")


def alarm_cut(df: DataFrame, keys: Sequence[str], p: str, label: str, cal: str, q: float = 0.9, **kw) -> DataFrame:
    """Cut-off per group: quantile of the calibration negatives' probabilities."""
    negatives = df.where(F.col(cal) & ~F.col(label).cast("boolean"))
    return O.quantiles(negatives, keys, {"alarm_cut": (F.col(p), q)}, **kw)


def frequency_prior(df: DataFrame, keys: Sequence[str], label: str, fit: str = "fit") -> DataFrame:
    """Event frequency of the fit rows, the constant forecast."""
    return df.where(fit).groupBy(*keys).agg(F.avg(F.col(label).cast("double")).alias("p_fitting_frequency"))

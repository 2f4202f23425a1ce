"""Models per case: trees against a plain search, stopping, and independence of the cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrain.operators import case_trees as C


def plain_tree(x, g, h, leaves, least, l2):
    """Values of the rows under leaf-wise growth, by trying every threshold of every leaf."""
    parts, values = [np.arange(len(g))], np.zeros(len(g))
    worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
    while len(parts) < leaves:
        best = (1e-12, None)
        for k, rows in enumerate(parts):
            for j in range(x.shape[1]):
                for t in np.unique(x[rows, j])[:-1]:
                    a, b = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                    if min(len(a), len(b)) >= least:
                        gain = worth(a) + worth(b) - worth(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, (k, a, b))
        if best[1] is None:
            break
        k, a, b = best[1]
        parts[k : k + 1] = [a, b]
    for rows in parts:
        values[rows] = g[rows].sum() / (h[rows].sum() + l2)
    return values


@pytest.mark.parametrize("seed", range(6))
def test_trees_equal_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    x, g, h = rng.normal(size=(80, 3)).round(1), rng.normal(size=80), rng.uniform(0.1, 1, 80)
    codes, width = C.bin_codes(x, np.ones(80, dtype=bool))
    tree = C.grow(codes, np.arange(80), g, h, np.ones(80), width, 5, 1.0, lambda s: s[0] / (s[1] + 1.0), leaves=7)
    assert np.allclose(tree.predict(codes, width), plain_tree(x, g, h, 7, 5, 1.0))


def test_boosting_equals_plain_rounds_and_stops():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 2)).round(1)
    y = (x[:, 0] + 0.3 * rng.normal(size=160) > 0).astype(float)
    train = np.arange(160) < 100
    p, best = C.boosted(x, y, train, ~train, True, rounds=40, rate=0.3, leaves=4, least=5, l2=1.0, patience=3)
    score = np.full(100, np.log(y[train].mean() / (1 - y[train].mean())))
    for _ in range(best):
        q = 1 / (1 + np.exp(-score))
        score = score + 0.3 * plain_tree(x[train], y[train] - q, q * (1 - q), 4, 5, 1.0)
    assert 1 < best < 40 and np.allclose(p[train], 1 / (1 + np.exp(-score)))
    again, rounds = C.boosted(x, y, train, None, True, rounds=best, rate=0.3, leaves=4, least=5, l2=1.0)
    assert rounds == best and np.allclose(again, p)


def test_missing_values_and_unseen_ones_have_a_side():
    x = np.array([[np.nan], [np.nan], [1.0], [2.0], [3.0], [9.0]] * 10)
    y = np.array([1.0, 1.0, 0, 0, 0, 0] * 10)
    p, _ = C.boosted(x, y, np.ones(60, dtype=bool), None, False, rounds=50, rate=0.3, leaves=3, least=2, l2=0.0)
    assert np.allclose(p, y, atol=1e-3)


def rows_of_cases(spark):
    rng = np.random.default_rng(7)
    data = []
    for case, sign in (("a", 1), ("b", -1), ("one", 0), ("empty", 1)):
        for i in range(240):
            u, v = map(float, rng.normal(size=2))
            e = 1 if case == "one" else int(sign * u + 0.3 * rng.normal() > 0)
            data.append((case, i, [u, v], float(sign * u), e, i < 120 and case != "empty", 120 <= i < 180, i >= 180))
    return spark.createDataFrame(data, "case string, i int, x array<double>, y double, e int, fit boolean, val boolean, test boolean")


@pytest.mark.parametrize("family", ["boosted", "boosted_shallow", "forest"])
def test_each_case_has_its_own_model(spark, family):
    df = rows_of_cases(spark)
    few = {"trees": 30} if family == "forest" else {}
    got = C.fit_cases(df, ["case"], ["i"], "x", "e", family, validation=None if family == "forest" else "val", **few)
    by = {r.case: r for r in got.groupBy("case").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("e"), 2)).alias("brier"), F.min("p").alias("low"), F.count("p").alias("known")).collect()}
    assert {c: by[c].n for c in by} == {"a": 60, "b": 60, "one": 60, "empty": 60}
    assert by["a"].brier < 0.15 and by["b"].brier < 0.15 and by["one"].low == 1.0 and (by["empty"].known == 0 or np.isnan(by["empty"].low))
    alone = C.fit_cases(df.where("case = 'b'").repartition(3), ["case"], ["i"], "x", "e", family, validation=None if family == "forest" else "val", **few)
    assert sorted((r.i, r.p) for r in alone.collect()) == sorted((r.i, r.p) for r in got.where("case = 'b'").collect())


def test_regression_and_refit(spark):
    df = rows_of_cases(spark)
    p = C.fit_cases(df, ["case"], ["i"], "x", "y", "regression").where("case IN ('a', 'b')")
    assert p.agg(F.corr("p", "y")).first()[0] > 0.8  # three leaves of forty rows, for opposite signs in the two cases
    both = df.withColumn("all", F.col("fit") | F.col("val"))
    first = C.fit_cases(both, ["case"], ["i"], "x", "e", "boosted", validation="val", refit="all").where("case = 'a'").collect()
    rounds = {r.best_iteration for r in first}
    direct = C.fit_cases(both, ["case"], ["i"], "x", "e", "boosted", train="all", rounds=rounds.pop()).where("case = 'a'").collect()
    assert not rounds and sorted((r.i, r.p) for r in first) == sorted((r.i, r.p) for r in direct)

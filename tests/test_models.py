"""Fits against plain numpy on small inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrain.operators import linear as L, logistic as G, metrics as M, proxy as Y, trees as T


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 400
    x = rng.normal(size=(n, 3)) * [1.0, 20.0, 0.01] + [5.0, 1000.0, 0.3]
    x[rng.random(x.shape) < 0.05] = np.nan
    base = np.nan_to_num((x - np.nanmean(x, 0)) / np.nanstd(x, 0))
    y = base @ [0.5, -1.0, 0.3] + rng.normal(size=n) + 7
    site = np.array(["a", "b"])[(np.arange(n) % 4 == 0).astype(int)]
    fit = np.arange(n) % 5 < 3
    return x, y, site, fit


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y, site, fit = data
    rows = [
        (str(s), i, *[None if np.isnan(v) else float(v) for v in r], None, float(t), bool(f), not f, int(t > 7))
        for i, (s, r, t, f) in enumerate(zip(site, x, y, fit))
    ]
    return spark.createDataFrame(rows, "site string, i int, x1 double, x2 double, x3 double, gone double, y double, fit boolean, test boolean, e int").cache()


def prepared(data, s, cols):
    x, y, site, fit = data
    m = site == s
    z = x[m][:, cols].copy()
    f = fit[m]
    med = np.nanmedian(z[f], axis=0)
    z = np.where(np.isnan(z), med, z)
    z = (z - z[f].mean(0)) / z[f].std(0)
    return z, y[m], f


def test_ridge_matches_closed_form(data, frame):
    sets = {"one": ["x1"], "all": ["x1", "x2", "x3", "gone"]}
    p = L.fit_predict(frame, ["site"], sets, "y", (1.0, 10.0)).orderBy("i").collect()
    for s in "ab":
        mine = [r for r in p if r.site == s]
        for name, cols in (("one", [0]), ("all", [0, 1, 2])):
            z, y, f = prepared(data, s, cols)
            for a in (1.0, 10.0):
                b = np.linalg.solve(z[f].T @ z[f] + a * np.eye(len(cols)), z[f].T @ (y[f] - y[f].mean()))
                want = y[f].mean() + z[~f] @ b
                assert [r[f"p_{name}@{a:g}"] for r in mine] == pytest.approx(list(want), abs=1e-9)


def logistic_reference(z, e, penalty):
    a = np.c_[np.ones(len(z)), z]
    b = np.zeros(a.shape[1])
    ridge = penalty * np.r_[0.0, np.ones(z.shape[1])]
    for _ in range(100):
        q = 1 / (1 + np.exp(-a @ b))
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + np.diag(ridge) + 1e-12 * np.eye(len(b)), a.T @ (q - e) + ridge * b)
        b -= step
    return b


def test_grouped_logistic_matches_newton(data, frame):
    sets = {"one": ["x2"], "all": ["x1", "x2", "x3"]}
    p = G.fit_predict(frame, ["site"], sets, "e", score="test").orderBy("i").collect()
    for s in "ab":
        mine = [r for r in p if r.site == s]
        for name, cols in (("one", [1]), ("all", [0, 1, 2])):
            z, y, f = prepared(data, s, cols)
            b = logistic_reference(z[f], (y[f] > 7).astype(float), 1.0)
            want = 1 / (1 + np.exp(-(b[0] + z[~f] @ b[1:])))
            assert [r[f"p_{name}"] for r in mine] == pytest.approx(list(want), abs=1e-8)


def test_wide_logistic_has_the_same_optimum(data, frame, spark):
    z, y, f = prepared(data, "a", [0, 1, 2])
    rows = spark.createDataFrame([(i, r.tolist(), float(t > 7), bool(g)) for i, (r, t, g) in enumerate(zip(z, y, f))], "i int, x array<double>, e double, fit boolean")
    p = [r.p for r in T.wide_logistic(rows.where("fit"), rows.where("NOT fit"), "x", "e").orderBy("i").collect()]
    b = logistic_reference(z[f], (y[f] > 7).astype(float), 1.0)
    assert p == pytest.approx(list(1 / (1 + np.exp(-(b[0] + z[~f] @ b[1:])))), abs=1e-6)


def test_calibration_slope_is_never_negative(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g, sign in (("up", 1), ("down", -1)):
        for i in range(300):
            p = float(rng.uniform(0.05, 0.95))
            rows.append((g, i, p, int(rng.random() < (p if sign > 0 else 1 - p)), i < 200))
    df = spark.createDataFrame(rows, "g string, i int, p double, e int, cal boolean")
    got = {r.g: r for r in G.calibrate(df, ["g"], "p", "e", "cal").dropDuplicates(["g"]).collect()}
    assert got["up"].cal_slope > 0.5
    rate = np.mean([e for g, _, _, e, c in rows if g == "down" and c])
    assert got["down"].cal_slope == 0 and got["down"].p_calibrated == pytest.approx(rate)
    up = [(p, e) for g, _, p, e, c in rows if g == "up" and c]
    z = np.log([p / (1 - p) for p, _ in up])[:, None]
    b = logistic_reference(z, np.array([e for _, e in up], float), 0.0)
    assert (got["up"].cal_intercept, got["up"].cal_slope) == pytest.approx(tuple(b), abs=1e-6)


def test_early_stopping_rule():
    assert T.best_iteration([5, 4, 3, 3.5, 3.6, 2.0], patience=2) == 3
    assert T.best_iteration([5, 4, 3, 3.5, 2.0, 2.5], patience=2) == 5
    assert T.best_iteration([1.0]) == 1


def test_out_of_fold_proxies_use_only_earlier_rows(spark):
    t0 = dt.datetime(2020, 1, 1)
    rows = [("s", t0 + dt.timedelta(hours=6 * i), float(i % 13), float(i % 7), True) for i in range(200)]
    df = spark.createDataFrame(rows, "site string, timestamp timestamp_ntz, x double, y double, ok boolean").withColumn("cut", F.lit(t0 + dt.timedelta(days=40)).cast("timestamp_ntz"))
    p = {r.timestamp: r.proxy_m for r in Y.out_of_fold(df, "site", "timestamp", "cut", {"m": ["x"]}, "y", "ok").collect()}
    assert min(p) == t0 + dt.timedelta(days=8) and max(p) < t0 + dt.timedelta(days=40) and len(p) == 128
    # the first scored segment equals a ridge fit on the eight days before it
    fit = [(r[2], r[3]) for r in rows if r[1] < t0 + dt.timedelta(days=8)]
    x, y = np.array(fit).T
    b = ((x - x.mean()) @ (y - y.mean())) / x.std() / (len(x) + 10)
    first = rows[32]
    assert p[first[1]] == pytest.approx(y.mean() + b * (first[2] - x.mean()) / x.std())


def test_boosted_models_beat_the_constant(frame):
    d = frame.withColumn("f", F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in ("x1", "x2", "x3")]))
    p, best = T.boosted_classification(d.where("fit"), d.where("test AND i % 2 = 0"), d.where("test AND i % 2 = 1"), "f", "e", maxIter=8, stepSize=0.1, minInstancesPerNode=5, patience=3)
    s = M.probability_scores(p.withColumn("prior", F.lit(0.5)), [], "e", "p", "prior").first()
    assert 1 <= best <= 8 and s.brier_skill > 0


def test_logistic_fits_without_a_finite_optimum_say_so(spark):
    rows = [("apart", [i / 10 - 5.05], float(i >= 50)) for i in range(100)] + [("one", [float(i)], 1.0) for i in range(20)]
    rows += [("fine", [i / 10 - 5.0], float(i % 3 == 0 or i > 70)) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, z array<double>, label double")
    got = {r.g: r for r in G.newton(df, ["g"], {"m": [0]}, 1, penalty=0.0).collect()}
    assert {g: r.converged for g, r in got.items()} == {"apart": False, "one": False, "fine": True}
    x = np.array([[1.0, z[0]] for g, z, _ in rows if g == "fine"])
    y = np.array([v for g, _, v in rows if g == "fine"])
    assert np.abs(x.T @ (1 / (1 + np.exp(-x @ np.array(got["fine"].beta))) - y)).max() < 1e-6
    p = df.select("g", "label", (0.5 + 0.09 * df.z[0]).alias("p"))
    cal = G.calibrate(p.where("g != 'one'").withColumn("cal", p.g.isNotNull()), ["g"], "p", "label", "cal").collect()
    assert all(r.cal_slope >= 0 and 0 < r.p_calibrated < 1 for r in cal) and {r.cal_converged for r in cal if r.g == "fine"} == {True}

"""Model fits and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrain.functions import scalars as S, spectra as P
from hourgrain.operators import align as A, case_trees as CT, cohort as C, linear as L, logistic as G, metrics as M, ordering as O, preparation as Z, proxy as Y, trees as T_
from hourgrain.plans.q_align import daily_split, labelled_daily, lead_rows, partitioned
from hourgrain.plans.q_spectra import rounded
from hourgrain.plans.registry import CTES, query, sql
from hourgrain.session import cut_lineage
from hourgrain.sources.views import AXIS, GRID, Tables

# daily rows with two predictors, some of them missing, and the logged value as target
CTES["dx"] = (("dfit",), """SELECT *, ln(1 + value) AS y, CASE WHEN dayofyear(timestamp) % 11 = 0 THEN NULL ELSE sin(2 * pi() * dayofyear(timestamp) / 365.25::DOUBLE) END AS x1,
    CASE WHEN n_rows % 5 = 0 THEN NULL ELSE ln(1 + n_rows) END AS x2 FROM (SELECT d.*, s.n AS n_rows FROM dfit d JOIN daily s USING (site, timestamp))""")
CTES["dz"] = (("dx",), """SELECT d.*, coalesce(x1, m1) AS i1, coalesce(x2, m2) AS i2 FROM dx d JOIN
    (SELECT site, median(x1) AS m1, median(x2) AS m2 FROM dx WHERE fit GROUP BY site) USING (site)""")
CTES["ds"] = (("dz",), """SELECT site, count(*) AS nf, avg(y) AS my, avg(i1) AS a1, avg(i2) AS a2, stddev_pop(i1) AS s1, stddev_pop(i2) AS s2,
    covar_pop(i1, y) / stddev_pop(i1) AS c1, covar_pop(i2, y) / stddev_pop(i2) AS c2, corr(i1, i2) AS r FROM dz WHERE fit GROUP BY site""")


def ridge_sql(alpha) -> str:
    """Closed form of two-predictor ridge on standardised inputs."""
    d = f"((nf + {alpha}) ** 2 - (nf * r) ** 2)"
    b1 = f"((nf + {alpha}) * nf * c1 - nf * r * nf * c2) / {d}"
    b2 = f"((nf + {alpha}) * nf * c2 - nf * r * nf * c1) / {d}"
    return f"my + {b1} * (i1 - a1) / s1 + {b2} * (i2 - a2) / s2"


def daily_inputs(t: Tables):
    doy = F.dayofyear("timestamp")
    return daily_split(t).withColumn("y", F.log1p("value")).withColumn(
        "x1", F.when(doy % 11 != 0, F.sin(F.lit(6.283185307179586) * doy / F.lit(365.25)))
    ).withColumn("x2", F.when(F.col("n") % 5 != 0, F.log1p("n")))


@query("mdl01_median_imputation", sql("dz", "SELECT site, timestamp, round(i1, 6) AS i1, round(i2, 6) AS i2 FROM dz"))
def median_imputation(t: Tables):
    d = daily_inputs(t)
    j = O.join_groups(d, Z.fit_medians(d, ["site"], ["x1", "x2"]), ["site"])
    i = [F.coalesce(F.col(c), F.get("medians", F.lit(k))) for k, c in enumerate(("x1", "x2"))]
    return rounded(j.select("site", "timestamp", i[0].alias("i1"), i[1].alias("i2")))


@query("mdl02_standardise", sql("dz ds", "SELECT site, timestamp, round((i1 - a1) / s1, 6) AS z1, round((i2 - a2) / s2, 6) AS z2 FROM dz JOIN ds USING (site)"))
def standardise(t: Tables):
    z = Z.standardise(daily_inputs(t), ["site"], ["x1", "x2"])
    return rounded(z.select("site", "timestamp", F.get("z", F.lit(0)).alias("z1"), F.get("z", F.lit(1)).alias("z2")))


@query(
    "mdl03_ridge",
    sql("dz ds", f"""SELECT site, timestamp, round(y, 6) AS y, round(my + nf * c1 / (nf + 10) * (i1 - a1) / s1, 6) AS p_one, round({ridge_sql(10)}, 6) AS p_two, nf AS n_fit
      FROM dz JOIN ds USING (site) WHERE test"""),
)
def ridge(t: Tables):
    p = L.fit_predict(daily_inputs(t), ["site"], {"one": ["x1"], "two": ["x1", "x2"]}, "y")
    return rounded(p.select("site", "timestamp", "y", "p_one", "p_two", "n_fit"))


CTES["l3"] = (("leads",), "SELECT *, ln(1 + future) AS y, ln(1 + total) AS i1, f82 AS i2 FROM leads WHERE lead_h IN (1, 3, 6)")


@query(
    "evl08_paired_gain_ridge",
    sql("l3", f"""SELECT site, lead_h, count(*) AS n, round((1 - sum((y - p0) ** 2) / (var_pop(y) * count(*))), 6) AS r2_base,
      round((1 - sum((y - p1) ** 2) / (var_pop(y) * count(*))), 6) AS r2_added,
      round((1 - sum((y - p1) ** 2) / (var_pop(y) * count(*))) - (1 - sum((y - p0) ** 2) / (var_pop(y) * count(*))), 6) AS delta_r2,
      round(avg(abs(exp(y) - exp(p0)) - abs(exp(y) - exp(p1))), 6) AS mae_reduction FROM
      (SELECT site, lead_h, y, my + nf * c1 / (nf + 10) * (i1 - a1) / s1 AS p0, {ridge_sql(10)} AS p1 FROM l3 JOIN s USING (site, lead_h) WHERE test) GROUP BY site, lead_h""",
      s="""SELECT site, lead_h, count(*) AS nf, avg(y) AS my, avg(i1) AS a1, avg(i2) AS a2, stddev_pop(i1) AS s1, stddev_pop(i2) AS s2, covar_pop(i1, y) / stddev_pop(i1) AS c1,
        covar_pop(i2, y) / stddev_pop(i2) AS c2, corr(i1, i2) AS r FROM l3 WHERE fit GROUP BY site, lead_h"""),
)
def paired_gain_ridge(t: Tables):
    """Flagship: does adding the size fraction improve the +1, +3 and +6 h prediction at each site?"""
    rows = lead_rows(t, (1, 3, 6)).withColumn("y", F.log1p("future")).withColumn("log_total", F.log1p("total"))
    p = L.fit_predict(rows, ["site", "lead_h"], {"total": ["log_total"], "size": ["log_total", "f82"]}, "y")
    return rounded(M.paired_regression_gain(p, ["site", "lead_h"], "y", "p_total", "p_size"))


def block_cases(t: Tables):
    """Day rows stand in for blocks: fit / calibration / test by date, high label by month."""
    d = labelled_daily(t).join(daily_inputs(t).select("site", "timestamp", "y", "x1", "x2"), ["site", "timestamp"])
    cal = F.col("fit") & (F.year("timestamp") >= 2000)
    return cut_lineage(d.withColumn("cal", cal).withColumn("fit", F.col("fit") & ~cal).withColumn("event", F.col("high").cast("int")))


SETS = {"calendar": ["x1"], "calendar_n": ["x1", "x2"]}


@query("mdl04_logistic")
def logistic(t: Tables):
    p = G.fit_predict(block_cases(t), ["site"], SETS, "event", score="test")
    return rounded(p.select("site", "timestamp", "event", "p_calendar", "p_calendar_n"))


@query(
    "mdl05_penalty_sweep",
    sql("dz ds", "\nUNION ALL ".join(f"""SELECT site, {a}::DOUBLE AS alpha, count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2_log,
      round(avg(abs(y - p)), 6) AS mae_log FROM (SELECT site, y, {ridge_sql(a)} AS p FROM dz JOIN ds USING (site) WHERE test) GROUP BY site""" for a in (1, 10, 100))),
)
def penalty_sweep(t: Tables):
    alphas = (1.0, 10.0, 100.0)
    p = L.fit_predict(daily_inputs(t), ["site"], {"two": ["x1", "x2"]}, "y", alphas)
    from hourgrain.operators.ranking import melt

    long = melt(p, ["site", "y"], {f"{a:g}": f"p_two@{a:g}" for a in alphas}, "alpha").withColumn("alpha", F.col("alpha").cast("double"))
    s = M.regression_scores(long, ["site", "alpha"], "y", "p")
    return rounded(s.select("site", "alpha", "n", "r2_log", "mae_log"), "alpha")


def features(df, *cols):
    return df.withColumn("features", F.array(*[F.col(c).cast("double") for c in cols]))


@query("mdl06_boosted_regression")
def boosted_regression(t: Tables):
    p = CT.fit_cases(features(daily_inputs(t), "x1", "x2", "month"), ["site"], ["timestamp"], "features", "y", "regression")
    return M.regression_scores(p, ["site"], "y", "p")


@query("mdl07_boosted_classification")
def boosted_classification(t: Tables):
    p = CT.fit_cases(features(block_cases(t), "x1", "x2", "month"), ["site"], ["timestamp"], "features", "event", "boosted", validation="cal")
    return M.probability_scores(p, ["site", "best_iteration"], "event", "p")


@query("mdl08_random_forest")
def random_forest(t: Tables):
    p = CT.fit_cases(features(block_cases(t), "x1", "x2", "month"), ["site"], ["timestamp"], "features", "event", "forest")
    return M.probability_scores(p, ["site"], "event", "p")


def histories(t: Tables):
    """Blocks with complete six-step histories of N, N82, f82 and the 24 fractions at origin +3 h."""
    d = F.col("density")
    h = t.spectra().select("timestamp", P.regrid(d, AXIS, GRID).alias("bins")).where("bins IS NOT NULL")
    h = h.select(
        F.lit(1).alias("any"), "timestamp", F.log1p(P.array_sum(F.col("bins"))).alias("n"), F.log1p(P.count_above(F.col("bins"), GRID, 82.0)).alias("n82"),
        P.fraction_above(F.col("bins"), GRID, 82.0).alias("f82"), P.bin_fractions(F.col("bins")).alias("fr"),
    )
    b = A.six_hour_blocks(t.good_hourly()).where("n_valid >= 4").withColumn("origin", F.col("block_start") - S.hours_interval(3)).withColumn("any", F.lit(1))
    out = A.history(b, h, ["site", "block_start", "any"], ["n", "n82", "f82", "fr"], key="any").where("history_complete")
    return out.withColumn("calendar", F.array(*S.calendar_angles(F.col("block_start")).values()))


REPRESENTATIONS = ("N", "N82", "N_plus_f82", "full24")


def feature_column(r: str, c: str):
    return Z.history_features(r, c, F.col("calendar"), F.col("n_history"), F.col("n82_history"), F.col("f82_history"), F.col("fr_history"))


@query(
    "mdl09_predictor_sets",
    sql("blocks mapped grid", """SELECT site, block_start, 6::BIGINT AS w_current, 16::BIGINT AS w_history, 29::BIGINT AS w_full,
      round(sum(ln(1 + n)) + sum(f), 5) AS sum_history, round(max(ln(1 + n)) FILTER (WHERE k = 0) + 1, 5) AS sum_full FROM
      (SELECT b.site, b.block_start, k, h.n, h.f FROM (SELECT *, unnest(range(6)) AS k FROM blocks WHERE n_valid >= 4) b JOIN h ON h.timestamp = b.block_start - to_hours(3 + k))
      GROUP BY site, block_start HAVING count(*) = 6""",
      h="""SELECT any_value(timestamp) AS timestamp, sum(b) AS n, sum(b * greatest(0, least(1, (hi - greatest(lo, log10(82::DOUBLE))) / (hi - lo)))) / sum(b) AS f
        FROM mapped JOIN grid USING (k) GROUP BY vec_id HAVING count(b) = 24"""),
)
def predictor_sets(t: Tables):
    h = histories(t)
    cur, his, full = feature_column("N_plus_f82", "current"), feature_column("N_plus_f82", "history6"), feature_column("full24", "current")
    particle = lambda a: P.array_sum(F.slice(a, 5, 1000))
    size = lambda a: F.size(a).cast("bigint")
    return h.select(
        "site", "block_start", size(cur).alias("w_current"), size(his).alias("w_history"), size(full).alias("w_full"),
        F.round(particle(his), 5).alias("sum_history"), F.round(particle(full), 5).alias("sum_full"),
    )


@query(
    "mdl10_identity_predictors",
    sql("l3", """SELECT site, lead_h, count(*) AS n, round(1 - sum((y - ln(1 + now)) ** 2) / (var_pop(y) * count(*)), 6) AS r2_current, round(1 - sum((y - ln(1 + n82)) ** 2) / (var_pop(y) * count(*)), 6) AS r2_n82
      FROM l3 WHERE test AND now_ok GROUP BY site, lead_h"""),
)
def identity_predictors(t: Tables):
    r = lead_rows(t, (1, 3, 6)).where("test AND now_ok").withColumn("y", F.log1p("future"))
    y = F.col("y")
    return rounded(r.groupBy("site", "lead_h").agg(F.count("*").alias("n"), M.r2(y, F.log1p("now")).alias("r2_current"), M.r2(y, F.log1p("n82")).alias("r2_n82")))


CTES["cases"] = (("dfit", "dth"), """SELECT d.site, d.timestamp, d.value, d.month, d.fit AND year(d.timestamp) < 2000 AS fit, d.fit AND year(d.timestamp) >= 2000 AS cal, d.test,
    coalesce(t.supported AND d.value >= t.high_threshold, false)::INT AS event FROM dfit d LEFT JOIN dth t USING (site, month)""")


@query("mdl11_frequency_prior", sql("cases", "SELECT site, round(avg(event) FILTER (WHERE fit), 6) AS p_fitting_frequency FROM cases GROUP BY site"))
def frequency_prior(t: Tables):
    return rounded(G.frequency_prior(block_cases(t), ["site"], "event"))


def site_hours(t: Tables):
    """Hours with a spectrum, the concurrent target and the cut, plus predictors."""
    h = t.hourly_spectra().where("total > 0").select("timestamp", "density", "total", "n82", "f82")
    from hourgrain.operators.spectrum import extend_range

    h = extend_range(h, "density", AXIS).drop("density")
    cut = C.date_fraction_cut(t.observations(), "site", "timestamp", 0.7).drop("n_days")
    o = t.hourly().join(h, "timestamp").join(cut, "site")
    o = o.withColumn("y0", F.log1p(F.when(F.col("instrument_ok"), F.col("target")))).withColumn("eligible0", F.col("y0").isNotNull())
    o = o.withColumn("usable", F.lit(True)).withColumn("log_total", F.log1p("total")).withColumn("log_n82", F.log1p("n82"))
    o = o.withColumn("log_total_ext", F.log1p("total_ext")).withColumn("log_n82_ext", F.log1p("n82_ext"))
    a = S.calendar_angles(F.col("timestamp"))
    return cut_lineage(o.withColumn("sin_hour", a["sin_hour"]).withColumn("cos_hour", a["cos_hour"]))


CAL = ["sin_hour", "cos_hour"]
HSETS = {"total": [*CAL, "log_total"], "total_plus_f82": [*CAL, "log_total", "f82"], "N82": [*CAL, "log_n82"]}
HSETS_EXT = {"total": [*CAL, "log_total_ext"], "total_plus_f82": [*CAL, "log_total_ext", "f82_ext"], "N82": [*CAL, "log_n82_ext"]}


def lead_hours(t: Tables, leads, hours=None):
    h = site_hours(t) if hours is None else hours
    e = A.exact_lead(h, t.hourly(), "site", leads, {"target": "future", "instrument_ok": "future_ok"})
    ok = S.usable_value(F.col("future")) & S.known_true(F.col("future_ok"))
    e = e.withColumn("y", F.when(ok, F.log1p("future")))
    fit, test = C.hourly_split(F.col("timestamp"), F.col("lead_h"), ok, F.col("cut"))
    return cut_lineage(e.withColumn("fit", fit).withColumn("test", test))


def proxy_predictions(t: Tables, leads=(1, 3, 6)):
    h = site_hours(t)
    p = Y.proxies(h, "site", "timestamp", "cut", HSETS, "y0", "eligible0", "usable")
    rows = lead_hours(t, leads, h).join(p, ["site", "timestamp"], "left")
    return Y.transition_routes(rows, ["site", "lead_h"], HSETS, CAL, "y")


ROUTES = ("persistence", "direct_full", "direct_matched", "transition")


@query("mdl12_proxy_persistence")
def proxy_persistence(t: Tables):
    from hourgrain.operators.ranking import melt

    p = proxy_predictions(t)
    long = melt(p, ["site", "lead_h", "y"], {f"{r}_{n}": f"{r}_{n}" for r in ROUTES for n in HSETS})
    return M.regression_scores(long, ["site", "lead_h", "model"], "y", "p")


def block_rows(t: Tables, leads=(1, 3, 6), hours=None):
    """Blocks with origin predictors, chronological partitions and month labels (pooled over the short month)."""
    from hourgrain.operators import labels as LB

    o = cut_lineage(partitioned(t).where("n_valid >= 4 AND origin_valid")).where(F.col("lead_h").isin(list(leads)))
    th = LB.month_thresholds(o.where("partition = 'fit' AND lead_h = 3"), ["site"], "mean_value", "block_start", at_least=20)
    b = LB.with_thresholds(o, th, ["site"]).where("high_threshold IS NOT NULL")
    b = b.withColumn("event", LB.is_high(F.col("mean_value"), F.col("high_threshold")).cast("int"))
    a = S.calendar_angles(F.col("block_start"))
    for n, c in a.items():
        b = b.withColumn(n, c)
    b = b.withColumn("log_total", F.log1p("total")).withColumn("log_n82", F.log1p("n82"))
    for flag, name in (("fit", "fit"), ("cal", "calibration"), ("test", "test")):
        b = b.withColumn(flag, F.coalesce(F.col("partition") == name, F.lit(False)))
    return cut_lineage(b)


BCAL = ["sin_hour", "cos_hour", "sin_year", "cos_year"]
BSETS = Z.predictor_sets(BCAL, "log_total", "log_n82", "f82")


@query("mdl13_block_proxy")
def block_proxy(t: Tables):
    """Second-stage classifier of the proxy at the block origin, and ranking by the carried proxy."""
    from hourgrain.operators.ranking import melt

    h = site_hours(t)
    p = Y.proxies(h, "site", "timestamp", "cut", HSETS, "y0", "eligible0", "usable").withColumnRenamed("timestamp", "origin")
    b = cut_lineage(block_rows(t).join(p, ["site", "origin"], "left"))
    names = {n: [*BCAL, f"proxy_{n}"] for n in HSETS}
    b = b.withColumn("matched", F.col("fit") & F.col("proxy_total").isNotNull())
    q = G.fit_predict(b, ["site", "lead_h"], names, "event", fit="matched", score="test")
    long = melt(q, ["site", "lead_h", "event"], {**{f"transition_{n}": f"p_{n}" for n in HSETS}, **{f"ranking_{n}": f"proxy_{n}" for n in HSETS}})
    ap = M.average_precision(long.where("p IS NOT NULL"), ["site", "lead_h", "model"], "event", "p")
    n = long.groupBy("site", "lead_h", "model").agg(F.count("p").alias("n"))
    return ap.join(n, ["site", "lead_h", "model"])


@query("mdl14_platt_calibration")
def platt(t: Tables):
    p = G.fit_predict(block_cases(t), ["site"], SETS, "event")
    c = G.calibrate(p, ["site"], "p_calendar_n", "event", "cal").where("test")
    return rounded(c.select("site", "timestamp", "event", "p_calendar_n", "p_calibrated", "cal_intercept", "cal_slope"))


@query(
    "mdl15_alarm_cut",
    sql("cases", """SELECT c.site, round(cut, 6) AS alarm_cut, count(*) FILTER (WHERE p > cut AND event = 1) AS hits, count(*) FILTER (WHERE NOT p > cut AND event = 1) AS misses,
      count(*) FILTER (WHERE p > cut AND event = 0) AS false_alarms FROM (SELECT *, (dayofyear(timestamp) * 37 % 101) / 101 AS p FROM cases) c JOIN
      (SELECT site, quantile_cont((dayofyear(timestamp) * 37 % 101) / 101, 0.9) AS cut FROM cases WHERE cal AND event = 0 GROUP BY site) USING (site) WHERE test GROUP BY c.site, cut"""),
)
def alarm_cut(t: Tables):
    c = block_cases(t).withColumn("p", (F.dayofyear("timestamp") * 37 % 101) / 101)
    cut = G.alarm_cut(c, ["site"], "p", "event", "cal")
    rows = O.join_groups(c.where("test"), cut, ["site"]).withColumn("alarm", F.col("p") > F.col("alarm_cut"))
    return rounded(M.alarm_counts(rows, ["site", "alarm_cut"], "event", "alarm").drop("false_alarm_rate"))


@query(
    "mdl16_slope_ratio",
    sql("dz ds", """SELECT site, round(slope, 6) AS slope, round(q25, 6) AS fit_q25, round(q75, 6) AS fit_q75, round(exp(slope * (q75 - q25)), 6) AS ratio_q75_q25 FROM
      (SELECT site, nf * c1 / (nf + 10) / s1 AS slope FROM ds) JOIN (SELECT site, quantile_cont(x1, 0.25) AS q25, quantile_cont(x1, 0.75) AS q75 FROM dx WHERE fit GROUP BY site) USING (site)"""),
)
def slope_ratio(t: Tables):
    d, sets = daily_inputs(t), {"one": ["x1"]}
    return rounded(L.slope_table(L.ridge_fit(d, ["site"], sets, "y"), d, ["site"], sets, "one", "x1"))


def range_comparison(t: Tables, leads=(1, 3, 6)):
    """300 nm against 500 nm predictors on the rows that have both."""
    rows = C.matched_rows(lead_hours(t, leads), ["total_ext", "f82_ext"])
    sets = {**{f"{n}_300": c for n, c in HSETS.items()}, **{f"{n}_500": c for n, c in HSETS_EXT.items()}}
    return L.fit_predict(rows, ["site", "lead_h"], sets, "y"), list(sets)


@query("mdl17_range_comparison")
def range_comparison_scores(t: Tables):
    from hourgrain.operators.ranking import melt

    p, names = range_comparison(t)
    long = melt(p, ["site", "lead_h", "y"], {n: f"p_{n}" for n in names})
    return M.regression_scores(long, ["site", "lead_h", "model"], "y", "p")

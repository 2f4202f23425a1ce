"""Whole studies on the stand-in views."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrain.functions import scalars as S, spectra as P
from hourgrain.operators import align as A, cohort as C, labels as LB, spectrum as X
from hourgrain.plans import studies as ST
from hourgrain.plans.q_align import cuts, origins
from hourgrain.plans.q_models import CAL, HSETS, HSETS_EXT, feature_column, histories, site_hours
from hourgrain.plans.q_scores import CONTRAST, INST, R2, TIES, draws_sql, events
from hourgrain.plans.q_spectra import rounded
from hourgrain.plans.registry import query, sql
from hourgrain.session import cut_lineage
from hourgrain.sources.views import AXIS, GRID, Tables

DRAWS = 50
SITES = ("click", "error", "purchase", "signup", "view")


def site_array():
    return F.array(*[F.lit(s) for s in SITES])


def out(tables, **keys):
    return ST.report({n: (tables[n], k) for n, k in keys.items()})


def smooth(t: Tables):
    """The stand-in spectra with missing channels filled and a floor added, so that audits can pass."""
    s = t.spectra().withColumn("density", F.transform("density", lambda v: F.coalesce(v, F.lit(0.0)) * 0.01 + 500.0))
    return s.withColumn("site", F.explode(site_array())).withColumn("seq", F.col("vec_id")).withColumn(
        "supplied_total", P.full_integral(F.col("density"), AXIS, "dndlog10dp")
    ).withColumn("spectrum_ok", F.lit(True))


@query("pip01_prepare_archive")
def prepare_archive(t: Tables):
    target = t.hourly().withColumn("closure_ok", F.col("n") % 2 == 0)
    r = ST.prepare_archive(smooth(t), target, AXIS, GRID)
    return out(r, audit=["site"], agreement=["site"], support=["site", "status"])


def lead_rows(t: Tables, leads):
    return ST.lead_table(site_hours(t), t.hourly(), leads)


@query("pip02_lead_sweep")
def lead_sweep(t: Tables):
    r = ST.lead_sweep(lead_rows(t, range(1, 25)), [*CAL, "log_total"], 60, 40, DRAWS)
    return out(r, support=["site", "lead_h", "status"], scores=["site", "lead_h", "model"], gains=["site", "lead_h", "cohort"])


@query(
    "pip03_seasonal_replay",
    sql("ev", f"""SELECT t.*, round(q.lo, 6) AS delta_r2_lo95, round(q.hi, 6) AS delta_r2_hi95, round(q.mlo, 6) AS mae_gain_lo95, round(q.mhi, 6) AS mae_gain_hi95, q.n_blocks FROM
      (SELECT k.site, s.season, count(e.site) AS n_rows, count(DISTINCT e.block_start::DATE) AS n_days, count(DISTINCT e.ym) AS n_months,
        round({R2.format(p='p0')}, 6) AS r2_base, round({R2.format(p='p1')}, 6) AS r2_added, round({R2.format(p='p1')} - {R2.format(p='p0')}, 6) AS delta_r2,
        round(avg(abs(exp(y) - exp(p0))), 6) AS mae_base, round(avg(abs(exp(y) - exp(p1))), 6) AS mae_added,
        round(avg(abs(exp(y) - exp(p0)) - abs(exp(y) - exp(p1))), 6) AS mae_gain, count(e.site) >= 100 AND count(DISTINCT e.block_start::DATE) >= 30 AS supported
        FROM (SELECT DISTINCT site FROM ev) k CROSS JOIN (SELECT unnest(['DJF','MAM','JJA','SON']) AS season) s LEFT JOIN ev e ON e.site = k.site AND e.season = s.season GROUP BY k.site, s.season) t
      JOIN (SELECT gk, quantile_cont(g, 0.025) AS lo, quantile_cont(g, 0.975) AS hi, quantile_cont(m, 0.025) AS mlo, quantile_cont(m, 0.975) AS mhi,
        (SELECT max(nb) FROM ix WHERE ix.gk = v.gk) AS n_blocks FROM v GROUP BY gk) q ON q.gk = t.site || '/' || t.season""",
        src="SELECT *, site || '/' || season AS gk FROM ev", **draws_sql("src", "gk", "week", 270928, DRAWS),
        v="""SELECT gk, draw, (sum(e0) - sum(e1)) / (sum(sy2) - sum(sy) ** 2 / sum(n)) AS g, sum(mg) / sum(n) AS m FROM dr JOIN
          (SELECT gk, week, count(*) AS n, sum(y) AS sy, sum(y * y) AS sy2, sum((y - p0) ** 2) AS e0, sum((y - p1) ** 2) AS e1, sum(abs(exp(y) - exp(p0)) - abs(exp(y) - exp(p1))) AS mg
           FROM src GROUP BY gk, week) USING (gk, week) GROUP BY gk, draw"""),
)
def seasonal_replay(t: Tables):
    return rounded(ST.seasonal_replay(t.predictions(), ["site"], "block_start", "y", "p0", "p1", draws=DRAWS))


def study_blocks(t: Tables):
    """Blocks x leads with predictors, cuts and month thresholds from the fit period."""
    o = cut_lineage(origins(t))
    b = o.join(cuts(t, o), "site")
    fit = b.where("lead_h = 3 AND n_valid >= 4 AND origin_valid AND block_end <= cal_cut")
    th = LB.month_thresholds(fit, ["site"], "mean_value", "block_start", at_least=20, **ST.BLOCKS)
    b = ST.with_calendar(LB.with_thresholds(b, th, ["site"]), "block_start")
    b = b.withColumn("log_total", F.log1p("total")).withColumn("log_n82", F.log1p("n82"))
    ok = (F.col("n_valid") >= 4) & F.col("origin_valid") & F.col("high_threshold").isNotNull()
    part = C.block_partition(*[F.col(c) for c in ("block_start", "block_end", "origin", "cal_cut", "outer_cut")], ok)
    b = b.withColumn("partition", part).withColumn("event", LB.is_high(F.col("mean_value"), F.col("high_threshold")).cast("int"))
    for flag, name in (("fit", "fit"), ("cal", "calibration"), ("test", "test")):
        b = b.withColumn(flag, F.coalesce(F.col("partition") == name, F.lit(False)))
    return cut_lineage(b)


# the stand-in series cover one month, so only the daily part of the calendar varies
BASE = ["sin_hour", "cos_hour"]
BLOCK_SETS = {"calendar": BASE, "calendar_total": [*BASE, "log_total"], "calendar_total_f82": [*BASE, "log_total", "f82"], "calendar_N82": [*BASE, "log_n82"]}


@query("pip04_block_states")
def block_states(t: Tables):
    r = ST.block_states(study_blocks(t), BLOCK_SETS, 20, 5, DRAWS)
    k = ["site", "min_hours", "lead_h", "tail"]
    return out(r, support=[*k, "status"], scores=[*k, "model"], budgets=[*k, "model", "fraction"], alarms=[*k, "model"], gains=[*k, "base"], years=[*k, "stratum"], seasons=[*k, "stratum"])


@query("pip05_cross_site_states")
def cross_site_states(t: Tables):
    b = study_blocks(t).where("n_valid >= 4 AND origin_valid")
    r = ST.cross_site_states(b, BLOCK_SETS, 20, 5, DRAWS)
    k = ["site", "definition", "lead_h"]
    return out(r, support=[*k, "status"], scores=[*k, "model"], budgets=[*k, "model", "fraction"], gains=[*k, "base", "added"], overlap=[*k, "selection"], seasons=[*k, "stratum"])


def robustness_cases(t: Tables):
    """Ten block definitions as rows of one table."""
    hourly = t.good_hourly()
    b = study_blocks(t)
    bins = t.spectra().select(F.col("timestamp").alias("origin"), P.regrid(F.col("density"), AXIS, GRID).alias("bins")).where("bins IS NOT NULL")
    cut = X.with_cutoffs(bins, F.col("bins"), GRID, (80.0, 100.0)).groupBy("origin").agg(
        *[F.max(F.when(F.col("cutoff_nm") == c, F.col("fraction_above"))).alias(f"f{int(c)}") for c in (80.0, 100.0)],
        *[F.max(F.when(F.col("cutoff_nm") == c, F.log1p("count_above"))).alias(f"log_n{int(c)}") for c in (80.0, 100.0)],
    )
    h = hourly.withColumn("block_start", S.floor_six_hours(F.col("timestamp"))).withColumn("month", F.month("timestamp"))
    th = b.where("lead_h = 3").select("site", "month", "high_threshold").distinct()
    desc = LB.block_hours(h, th, ["site"], "target")
    rec = A.recent_mean(b, hourly, ["site", "block_start", "lead_h"], "target").withColumn("log_recent", F.log1p("recent_mean")).withColumn("log_current", F.log1p("current_value"))
    x = cut_lineage(rec.join(desc, ["site", "block_start"], "left").join(cut, "origin", "left"))
    med = LB.month_thresholds(x.where("fit AND lead_h = 3"), ["site"], "median_value", "block_start", at_least=1, **ST.BLOCKS).select(
        "site", "month", F.col("high_threshold").alias("median_threshold")
    )
    x = x.join(med, ["site", "month"], "left").withColumn("log_extra", F.lit(None).cast("double"))
    shared = C.common_origins(x.withColumn("eligible", F.col("partition").isNotNull()), ["site", "block_start"], (1, 3, 6)).withColumn("shared", F.lit(True))
    x = x.join(shared, ["site", "block_start"], "left")
    three = F.col("lead_h") == 3
    med_event = LB.is_high(F.col("median_value"), F.col("median_threshold")).cast("int")
    none = F.lit(None).cast("double")

    def case(name, when, event, extra, fraction, count):
        return F.when(when, F.struct(F.lit(name).alias("case"), event.alias("event"), extra.alias("extra"), fraction.alias("fraction"), count.alias("count")))

    e, f82, n82 = F.col("event"), F.col("f82"), F.col("log_n82")
    rows = F.array_compact(F.array(
        case("primary_mean", three, e, none, f82, n82),
        case("current_value", three & F.col("log_current").isNotNull(), e, F.col("log_current"), f82, n82),
        case("recent6_value", three & F.col("log_recent").isNotNull(), e, F.col("log_recent"), f82, n82),
        case("cutoff_80", three, e, none, F.col("f80"), F.col("log_n80")),
        case("cutoff_100", three, e, none, F.col("f100"), F.col("log_n100")),
        case("median_target", three, med_event, none, f82, n82),
        case("sustained_target", three & (F.col("n_valid") == 6), F.col("sustained_high").cast("int"), none, f82, n82),
        case("common_block", F.col("shared"), e, none, f82, n82),
    ))
    x = x.where("partition IS NOT NULL").withColumn("__c", F.explode(rows)).drop("event", "f82", "log_n82")
    return cut_lineage(x.select("*", F.col("__c.case").alias("case"), F.col("__c.event").alias("event"), F.col("__c.extra").alias("log_extra2"),
                                F.col("__c.fraction").alias("f82"), F.col("__c.count").alias("log_n82")).drop("__c"))


@query("pip06_block_robustness")
def block_robustness(t: Tables):
    sets = {**BLOCK_SETS, "calendar_extra": [*BASE, "log_extra2"], "calendar_total_extra_f82": [*BASE, "log_total", "f82", "log_extra2"]}
    r = ST.block_robustness(robustness_cases(t), sets, [("calendar_total", "calendar_total_f82"), ("calendar", "calendar_total_f82"), ("calendar_total", "calendar_N82"), ("calendar_extra", "calendar_total_extra_f82")], 20, 5, DRAWS)
    k = ["site", "case", "lead_h"]
    return out(r, support=[*k, "status"], coverage=[*k, "partition", "month"], scores=[*k, "model"], reliability=[*k, "model", "bin"], gains=[*k, "base", "added"], overlap=[*k, "selection"])


NAMES = ("precision_gain", "median_ratio_gain", "exclusive_median_gain")
IV = ", ".join(f"round(quantile_cont({c}, 0.025), 6) AS {c}_lo95, round(quantile_cont({c}, 0.975), 6) AS {c}_hi95, count({c}) AS {c}_valid_draws" for c in NAMES)
GV = ", ".join(f"round({c}, 6) AS {c}" for c in NAMES)


def selection_sql(seed, within, a, b):
    part = f"e.site, d.draw{within}"
    d = draws_sql("ev", "site", "week", seed)
    names = {k: f"{k}_{seed}" for k in ("ix", "dr")}
    ctes = {names["ix"]: d["ix"], names["dr"]: d["dr"].replace("ix", names["ix"])}
    inst = INST.replace("e.site, d.draw ORDER", f"{part} ORDER").replace("PARTITION BY e.site, d.draw)", f"PARTITION BY {part})").replace("JOIN dr d", f"JOIN {names['dr']} d")
    ctes[f"inst_{seed}"] = inst
    ctes[f"iv_{seed}"] = f"""SELECT site, {IV} FROM (SELECT site, draw, {CONTRAST} FROM (SELECT *, r0 <= ceil(0.1::DOUBLE * n) AS a, r1 <= ceil(0.1::DOUBLE * n) AS b FROM inst_{seed}) GROUP BY site, draw) GROUP BY site"""
    ctes[f"gv_{seed}"] = f"SELECT site, {GV} FROM (SELECT site, {CONTRAST} FROM (SELECT *, {a} AS a, {b} AS b FROM rk) GROUP BY site)"
    return ctes


@query(
    "pip07_month_selection",
    sql("rk", """SELECT 'global' AS ranking, * FROM gv_81 JOIN iv_81 USING (site) UNION ALL SELECT 'within_year_month', * FROM gv_82 JOIN iv_82 USING (site)""",
        **selection_sql(81, "", "r0 <= ceil(0.1::DOUBLE * n_site)", "r1 <= ceil(0.1::DOUBLE * n_site)"),
        **selection_sql(82, ", e.ym", "m0 <= ceil(0.1::DOUBLE * n_month)", "m1 <= ceil(0.1::DOUBLE * n_month)")),
)
def month_selection(t: Tables):
    return rounded(ST.month_selection(events(t), "prob0", "prob1", TIES, "event", "target", "ym", "week", seed=81))


def benchmark_rows(t: Tables):
    """Complete-history blocks with labels and train / validation / calibration / test partitions."""
    h = histories(t)
    b = study_blocks(t).where("lead_h = 3 AND partition IS NOT NULL").select("site", "block_start", "block_end", "partition", "event")
    inner = C.date_fraction_cut(b.where("partition = 'fit'"), "site", "block_start", 0.8, "inner_cut").drop("n_days")
    b = b.join(inner, "site")
    part = F.when(F.col("partition") == "fit", C.inner_partition(F.col("block_start"), F.col("block_end"), F.col("inner_cut"))).otherwise(F.col("partition"))
    b = b.withColumn("partition", part).where("partition IS NOT NULL").drop("block_end", "inner_cut")
    return h.select("site", "block_start", "calendar", "n_history", "n82_history", "f82_history", "fr_history").join(b, ["site", "block_start"])


@query("pip08_model_benchmark")
def model_benchmark(t: Tables):
    feats = {(r, c): feature_column(r, c) for r in ("N", "N82", "N_plus_f82", "full24") for c in ("current", "history6")}
    r = ST.model_benchmark(benchmark_rows(t), "calendar", feats)
    k = ["context", "representation", "model"]
    return out(r, scores=k, gains=["context", "model", "base", "added"], history=["model", "representation", "base", "added"], strata=[*k, "stratum"])


@query("pip09_temporal_diagnostics")
def temporal_diagnostics(t: Tables):
    h = site_hours(t)
    rows = ST.lead_table(h, t.hourly(), (1, 3, 6))
    later = t.hourly_spectra().where("total > 0").select(F.col("timestamp").alias("future_ts"), F.col("n82").alias("future_n82"))
    rows = cut_lineage(rows.join(later, "future_ts", "left"))
    r = ST.temporal_diagnostics(rows, HSETS, (1, 3, 6), 40, 30, DRAWS)
    k = ["site", "lead_h", "cohort"]
    return out(r, scores=[*k, "model"], gains=k, seasonal=["site", "lead_h", "season"], physical=["site", "lead_h"], control=["site"])


def fraction_cohort(t: Tables, keep=24):
    """Complete +3 h cohort with the 24 bin fractions as columns."""
    h = site_hours(t)
    rows = ST.lead_table(h, t.hourly(), (3,)).where("y IS NOT NULL AND y0 IS NOT NULL AND (fit OR test)")
    bins = t.spectra().select("timestamp", P.regrid(F.col("density"), AXIS, GRID).alias("bins")).where("bins IS NOT NULL")
    b = F.col("bins")
    from hourgrain.operators.preparation import fraction_columns

    now = bins.select("timestamp", *fraction_columns(b, keep), *[P.fraction_above(b, GRID, c).alias(f"f_{int(c)}") for c in (50.0, 65.0, 100.0, 125.0, 150.0)])
    later = t.hourly_spectra().where("total > 0").select(F.col("timestamp").alias("future_ts"), F.col("n82").alias("future_n82"))
    c = rows.join(now, "timestamp").join(later, "future_ts")
    return c.withColumn("y_now", F.col("y0")).withColumn("y_future", F.col("y")).withColumn("now", F.col("target")).withColumn("closure_ok", F.col("n") % 2 == 0)


@query("pip10_size_fraction_diagnostics")
def size_fraction_diagnostics(t: Tables):
    shares = [f"share_{i}" for i in range(23)]
    r = ST.size_fraction_diagnostics(fraction_cohort(t), CAL, "log_total", shares, {c: f"f_{int(c)}" for c in (50.0, 65.0, 100.0, 125.0, 150.0)}, DRAWS)
    return out(r, scores=["task", "site", "model"], gains=["task", "site", "base", "added"], slopes=["task", "site"], strata=["task", "site", "closure_ok"], bridge=["site"], summary=["task", "base", "added"])


@query("pip11_proxy_and_range")
def proxy_and_range(t: Tables):
    r = ST.proxy_study(site_hours(t), t.hourly(), (1, 3, 6), HSETS, HSETS_EXT, CAL, DRAWS)
    k = ["site", "lead_h"]
    return out(r, scores=[*k, "model"], gains=[*k, "representation", "base", "added"], upper_scores=[*k, "model"], upper_support=[*k, "status"])


@query("pip12_parameter_checks")
def parameter_checks(t: Tables):
    shares = [f"share_{i}" for i in range(24)]
    base = [*CAL, "log_total"]
    sets = {"N": base, "N_plus_f82": [*base, "f82"], "N82": [*CAL, "log_n82"], "full23": [*base, *shares[:23]], "full24": [*base, *shares]}
    r = ST.parameter_checks(fraction_cohort(t), sets, "y_future", draws=DRAWS)
    rows = benchmark_rows(t)
    feats = {}
    for n in (23, 24):
        for context in ("current", "history6"):
            fr = F.col("fr_history") if n == 24 else F.transform("fr_history", lambda a: F.slice(a, 1, 23))
            steps = F.zip_with("n_history", fr, lambda a, b: F.concat(F.array(a), b))
            feats[(f"full{n}", context)] = F.concat("calendar", F.element_at(steps, -1) if context == "current" else F.flatten(steps))
    r["logistic"] = ST.logistic_parameterisation(rows, feats)
    return out(r, scores=["site", "model"], gains=["site", "alpha", "base", "added"], logistic=["context", "representation"])


def wide_minutes(t: Tables):
    """Minute weather with seven variables and their QC fields, several minutes per hour."""
    e = t.read("events")
    v, u = F.col("value"), F.col("user_id")
    names = ["temp_mean", "rh_mean", "atmos_pressure", "wspd_arith_mean", "wspd_vec_mean", "wdir_vec_mean", "tbrg_precip_total"]
    values = [v / 10 - 5, 100 - v % 100, 95 + v % 7, v % 11, v % 9, (u * 7) % 360, v % 3]
    qc = [u % (13 + i) for i in range(7)]
    flag = lambda q: F.when(q == 0, 1).when(q == 1, 8).otherwise(0).cast("bigint")
    return e.select("ts", *[c.cast("double").alias(n) for n, c in zip(names, values)], *[flag(q).alias(f"qc_{n}") for n, q in zip(names, qc)])


def weather_case_rows(t: Tables):
    hours = ST.weather_hours(wide_minutes(t), at_least=2, full=5)
    hours = hours.withColumn("rain_mm", F.coalesce("rain_mm", F.lit(0.0)))
    return ST.weather_cases(study_blocks(t).where("partition IS NOT NULL"), cut_lineage(hours))


@query("pip13_weather_adjusted")
def weather_adjusted(t: Tables):
    r = ST.weather_adjusted(weather_case_rows(t), [*BASE, "log_total"], 20, 5, DRAWS)
    k = ["site", "subset", "lead_h"]
    return out(r, support=[*k, "status"], coverage=[*k, "period", "month"], scores=[*k, "model"], gains=[*k, "base", "added"], seasons=[*k, "stratum"], overlap=[*k, "selection"])


@query("pip14_weather_boosted")
def weather_boosted(t: Tables):
    r = ST.weather_boosted(weather_case_rows(t), [*BASE, "log_total"], 10)
    k = ["site", "subset", "lead_h"]
    return out(r, scores=[*k, "model"], budgets=[*k, "model", "fraction"], budget_gains=[*k, "fraction"], overlap=[*k, "selection"], settings=[*k, "model"])

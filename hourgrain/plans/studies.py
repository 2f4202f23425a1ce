"""The archive's analyses as compositions of the operators.

Each study takes aligned DataFrames and returns its result tables by name. Sites, leads, predictor
sets, penalties and model pairs are columns, so one plan covers all of them. Tables that several
results share are stored once (``cut_lineage``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hourgrain.functions import scalars as S, spectra as P
from hourgrain.operators import (
    align as A, case_trees as CT, cohort as C, labels as LB, linear as L, logistic as G, metrics as M, ordering as O,
    proxy as Y, quality as Q, ranking as K, resampling as B, rollup as R, spectrum as X, trees as T,
)
from hourgrain.session import cut_lineage

CALENDAR = ["sin_hour", "cos_hour", "sin_year", "cos_year"]

#: Groups of six-hour blocks (a site, a lead, a case, a model) are bounded by the calendar: at most 1,461 rows in a year.
BLOCKS = {"bounded": True}


def report(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Long form of several result tables: (table, key, metric, value) over their numeric columns."""
    parts = []
    for name, (df, keys) in tables.items():
        kinds = dict(df.dtypes)
        cols = [c for c in df.columns if c not in keys and kinds[c] in ("double", "bigint", "int", "boolean", "float")]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols]))
        key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
        parts.append(df.select(F.lit(name).alias("table"), key.alias("key"), cells.alias("c")).select("table", "key", "c.metric", "c.value"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def with_calendar(df: DataFrame, ts: str) -> DataFrame:
    for n, c in S.calendar_angles(F.col(ts)).items():
        df = df.withColumn(n, c)
    return df


def lead_table(hours: DataFrame, targets: DataFrame, leads: Sequence[int]) -> DataFrame:
    """Hours x leads with the logged future target and the purged split. ``hours`` carry ``cut``."""
    e = A.exact_lead(hours, targets, "site", leads, {"target": "future", "instrument_ok": "future_ok"})
    ok = S.usable_value(F.col("future")) & S.known_true(F.col("future_ok"))
    e = e.withColumn("eligible", ok).withColumn("y", F.when(ok, F.log1p("future")))
    fit, test = C.hourly_split(F.col("timestamp"), F.col("lead_h"), ok, F.col("cut"))
    return cut_lineage(e.withColumn("fit", fit).withColumn("test", test))


def supported_only(rows: DataFrame, keys: Sequence[str], min_fit: int, min_test: int) -> DataFrame:
    n = rows.groupBy(*keys).agg(F.count_if("fit").alias("a"), F.count_if("test").alias("b"))
    keep = n.where((F.col("a") >= min_fit) & (F.col("b") >= min_test))
    return rows.join(keep.select(*keys), list(keys), "left_semi")


def gain_with_intervals(p: DataFrame, keys: Sequence[str], y: str, base: str, added: str, seed: int, draws: int, ts: str = "timestamp") -> DataFrame:
    """R2 and error gains with date-block and seven-day-block intervals."""
    g = M.paired_regression_gain(p, keys, y, base, added)
    day = B.r2_gain_interval(p.withColumn("__d", B.date_block(F.col(ts))), keys, "__d", y, base, added, seed, draws)
    week = B.r2_gain_interval(B.anchored_block(p, keys, ts, 7, "__w"), keys, "__w", y, base, added, seed + 10000, draws)
    day = day.select(*keys, F.col("delta_r2_lo95").alias("lo95_day"), F.col("delta_r2_hi95").alias("hi95_day"))
    week = week.select(*keys, F.col("delta_r2_lo95").alias("lo95_7day"), F.col("delta_r2_hi95").alias("hi95_7day"))
    return O.join_groups(O.join_groups(g, day, keys), week, keys)


def prepare_archive(spectra: DataFrame, target: DataFrame, axis: Sequence[float], grid: Sequence[float], lead: int = 3,
                    boundary: Column | None = None) -> dict[str, DataFrame]:
    """Mapped spectra, one audit row per site, and the complete cohort of the sites that pass.

    ``spectra(site, timestamp, seq, density, supplied_total, spectrum_ok)``,
    ``target(site, timestamp, target, instrument_ok, closure_ok)``.
    """
    d = F.col("density")
    valid = P.row_valid(d, len(axis), P.channels_complete(d, axis, 15.0, 300.0) & (F.col("supplied_total") > 0))
    one = Q.keep_last(spectra, ["site", "timestamp"], ["seq"])
    mapped = one.select(
        "site", "timestamp", "density", "supplied_total", "spectrum_ok", valid.alias("valid"),
        F.when(F.coalesce(valid, F.lit(False)), P.regrid(d, axis, grid)).alias("bins"), P.band_value(d, axis, 15.0, 300.0).alias("native_total"),
    )
    mapped = cut_lineage(mapped)
    audit = X.audit(mapped, ["site"], "density", F.col("valid"), axis, grid, supplied=F.col("supplied_total"))
    passing = mapped.join(audit.where("passed").select("site"), "site", "left_semi")
    ok = F.col("bins").isNotNull() & (P.array_sum(F.col("bins")) > 0)
    now = A.one_to_one(
        passing.select("site", "timestamp", F.col("spectrum_ok"), "native_total"),
        target.select("site", "timestamp", "target", F.col("instrument_ok").alias("target_ok"), "closure_ok"), ["site", "timestamp"],
    )
    cut = C.date_fraction_cut(now, "site", "timestamp", 0.7).drop("n_days")
    now = now.join(cut, "site").withColumn("cut", F.coalesce(boundary, F.col("cut")) if boundary is not None else F.col("cut"))
    cohort = C.complete_cohort(now, passing.select("site", "timestamp", ok.alias("mapped_ok")), "site", lead, F.col("cut"))
    cohort = cohort.join(passing.select("site", "timestamp", "bins"), ["site", "timestamp"])
    agreement = Q.agreement_gate(cohort, ["site"], P.array_sum(F.col("bins")) / F.col("native_total"), {"n": F.count("*")})
    support = C.support_table(cohort, ["site"], extra={"n_closure_pass": F.count_if(F.col("test") & S.known_true(F.col("closure_ok")))})
    return {"mapped": mapped, "audit": audit, "cohort": cohort, "agreement": agreement, "support": support}


def lead_sweep(rows: DataFrame, base: Sequence[str], min_fit: int = 100, min_test: int = 100, draws: int = 1000, seed: int = 270927,
               common: dict[str, Sequence[int]] | None = None) -> dict[str, DataFrame]:
    """Every lead: total against total plus size fraction, the same given the current target, and
    the first comparison again on origins shared by sets of leads.

    ``rows`` come from ``lead_table`` with ``y0`` (logged current target, NULL when not usable).
    """
    keys = ["site", "lead_h"]
    control = F.col("y0").isNotNull()
    support = C.support_table(
        rows, keys, min_fit=min_fit, min_test=min_test,
        extra={"n_control_fit": F.count_if(F.col("fit") & control), "n_control_test": F.count_if(F.col("test") & control)},
    )
    use = supported_only(rows, keys, min_fit, min_test)
    p = L.fit_predict(use, keys, {"total": base, "total_plus_f82": [*base, "f82"]}, "y")
    crow = supported_only(use.where(control), keys, min_fit, min_test)
    c = L.fit_predict(crow, keys, {"current": [*base, "y0"], "current_plus_f82": [*base, "y0", "f82"]}, "y")
    names = {"p_current": "p_current", "p_current_plus_f82": "p_current_plus_f82"}
    pred = A.align_predictions(
        p.select("site", "timestamp", "lead_h", "y", "y0", "p_total", "p_total_plus_f82"), c, ["site", "timestamp", "lead_h"], names
    )
    pred = cut_lineage(pred)
    long = K.melt(pred, [*keys, "y"], {
        "total": "p_total", "total_plus_f82": "p_total_plus_f82", "current": "p_current", "current_plus_f82": "p_current_plus_f82", "identity": "y0",
    }).where("p IS NOT NULL")
    scores = M.regression_scores(long, [*keys, "model"], "y", "p")
    given = pred.where("p_current IS NOT NULL")
    cohorts = [
        pred.select(*keys, "timestamp", "y", F.col("p_total").alias("a"), F.col("p_total_plus_f82").alias("b"), F.lit("minimal").alias("cohort")),
        given.select(*keys, "timestamp", "y", F.col("p_current").alias("a"), F.col("p_current_plus_f82").alias("b"), F.lit("current_available").alias("cohort")),
    ]
    for name, leads in (common or {"common_1to6": range(1, 7), "common_1to24": range(1, 25)}).items():
        shared = C.common_origins(rows.where(F.col("timestamp") >= F.col("cut")), ["site", "timestamp"], list(leads))
        part = pred.where(F.col("lead_h").isin(list(leads))).join(shared, ["site", "timestamp"], "left_semi")
        cohorts.append(part.select(*keys, "timestamp", "y", F.col("p_total").alias("a"), F.col("p_total_plus_f82").alias("b"), F.lit(name).alias("cohort")))
    every = cut_lineage(reduce(lambda a, b: a.unionByName(b), cohorts))
    gains = gain_with_intervals(every, ["site", "lead_h", "cohort"], "y", "a", "b", seed, draws)
    return {"support": support, "predictions": pred, "scores": scores, "gains": gains}


def seasonal_replay(pred: DataFrame, keys: Sequence[str], ts: str, y: str, p0: str, p1: str, seed: int = 270928, draws: int = 1000) -> DataFrame:
    """Scores per season with seven-day intervals where a season is supported."""
    table = M.seasonal_gain(pred, keys, ts, y, p0, p1)
    by = [*keys, "season"]
    rows = pred.withColumn("season", S.season_of(F.month(ts))).withColumn("__w", B.week_block(F.col(ts)))
    rows = O.join_groups(rows, table.where("supported").select(*by), by, "left_semi")
    return O.join_groups(table, B.r2_gain_interval(rows, by, "__w", y, p0, p1, seed, draws), by, "left")


def probability_report(pred: DataFrame, keys: Sequence[str], models: Sequence[str], event: str, ties: Sequence[str], value: str, prior: str | None = None,
                       fractions: Sequence[float] = (0.1,)) -> dict[str, DataFrame]:
    """Brier, average precision and fixed-budget selection of several models on the same rows."""
    keep = [*keys, event, value, *ties, *([prior] if prior else [])]
    long = K.melt(pred, keep, {m: f"p_{m}" for m in models})
    by = [*keys, "model"]
    s = O.join_groups(M.probability_scores(long, by, event, "p", prior), M.average_precision(long, by, event, "p", **BLOCKS), by)
    return {"scores": s, "budgets": K.budget_table(long, by, "p", event, value, ties, fractions, **BLOCKS)}


def pair_report(pred: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], event: str, ties: Sequence[str], block: str, seed: int, draws: int) -> DataFrame:
    """Gains and re-ranked weekly intervals for several model pairs, the pair being a column."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("base"), F.lit(b).alias("added"), F.col(f"p_{a}").alias("p0"), F.col(f"p_{b}").alias("p1")) for a, b in pairs
    ]))
    long = pred.select(*keys, event, block, *ties, rows.alias("s")).select(*keys, event, block, *ties, "s.*")
    long = cut_lineage(long.where("p0 IS NOT NULL AND p1 IS NOT NULL"))
    by = [*keys, "base", "added"]
    g = M.paired_probability_gain(long, by, event, "p0", "p1", ties, **BLOCKS)
    return O.join_groups(g, B.selection_interval(long, by, block, event, "p0", "p1", ties, seed, draws), by)


def block_state_cases(blocks: DataFrame, min_hours: Sequence[int] = (4, 5), tails: Sequence[str] = ("high", "low")) -> DataFrame:
    """Blocks x minimum hours x tail with their labels and partitions.

    ``blocks`` carry lead, origin, cuts, thresholds, ``n_valid``, ``mean_value``, ``origin_valid``.
    """
    case = F.explode(F.array(*[F.struct(F.lit(h).alias("min_hours"), F.lit(t).alias("tail")) for h in min_hours for t in tails]))
    b = blocks.withColumn("__c", case).withColumn("min_hours", F.col("__c.min_hours")).withColumn("tail", F.col("__c.tail")).drop("__c")
    v = F.col("mean_value")
    event = F.when(F.col("tail") == "high", LB.is_high(v, F.col("high_threshold"))).otherwise(LB.is_low(v, F.col("low_threshold")))
    ok = (F.col("n_valid") >= F.col("min_hours")) & F.col("origin_valid") & F.col("high_threshold").isNotNull()
    part = C.block_partition(*[F.col(c) for c in ("block_start", "block_end", "origin", "cal_cut", "outer_cut")], ok)
    b = b.withColumn("event", event.cast("int")).withColumn("partition", part)
    for flag, name in (("fit", "fit"), ("cal", "calibration"), ("test", "test")):
        b = b.withColumn(flag, F.coalesce(F.col("partition") == name, F.lit(False)))
    return b.where("partition IS NOT NULL")


def enough_classes(rows: DataFrame, keys: Sequence[str], min_fit: int, min_test: int) -> tuple[DataFrame, DataFrame]:
    """Support per group and the rows of the groups that can be scored."""
    e = F.col("event") == 1
    s = rows.groupBy(*keys).agg(
        F.count_if("fit").alias("n_fit"), F.count_if("test").alias("n_test"), F.count_if(F.col("fit") & e).alias("events_fit"),
        F.count_if(F.col("test") & e).alias("events_test"),
    )
    ok = (F.col("n_fit") >= min_fit) & (F.col("n_test") >= min_test) & (F.col("events_fit") > 0) & (F.col("events_fit") < F.col("n_fit"))
    s = s.withColumn("status", F.when(ok, "scored").otherwise("insufficient_support"))
    return s, rows.join(s.where("status = 'scored'").select(*keys), list(keys), "left_semi")


def block_states(blocks: DataFrame, sets: dict[str, Sequence[str]], min_fit: int = 100, min_test: int = 100, draws: int = 2000, seed: int = 270928,
                 site: str = "site") -> dict[str, DataFrame]:
    """High and low states: minimum hours x lead x tail, alarm cut-offs, Brier intervals, budgets, years."""
    keys = [site, "min_hours", "lead_h", "tail"]
    rows = cut_lineage(block_state_cases(blocks))
    support, use = enough_classes(rows, keys, min_fit, min_test)
    p = cut_lineage(G.fit_predict(use, keys, sets, "event", **BLOCKS))
    long = K.melt(p, [*keys, "event", "cal", "test", "block_start"], {n: f"p_{n}" for n in sets})
    by = [*keys, "model"]
    cut = G.alarm_cut(long, by, "p", "event", "cal", **BLOCKS)
    test = long.where("test")
    alarms = M.alarm_counts(O.join_groups(test, cut, by).withColumn("alarm", F.col("p") > F.col("alarm_cut")), by, "event", "alarm")
    t = p.where("test").withColumn("week", S.epoch_week(F.col("block_start"))).withColumn("t", S.micros(F.col("block_start")))
    prior = G.frequency_prior(use, keys, "event")
    t = O.join_groups(t, prior, keys)
    probs = probability_report(t, keys, list(sets), "event", ["t"], "mean_value", "p_fitting_frequency", (0.05, 0.1, 0.2))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("base"), F.col(f"p_{n}").alias("p0")) for n in sets if n != "calendar_total_f82"]))
    pair = t.select(*keys, "event", "week", F.col("p_calendar_total_f82").alias("p1"), pairs.alias("s")).select(*keys, "event", "week", "p1", "s.*")
    gains = B.brier_gain_interval(cut_lineage(pair), [*keys, "base"], "week", "event", "p0", "p1", seed, draws)
    years = M.stratum_brier(t, keys, F.year("block_start"), "event", "p_calendar_total", "p_calendar_total_f82")
    seasons = M.stratum_brier(t, keys, F.col("season"), "event", "p_calendar_total", "p_calendar_total_f82")
    return {"support": support, "predictions": p, "scores": probs["scores"], "budgets": probs["budgets"], "alarms": alarms, "gains": gains, "years": years, "seasons": seasons}


def cross_site_states(blocks: DataFrame, sets: dict[str, Sequence[str]], min_fit: int = 40, min_test: int = 20, draws: int = 1000, seed: int = 280900) -> dict[str, DataFrame]:
    """High states at every site under monthly and pooled thresholds, at each lead."""
    keys = ["site", "definition", "lead_h"]
    pooled = LB.pooled_thresholds(blocks.where((F.col("lead_h") == 3) & (F.col("block_end") <= F.col("cal_cut"))), ["site"], "mean_value", **BLOCKS)
    each = F.explode(F.array(
        F.struct(F.lit("monthly").alias("d"), F.col("high_threshold").alias("t")), F.struct(F.lit("pooled_sensitivity").alias("d"), F.col("pooled_high").alias("t")),
    ))
    rows = blocks.join(pooled, "site").withColumn("__d", each)
    rows = rows.withColumn("definition", F.col("__d.d")).withColumn("threshold", F.col("__d.t")).drop("__d").where("threshold IS NOT NULL")
    rows = rows.withColumn("event", LB.is_high(F.col("mean_value"), F.col("threshold")).cast("int"))
    support, use = enough_classes(rows, keys, min_fit, min_test)
    p = G.fit_predict(cut_lineage(use), keys, sets, "event", score="test", **BLOCKS)
    p = O.join_groups(p, G.frequency_prior(use, keys, "event"), keys)
    p = cut_lineage(p.withColumn("week", S.epoch_week(F.col("block_start"))).withColumn("t", S.micros(F.col("block_start"))))
    probs = probability_report(p, keys, [*sets, "fitting_frequency"], "event", ["t"], "mean_value", "p_fitting_frequency")
    gains = pair_report(
        p, keys, [("calendar_total", "calendar_total_f82"), ("calendar_total", "calendar_N82"), ("fitting_frequency", "calendar_total_f82")],
        "event", ["t"], "week", seed, draws,
    )
    flagged = K.flag_pair(p, keys, "p_calendar_total", "p_calendar_total_f82", ["t"], **BLOCKS)
    overlap = K.overlap_table(flagged, keys, "event", ["mean_value"], **BLOCKS)
    seasons = M.stratum_brier(p, keys, F.col("season"), "event", "p_calendar_total", "p_calendar_total_f82")
    return {"support": support, "predictions": p, "scores": probs["scores"], "budgets": probs["budgets"], "gains": gains, "overlap": overlap, "seasons": seasons}


def block_robustness(cases: DataFrame, sets: dict[str, Sequence[str]], pairs: Sequence[tuple[str, str]], min_fit: int = 40, min_test: int = 20,
                     draws: int = 1000, seed: int = 270920) -> dict[str, DataFrame]:
    """Many block definitions at once: ``case`` is a column of ``cases`` next to event and partition.

    Every case has the columns of all sets; a set whose predictors a case lacks is fitted without
    them, so pairs are read for the cases that define them.
    """
    keys = ["site", "case", "lead_h"]
    support, use = enough_classes(cases, keys, min_fit, min_test)
    coverage = C.monthly_coverage(cases.where("partition IS NOT NULL"), [*keys, "partition"], {"n_blocks": F.count("*"), "high_blocks": F.sum(F.col("event").cast("bigint"))})
    p = G.fit_predict(cut_lineage(use), keys, sets, "event", score="test", **BLOCKS)
    p = O.join_groups(p, G.frequency_prior(use, keys, "event"), keys)
    p = cut_lineage(p.withColumn("week", S.epoch_week(F.col("block_start"))).withColumn("t", S.micros(F.col("block_start"))))
    probs = probability_report(p, keys, list(sets), "event", ["t"], "mean_value", "p_fitting_frequency")
    long = K.melt(p, [*keys, "event"], {n: f"p_{n}" for n in sets})
    return {
        "support": support, "coverage": coverage, "scores": probs["scores"], "reliability": M.reliability(long, [*keys, "model"], "event", "p"),
        "gains": pair_report(p, keys, pairs, "event", ["t"], "week", seed, draws),
        "overlap": K.overlap_table(K.flag_pair(p, keys, "p_calendar_total", "p_calendar_total_f82", ["t"], **BLOCKS), keys, "event", ["mean_value"], **BLOCKS),
    }


def month_selection(pred: DataFrame, p0: str, p1: str, ties: Sequence[str], event: str, ratio: str, ym: str, week: str, seed: int = 20261002, draws: int = 1000) -> DataFrame:
    """Global against within-month selection: contrasts and their re-ranked weekly intervals."""
    pred = cut_lineage(pred)
    parts = []
    for i, (name, within) in enumerate((("global", []), ("within_year_month", [ym]))):
        flagged = K.flag_pair(pred, ["site", *within], p0, p1, ties)
        c = K.contrast_table(flagged, ["site"], event, ratio)
        iv = B.selection_contrast_interval(pred, ["site"], week, event, ratio, p0, p1, ties, within, seed + i, draws)
        parts.append(O.join_groups(c, iv, ["site"]).withColumn("ranking", F.lit(name)))
    return parts[0].unionByName(parts[1])


def model_benchmark(rows: DataFrame, calendar: str, features: dict[tuple[str, str], Column], families: Sequence[str] = ("logistic", "random_forest", "boosted", "boosted_shallow"),
                    draws: int = 1000, seed: int = 270929, settings: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """Model families x representations x contexts on the common cohort of each site, calibrated and compared.

    ``rows`` carry key columns, ``event``, ``partition`` in train / validation / calibration / test
    and the history arrays. Trees are fitted for each site, representation and context, all in one job a family; the logistic
    models, with up to 150 predictors, are one distributed fit each over all sites.
    """
    settings = settings or {}
    rows = cut_lineage(rows)
    keep = ["site", "block_start", "partition", "event"]
    score = F.col("partition").isin("calibration", "test")
    parts = []
    for rep, context, x in [("calendar", "current", F.col(calendar)), *((r, c, x) for (r, c), x in features.items())]:
        d = rows.select(*keep, x.alias("features"))
        train = d.where("partition = 'train'")
        p = T.wide_logistic(scaled(train, train), scaled(d.where(score), train), "features", "event")
        parts.append(p.select(*keep, "p").withColumn("model", F.lit("logistic")).withColumn("representation", F.lit(rep)).withColumn("context", F.lit(context)))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("representation"), F.lit(c).alias("context"), x.alias("features")) for (r, c), x in features.items()]))
    long = rows.select(*keep, each.alias("s")).select(*keep, "s.*").withColumns({name: F.col("partition") == name for name in ("train", "validation")}).withColumn("score", score)
    names = {"random_forest": "forest", "boosted": "boosted", "boosted_shallow": "boosted_shallow"}
    for family in (f for f in families if f in names):
        stop = None if family == "random_forest" else "validation"
        p = CT.fit_cases(long, ["site", "representation", "context"], ["block_start", "partition"], "features", "event", names[family], "train", stop, None, "score", **settings.get(family, {}))
        parts.append(p.withColumn("event", F.col("event").cast("int")).select(*keep, "p", F.lit(family).alias("model"), "representation", "context"))
    pred = cut_lineage(reduce(lambda a, b: a.unionByName(b), parts))
    by = ["context", "representation", "model"]
    cal = G.calibrate(pred.withColumn("is_cal", F.col("partition") == "calibration"), by, "p", "event", "is_cal").where("partition = 'test'")
    cal = cut_lineage(cal.withColumn("t", S.micros(F.col("block_start"))).withColumn("week", S.epoch_week(F.col("block_start"))).withColumn("season", S.season_of(F.month("block_start"))))
    raw = M.probability_scores(cal, by, "event", "p")
    scores = O.join_groups(
        O.join_groups(raw, M.probability_scores(cal, by, "event", "p_calibrated").select(*by, F.col("brier").alias("brier_calibrated")), by),
        M.average_precision(cal, by, "event", "p"), by,
    )
    ties = ["t", "site"]
    wide_by = ["context", "model", "site", "block_start", "t", "week", "event"]
    reps = sorted({r for r, _ in features})
    wide = cal.groupBy(*wide_by).agg(*[F.max(F.when(F.col("representation") == r, F.col("p"))).alias(f"p_{r}") for r in reps])
    gains = pair_report(wide, ["context", "model"], [(a, b) for a, b in (("N", "N82"), ("N", "N_plus_f82"), ("N", "full24"), ("N82", "full24")) if a in reps and b in reps], "event", ties, "week", seed, draws)
    both = cal.groupBy("model", "representation", "site", "block_start", "t", "week", "event").agg(
        *[F.max(F.when(F.col("context") == c, F.col("p"))).alias(f"p_{c}") for c in ("current", "history6")]
    ).where("representation <> 'calendar'")
    history = pair_report(both, ["model", "representation"], [("current", "history6")], "event", ties, "week", seed + 500, draws)
    strata = M.stratum_brier(cal, by, F.col("season"), "event", "p", "p_calibrated")
    return {"predictions": pred, "scores": scores, "gains": gains, "history": history, "strata": strata}


def scaled(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Feature arrays scaled by the training mean and population SD of each position."""
    stat = train.select(F.posexplode("features").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    # one pair of numbers per feature position
    pairs = [(r.m, r.s if r.s else 1.0) for r in stat.orderBy("i").collect()]
    m, s = P.array_lit([p[0] for p in pairs]), P.array_lit([p[1] for p in pairs])
    centred = F.zip_with("features", m, lambda v, x: v - x)
    return rows.withColumn("features", F.zip_with(centred, s, lambda v, x: v / x))


def temporal_diagnostics(rows: DataFrame, sets: dict[str, Sequence[str]], leads: Sequence[int], min_fit: int = 100, min_test: int = 100, draws: int = 1000,
                         seed: int = 270927) -> dict[str, DataFrame]:
    """Eligible against common origins, a 70 % date split, the current-target control, persistence.

    ``rows`` come from ``lead_table`` and carry ``y0``, ``n82`` and ``future_n82``.
    """
    shared = C.common_origins(rows, ["site", "timestamp"], leads).withColumn("__common", F.lit(True))
    r = rows.join(shared, ["site", "timestamp"], "left").withColumn("__common", S.known_true(F.col("__common")))
    longest = F.col("timestamp") + S.hours_interval(max(leads)) < F.col("cut")
    cut70 = C.date_fraction_cut(rows.where(F.col("lead_h") == 3), "site", "timestamp", 0.7, "cut70").drop("n_days")
    r = r.join(cut70, "site")
    three = (F.col("lead_h") == 3) & F.col("eligible")
    alt_fit = three & (F.col("timestamp") + S.hours_interval(3) < F.col("cut70"))
    alt_test = three & (F.col("timestamp") >= F.col("cut70"))
    kinds = F.explode(F.array(
        F.struct(F.lit("eligible").alias("c"), F.col("fit").alias("f"), F.col("test").alias("t")),
        F.struct(F.lit("common_origin").alias("c"), (F.col("__common") & longest).alias("f"), (F.col("__common") & (F.col("timestamp") >= F.col("cut"))).alias("t")),
        F.struct(F.lit("split_70").alias("c"), alt_fit.alias("f"), alt_test.alias("t")),
    ))
    keys = ["site", "lead_h", "cohort"]
    k = r.withColumn("__k", kinds).withColumn("cohort", F.col("__k.c")).withColumn("fit", F.col("__k.f")).withColumn("test", F.col("__k.t")).drop("__k", "__common")
    use = cut_lineage(supported_only(k.where("fit OR test"), keys, min_fit, min_test))
    p = cut_lineage(L.fit_predict(use, keys, sets, "y"))
    long = K.melt(p, [*keys, "y"], {n: f"p_{n}" for n in sets})
    gains = gain_with_intervals(p, keys, "y", "p_total", "p_total_plus_f82", seed, draws)
    three_day = B.r2_gain_interval(B.anchored_block(p, keys, "timestamp", 3, "__b"), keys, "__b", "y", "p_total", "p_total_plus_f82", seed + 300, draws)
    gains = O.join_groups(gains, three_day.select(*keys, F.col("delta_r2_lo95").alias("lo95_3day"), F.col("delta_r2_hi95").alias("hi95_3day")), keys)
    seasonal = M.seasonal_gain(p.where("cohort = 'eligible'"), ["site", "lead_h"], "timestamp", "y", "p_total", "p_total_plus_f82")
    control = supported_only(rows.where("lead_h = 3 AND y0 IS NOT NULL"), ["site"], min_fit, min_test)
    c = L.fit_predict(control, ["site"], {"current": [*sets["total"], "y0"], "current_plus_f82": [*sets["total"], "y0", "f82"]}, "y")
    later = rows.where("test AND future_n82 IS NOT NULL")
    n, fn = F.log1p("n82"), F.log1p("future_n82")
    physical = later.groupBy("site", "lead_h").agg(
        F.count("*").alias("n"), R.r2(fn, n).alias("r2_persistence"), R.r2(F.col("y"), fn).alias("r2_lookahead"), R.r2(F.col("y"), n).alias("r2_from_now"),
    )
    return {
        "scores": M.regression_scores(long, [*keys, "model"], "y", "p"), "gains": gains, "seasonal": seasonal, "physical": physical,
        "control": M.paired_regression_gain(c, ["site"], "y", "p_current", "p_current_plus_f82"),
    }


def size_fraction_diagnostics(cohort: DataFrame, aux: Sequence[str], total: str, fractions: Sequence[str], cutoffs: dict[float, str], draws: int = 1000,
                              seed: int = 260926) -> dict[str, DataFrame]:
    """Concurrent and +3 h tasks, nine predictor sets, cut-off scan, slopes, closure strata, bridge.

    ``cohort`` carries fit/test, ``y_now``, ``y_future``, ``log_n82``, ``f82``, fraction columns,
    raw ``now``/``future``/``n82``/``future_n82`` and ``closure_ok``.
    """
    cohort = cut_lineage(cohort)
    base = [*aux, total]
    sets = {
        "total": base, "total_plus_f82": [*base, "f82"], "total_plus_fractions": [*base, *fractions], "n82_only": ["log_n82"],
        "calibrated_n82": [*aux, "log_n82"],
    }
    sets |= {f"scan_{c:g}": [*base, col] for c, col in cutoffs.items()}
    now_sets = {"current": [*base, "y_now"], "current_plus_f82": [*base, "y_now", "f82"], "current_plus_n82": [*base, "y_now", "log_n82"], "current_plus_fractions": [*base, "y_now", *fractions]}
    scores, gains, slopes, strata = [], [], [], []
    for task, y, use in (("concurrent", "y_now", sets), ("future_3h", "y_future", {**sets, **now_sets})):
        fitted = L.ridge_fit(cohort, ["site"], use, y)
        p = cut_lineage(L.ridge_predict(cohort.where("test"), fitted, ["site"], use).withColumn("p_direct", F.col("log_n82")))
        names = {n: f"p_{n}" for n in [*use, "direct"]}
        scores.append(M.regression_scores(K.melt(p, ["site", y], names), ["site", "model"], y, "p").withColumn("task", F.lit(task)))
        pairs = [("total", "total_plus_f82"), ("total", "total_plus_fractions"), ("total_plus_f82", "total_plus_fractions"), ("total", "calibrated_n82"),
                 ("calibrated_n82", "total_plus_fractions"), ("direct", "n82_only")]
        if task == "future_3h":
            pairs += [("current", "current_plus_f82"), ("current", "current_plus_n82"), ("current", "current_plus_fractions")]
        pair = F.explode(F.array(*[F.struct(F.lit(a).alias("base"), F.lit(b).alias("added"), F.col(f"p_{a}").alias("p0"), F.col(f"p_{b}").alias("p1")) for a, b in pairs]))
        pl = p.select("site", "timestamp", F.col(y).alias("y"), pair.alias("s")).select("site", "timestamp", "y", "s.*").withColumn("__d", B.date_block(F.col("timestamp")))
        by = ["site", "base", "added"]
        g = O.join_groups(M.paired_regression_gain(pl, by, "y", "p0", "p1"), B.r2_gain_interval(pl, by, "__d", "y", "p0", "p1", seed, draws), by)
        gains.append(g.withColumn("task", F.lit(task)))
        slopes.append(L.slope_table(fitted, cohort, ["site"], use, "total_plus_f82", "f82").withColumn("task", F.lit(task)))
        strata.append(M.paired_regression_gain(p, ["site", "closure_ok"], y, "p_total", "p_total_plus_f82").withColumn("task", F.lit(task)))
    union = lambda xs: reduce(lambda a, b: a.unionByName(b), xs)
    g = cut_lineage(union(gains))
    bridge = R.physical_bridge(cohort.where("test"), ["site"], "now", "n82", "future", "future_n82")
    return {
        "scores": union(scores), "gains": g, "slopes": union(slopes), "strata": union(strata), "bridge": bridge,
        "summary": R.gain_summary(g, ["task", "base", "added"], "delta_r2", "delta_r2_lo95"),
    }


ROUTES = ("persistence", "direct_full", "direct_matched", "transition")


def proxy_study(hours: DataFrame, targets: DataFrame, leads: Sequence[int], sets: dict[str, Sequence[str]], extended: dict[str, Sequence[str]], common: Sequence[str],
                draws: int = 1000, seed: int = 20261002) -> dict[str, DataFrame]:
    """Direct forecasts against a carried concurrent proxy, and 300 nm against 500 nm predictors."""
    hours = cut_lineage(hours)
    p = Y.proxies(hours, "site", "timestamp", "cut", sets, "y0", "eligible0", "usable")
    rows = lead_table(hours, targets, leads)
    routes = cut_lineage(Y.transition_routes(rows.join(p, ["site", "timestamp"], "left"), ["site", "lead_h"], sets, common, "y"))
    names = {f"{r}_{n}": f"{r}_{n}" for r in ROUTES for n in sets}
    scores = M.regression_scores(K.melt(routes, ["site", "lead_h", "y"], names), ["site", "lead_h", "model"], "y", "p")
    pair = F.explode(F.array(*[
        F.struct(F.lit(n).alias("representation"), F.lit(a).alias("base"), F.lit(b).alias("added"), F.col(f"{a}_{n}").alias("p0"), F.col(f"{b}_{n}").alias("p1"))
        for n in sets for a, b in (("persistence", "direct_full"), ("transition", "direct_full"), ("transition", "direct_matched"))
    ]))
    by = ["site", "lead_h", "representation", "base", "added"]
    pl = routes.select("site", "lead_h", "timestamp", "y", pair.alias("s")).select("site", "lead_h", "timestamp", "y", "s.*")
    pl = pl.where("p0 IS NOT NULL AND p1 IS NOT NULL").withColumn("week", B.week_block(F.col("timestamp")))
    gains = O.join_groups(M.paired_regression_gain(pl, by, "y", "p0", "p1"), B.r2_gain_interval(pl, by, "week", "y", "p0", "p1", seed, draws), by)
    matched = C.matched_rows(rows, ["total_ext", "f82_ext"])
    upper = {**{f"{n}_300": c for n, c in sets.items()}, **{f"{n}_500": c for n, c in extended.items()}}
    u = L.fit_predict(matched, ["site", "lead_h"], upper, "y")
    upper_scores = M.regression_scores(K.melt(u, ["site", "lead_h", "y"], {n: f"p_{n}" for n in upper}), ["site", "lead_h", "model"], "y", "p")
    return {"scores": scores, "gains": gains, "upper_scores": upper_scores, "upper_support": C.support_table(matched, ["site", "lead_h"], min_fit=40, min_test=1)}


def parameter_checks(cohort: DataFrame, sets: dict[str, Sequence[str]], y: str, alphas: Sequence[float] = (1.0, 10.0, 100.0), draws: int = 1000,
                     seed: int = 270920) -> dict[str, DataFrame]:
    """Penalty and parameterisation sensitivity: every set and penalty from one set of sums."""
    p = cut_lineage(L.fit_predict(cut_lineage(cohort), ["site"], sets, y, alphas))
    names = {n: f"p_{n}" for n in L.model_names(sets, alphas)}
    scores = M.regression_scores(K.melt(p, ["site", y], names), ["site", "model"], y, "p")
    pair = F.explode(F.array(*[
        F.struct(F.lit(a).alias("alpha"), F.lit(b0).alias("base"), F.lit(b1).alias("added"), F.col(f"`p_{b0}@{a:g}`").alias("p0"), F.col(f"`p_{b1}@{a:g}`").alias("p1"))
        for a in alphas for b0, b1 in (("N", "N_plus_f82"), ("N_plus_f82", "full23"), ("full23", "full24"))
    ]))
    by = ["site", "alpha", "base", "added"]
    pl = p.select("site", "timestamp", F.col(y).alias("y"), pair.alias("s")).select("site", "timestamp", "y", "s.*")
    pl = B.anchored_block(cut_lineage(pl), by, "timestamp", 7, "blk")
    gains = O.join_groups(M.paired_regression_gain(pl, by, "y", "p0", "p1"), B.r2_gain_interval(pl, by, "blk", "y", "p0", "p1", seed, draws), by)
    return {"scores": scores, "gains": gains}


def logistic_parameterisation(rows: DataFrame, features: dict[tuple[str, str], Column], ties: Sequence[str] = ("t", "site")) -> DataFrame:
    """Wide logistic models on 23 or 24 fractions, current or history, calibrated on earlier rows."""
    rows = cut_lineage(rows)
    keep = ["site", "block_start", "partition", "event"]
    parts = []
    for (rep, context), x in features.items():
        d = rows.select(*keep, x.alias("features"))
        train = d.where("partition = 'train'")
        p = T.wide_logistic(scaled(train, train), scaled(d.where("partition IN ('calibration', 'test')"), train), "features", "event")
        parts.append(p.select(*keep, "p").withColumn("representation", F.lit(rep)).withColumn("context", F.lit(context)))
    pred = cut_lineage(reduce(lambda a, b: a.unionByName(b), parts))
    by = ["context", "representation"]
    cal = G.calibrate(pred.withColumn("is_cal", F.col("partition") == "calibration"), by, "p", "event", "is_cal").where("partition = 'test'")
    cal = cal.withColumn("t", S.micros(F.col("block_start"))).withColumn("v", F.col("p"))
    cal = cut_lineage(cal)
    s = M.probability_scores(cal, by, "event", "p")
    c = M.probability_scores(cal, by, "event", "p_calibrated").select(*by, F.col("brier").alias("brier_calibrated"))
    ab = cal.groupBy(*by).agg(F.max("cal_intercept").alias("cal_intercept"), F.max("cal_slope").alias("cal_slope"))
    k = K.budget_table(cal, by, "p", "event", "v", list(ties), (0.1,)).select(*by, "selected", "hits")
    out = O.join_groups(O.join_groups(s, c, by), M.average_precision(cal, by, "event", "p"), by)
    return O.join_groups(O.join_groups(out, ab, by), k, by)


WEATHER = ["temperature", "rh", "pressure", "windspeed", "u", "v"]


def weather_hours(minutes: DataFrame, at_least: int = 45, full: int = 60) -> DataFrame:
    """Right-closed hourly weather per QC policy from wide minutes.

    ``minutes(ts, <variable>, qc_<variable>)``; the wind vector comes from speed and direction.
    """
    parts = []
    for policy, strict in (("primary", False), ("strict", True)):
        def ok(v: str, strict: bool = strict) -> Column:
            return F.when(S.qc_bits_ok(F.col(f"qc_{v}"), strict), F.col(v))

        cols = {
            "temperature": ok("temp_mean"), "rh": ok("rh_mean"), "pressure": ok("atmos_pressure"), "windspeed": ok("wspd_arith_mean"),
            "u": S.wind_u(ok("wspd_vec_mean"), ok("wdir_vec_mean")), "v": S.wind_v(ok("wspd_vec_mean"), ok("wdir_vec_mean")),
        }
        h = R.hourly_means(minutes, [], "ts", cols, at_least, {"rain_mm": ok("tbrg_precip_total")}, full)
        parts.append(h.withColumn("policy", F.lit(policy)))
    return parts[0].unionByName(parts[1])


def weather_cases(blocks: DataFrame, hours: DataFrame) -> DataFrame:
    """Blocks x (policy, rain) with weather at the origin; only rows with every predictor remain."""
    h = hours.select("policy", "origin", *WEATHER, F.log1p("rain_mm").alias("log_rain"))
    j = A.at_origin(blocks, h, "origin").where("policy IS NOT NULL")
    case = F.explode(F.array(F.lit("core"), F.lit("rain")))
    j = j.withColumn("__r", case).withColumn("subset", F.concat_ws("_", "policy", "__r"))
    j = j.withColumn("log_rain", F.when(F.col("__r") == "rain", F.col("log_rain")).otherwise(0.0)).drop("__r")
    return C.matched_rows(j, [*WEATHER, "log_rain"])


def weather_adjusted(cases: DataFrame, base: Sequence[str], min_fit: int = 40, min_test: int = 20, draws: int = 1000, seed: int = 928000) -> dict[str, DataFrame]:
    """Logistic models with and without weather on matched rows: N, N+f82, N+met, N+met+f82."""
    keys = ["site", "subset", "lead_h"]
    met = [*WEATHER, "log_rain"]
    sets = {"N": base, "N_f82": [*base, "f82"], "N_met": [*base, *met], "N_met_f82": [*base, "f82", *met]}
    cases = cut_lineage(cases)
    support, use = enough_classes(cases, keys, min_fit, min_test)
    coverage = C.monthly_coverage(cases.withColumn("period", F.when(F.col("fit"), "fit").when(F.col("test"), "test")).where("period IS NOT NULL"), [*keys, "period"], {"n_matched": F.count("*")})
    p = G.fit_predict(use, keys, sets, "event", score="test", **BLOCKS)
    p = cut_lineage(p.withColumn("week", S.epoch_week(F.col("block_start"))).withColumn("t", S.micros(F.col("block_start"))))
    probs = probability_report(p, keys, list(sets), "event", ["t"], "mean_value")
    pairs = [("N", "N_f82"), ("N_met", "N_met_f82"), ("N", "N_met")]
    gains = pair_report(p, keys, pairs, "event", ["t"], "week", seed, draws)
    seasons = M.stratum_brier(p, keys, F.col("season"), "event", "p_N_met", "p_N_met_f82")
    overlap = K.overlap_table(K.flag_pair(p, keys, "p_N_met", "p_N_met_f82", ["t"], **BLOCKS), keys, "event", ["mean_value"], **BLOCKS)
    return {"support": support, "coverage": coverage, "predictions": p, "scores": probs["scores"], "gains": gains, "seasons": seasons, "overlap": overlap}


def weather_boosted(cases: DataFrame, base: Sequence[str], draws: int = 1000, seed: int = 928700, **settings) -> dict[str, DataFrame]:
    """Boosted trees with early stopping on an inner chronological part, refitted on all fit rows for the best number of
    rounds, at four selection budgets. One model for each site, lead, subset and predictor set, all in one job."""
    met = [*WEATHER, "log_rain"]
    sets = {"N": base, "N_f82": [*base, "f82"], "N_met": [*base, *met], "N_met_f82": [*base, "f82", *met]}
    keys = ["site", "subset", "lead_h"]
    cases = cases.withColumn("__case", F.concat_ws("|", *keys))
    inner = C.date_fraction_cut(cases.where("fit"), "__case", "origin", 0.8, "inner_cut").drop("n_days")
    rows = cases.join(inner, "__case").drop("__case").withColumn("train", F.col("fit") & (F.col("block_end") <= F.col("inner_cut"))).withColumn(
        "inner_val", F.col("fit") & (F.col("origin") >= F.col("inner_cut"))
    )
    rows = cut_lineage(rows.withColumn("t", S.micros(F.col("block_start"))).withColumn("week", S.epoch_week(F.col("block_start"))))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.array(*[F.col(c).cast("double") for c in cs]).alias("features")) for n, cs in sets.items()]))
    flags = ["train", "inner_val", "fit", "test"]
    long = rows.select(*keys, "block_start", "event", *flags, each.alias("s")).select(*keys, "block_start", "event", *flags, "s.*")
    p = cut_lineage(CT.fit_cases(long, [*keys, "model"], ["block_start"], "features", "event", "boosted", "train", "inner_val", "fit", "test", **settings))
    wide = p.groupBy(*keys, "block_start").agg(*[F.max(F.when(F.col("model") == n, F.col("p"))).alias(f"p_{n}") for n in sets])
    out = cut_lineage(O.join_groups(rows.where("test"), wide, [*keys, "block_start"]))
    probs = probability_report(out, keys, list(sets), "event", ["t"], "mean_value", fractions=(0.05, 0.1, 0.2, 0.3))
    budget = B.budget_interval(out, keys, "week", "event", "mean_value", "p_N_met", "p_N_met_f82", ["t"], seed, draws)
    overlap = K.overlap_table(K.flag_pair(out, keys, "p_N_met", "p_N_met_f82", ["t"], **BLOCKS), keys, "event", ["mean_value"], **BLOCKS)
    counts = rows.groupBy(*keys).agg(F.count_if("fit").alias("n_fit"), F.count_if("test").alias("n_test"), F.count_if("train").alias("n_inner_train"), F.count_if("inner_val").alias("n_inner_validation"))
    fitted = O.join_groups(p.groupBy(*keys, "model").agg(F.max("best_iteration").alias("best_iteration")), counts, keys)
    return {"scores": probs["scores"], "budgets": probs["budgets"], "budget_gains": budget, "overlap": overlap, "settings": fitted}

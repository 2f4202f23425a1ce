"""Alignment, cohorts, labels and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrain.functions import scalars as S
from hourgrain.operators import align as A, cohort as C, labels as L, rollup as R
from hourgrain.plans.q_spectra import rounded
from hourgrain.plans.registry import CTES, query, sql
from hourgrain.sources.views import Tables

SIX = "date_trunc('day', {t}) + to_hours((hour({t}) // 6 * 6)::BIGINT)"
SEASON = "(['DJF','MAM','JJA','SON'])[month({t}) % 12 // 3 + 1]"

CTES["blocks"] = (("good",), f"""SELECT c.site, c.block_start, c.block_start + INTERVAL 6 HOUR AS block_end, count(g.target) AS n_valid,
    avg(g.target) AS mean_value, month(c.block_start)::INT AS month, {SEASON.format(t='c.block_start')} AS season FROM
    (SELECT site, unnest(generate_series(a, b, INTERVAL 6 HOUR)) AS block_start FROM (SELECT site, {SIX.format(t='min(timestamp)')} AS a,
      {SIX.format(t='max(timestamp)')} AS b FROM good GROUP BY site)) c
    LEFT JOIN (SELECT *, {SIX.format(t='timestamp')} AS bs FROM good) g ON g.site = c.site AND g.bs = c.block_start GROUP BY c.site, c.block_start""")
CTES["origins"] = (("blocks", "hspec"), """SELECT b.*, lead_h, b.block_start - to_hours(lead_h) AS origin, h.timestamp IS NOT NULL AND h.total > 0 AS origin_valid,
    CASE WHEN h.total > 0 THEN h.total END AS total, CASE WHEN h.total > 0 THEN h.f82 END AS f82, CASE WHEN h.total > 0 THEN h.n82 END AS n82
    FROM (SELECT *, unnest([1, 3, 6]) AS lead_h FROM blocks) b LEFT JOIN hspec h ON h.timestamp = b.block_start - to_hours(lead_h)""")
# chronological cuts of the block calendar: outer test boundary and calibration cut per site
CTES["outer_cut"] = (("origins",), """SELECT site, list_sort(list(DISTINCT date_trunc('day', block_start)))[floor(0.8::DOUBLE * count(DISTINCT date_trunc('day', block_start)))::INT + 1]::TIMESTAMP
    AS outer_cut FROM origins WHERE n_valid >= 4 AND origin_valid GROUP BY site""")
CTES["cuts"] = (("origins", "outer_cut"), """SELECT site, any_value(outer_cut) AS outer_cut, list_sort(list(DISTINCT d))[floor(0.8::DOUBLE * count(DISTINCT d))::INT + 1]::TIMESTAMP AS cal_cut FROM
    (SELECT o.site, date_trunc('day', block_start) AS d, any_value(outer_cut) AS outer_cut FROM origins o JOIN outer_cut USING (site)
     WHERE n_valid >= 4 AND block_end <= outer_cut GROUP BY o.site, block_start HAVING count(*) FILTER (WHERE origin_valid) = 3) GROUP BY site""")
CTES["dcut"] = (("daily",), """SELECT site, list_sort(list(DISTINCT date_trunc('day', timestamp)))[floor(0.8::DOUBLE * count(DISTINCT date_trunc('day', timestamp)))::INT + 1]::TIMESTAMP AS cut,
    count(DISTINCT date_trunc('day', timestamp)) AS n_days FROM daily GROUP BY site""")
CTES["dfit"] = (("daily", "dcut"), """SELECT d.site, d.timestamp, d.value, month(d.timestamp)::INT AS month, c.cut, d.timestamp < c.cut AS fit, d.timestamp >= c.cut AS test
    FROM daily d JOIN dcut c USING (site)""")
CTES["dth"] = (("dfit",), """SELECT site, month, quantile_cont(value, 0.25) AS low_threshold, quantile_cont(value, 0.75) AS high_threshold, count(value) AS n_fit_blocks,
    count(DISTINCT timestamp::DATE) AS n_fit_days, count(value) >= 30 AS supported FROM dfit WHERE fit GROUP BY site, month""")


def blocks(t: Tables):
    return A.six_hour_blocks(t.good_hourly())


def origins(t: Tables, leads=(1, 3, 6)):
    h = t.hourly_spectra().where("total > 0").select(F.col("timestamp").alias("origin"), "total", "n82", "f82")
    b = blocks(t).withColumn("lead_h", F.explode(F.array(*[F.lit(x) for x in leads])))
    b = b.withColumn("origin", F.col("block_start") - S.hours_interval(F.col("lead_h")))
    return A.at_origin(b, h, "origin").withColumn("origin_valid", F.col("total").isNotNull())


def cuts(t: Tables, o=None):
    """Outer test boundary and calibration cut per site, both from dates before the test period."""
    o = origins(t) if o is None else o
    outer = C.date_fraction_cut(o.where("n_valid >= 4 AND origin_valid"), "site", "block_start", 0.8, "outer_cut").drop("n_days")
    pre = o.join(outer, "site").where("n_valid >= 4 AND block_end <= outer_cut").withColumn("eligible", F.col("origin_valid"))
    common = C.common_origins(pre, ["site", "block_start"], (1, 3, 6))
    return C.date_fraction_cut(common, "site", "block_start", 0.8, "cal_cut").drop("n_days").join(outer, "site")


def daily_split(t: Tables):
    d = t.daily()
    cut = C.date_fraction_cut(d, "site", "timestamp", 0.8)
    return d.join(cut.drop("n_days"), "site").withColumn("month", F.month("timestamp")).withColumn(
        "fit", F.col("timestamp") < F.col("cut")
    ).withColumn("test", F.col("timestamp") >= F.col("cut"))


def daily_thresholds(t: Tables):
    return L.month_thresholds(daily_split(t).where("fit"), ["site"], "value", "timestamp")


@query(
    "aln01_one_to_one",
    sql("good hspec", """SELECT g.site, g.timestamp, round(g.target, 6) AS target, round(total, 6) AS total FROM
      (SELECT site, timestamp, target FROM good) g JOIN (SELECT site, h.timestamp, total FROM hspec h, (SELECT DISTINCT site FROM good) WHERE total > 0) h USING (site, timestamp)"""),
)
def one_to_one(t: Tables):
    h = t.hourly_spectra().where("total > 0").select("timestamp", "total")
    g = t.good_hourly()
    # the stand-in spectra serve all five sites: each hour is repeated for the sites that have it
    per_site = g.select("site", "timestamp").join(h, "timestamp")
    return rounded(A.one_to_one(g, per_site, ["site", "timestamp"]))


@query(
    "aln02_exact_lead",
    sql("good", """SELECT g.site, g.timestamp, h AS lead_h, round(f.target, 6) AS future_target FROM (SELECT *, unnest(range(25))::INT AS h FROM good) g
    LEFT JOIN good f ON f.site = g.site AND f.timestamp = g.timestamp + to_hours(g.h)"""),
)
def exact_lead(t: Tables):
    g = t.good_hourly()
    e = A.exact_lead(g.select("site", "timestamp"), g, "site", range(25), {"target": "future_target"})
    return rounded(e.select("site", "timestamp", "lead_h", "future_target"))


@query(
    "aln03_row_lookup",
    sql("good cells", """SELECT g.site, g.timestamp, s.ok IS NOT NULL AS found, coalesce(s.ok, false) AS valid FROM good g LEFT JOIN
      (SELECT timestamp, count(v) = 64 AS ok FROM cells GROUP BY timestamp) s ON s.timestamp = g.timestamp + INTERVAL 3 HOUR"""),
)
def row_lookup(t: Tables):
    s = t.spectra().select("timestamp", F.forall("density", lambda v: v.isNotNull()).alias("valid")).withColumnRenamed("timestamp", "future_ts")
    g = t.good_hourly().select("site", "timestamp", (F.col("timestamp") + S.hours_interval(3)).alias("future_ts"))
    return A.lookup(g, s, ["future_ts"], "valid").drop("future_ts")


@query(
    "aln04_six_hour_blocks",
    sql("blocks", "SELECT site, block_start, block_end, n_valid, round(mean_value, 6) AS mean_value, month, season FROM blocks"),
)
def six_hour_blocks(t: Tables):
    return rounded(blocks(t))


@query(
    "aln05_block_origins",
    sql("origins", "SELECT site, block_start, lead_h, origin, origin_valid, round(total, 6) AS total, round(f82, 6) AS f82 FROM origins"),
)
def block_origins(t: Tables):
    g = t.good_hourly()
    h = t.hourly_spectra().where("total > 0").select("timestamp", "total", "f82")
    # predictors keyed by site as the archive has them
    sites = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
    keyed = h.withColumn("site", F.explode(sites)).withColumn("current_ok", F.lit(True))
    b = A.block_origins(A.six_hour_blocks(g), keyed, (1, 3, 6))
    return rounded(b.select("site", "block_start", "lead_h", "origin", "origin_valid", "total", "f82"))


@query(
    "aln06_six_step_history",
    sql("blocks hspec", """SELECT site, block_start, count(total) = 6 AS history_complete,
      coalesce(list(round(total, 4) ORDER BY k DESC) FILTER (WHERE total IS NOT NULL), []) AS total_history FROM
      (SELECT b.site, b.block_start, k, h.total FROM (SELECT *, unnest(range(6)) AS k FROM blocks) b
       LEFT JOIN (SELECT * FROM hspec WHERE total > 0) h ON h.timestamp = b.block_start - to_hours(3 + k)) GROUP BY site, block_start"""),
)
def six_step_history(t: Tables):
    b = blocks(t).withColumn("origin", F.col("block_start") - S.hours_interval(3)).withColumn("any", F.lit(1))
    h = t.hourly_spectra().where("total > 0").select(F.lit(1).alias("any"), "timestamp", "total")
    out = A.history(b.select("site", "block_start", "origin", "any"), h, ["site", "block_start", "any"], ["total"], key="any")
    empty = F.array().cast("array<double>")
    return out.select(
        "site", "block_start", "history_complete",
        F.coalesce(F.transform("total_history", lambda v: F.round(v, 4)), empty).alias("total_history"),
    )


@query(
    "aln07_recent_mean",
    sql("blocks good", """SELECT site, block_start, count(v) AS recent_n, round(CASE WHEN count(v) >= 4 THEN avg(v) END, 6) AS recent_mean,
      round(max(v) FILTER (WHERE k = 0), 6) AS current_value FROM (SELECT b.site, b.block_start, k, g.target AS v FROM (SELECT *, unnest(range(6)) AS k FROM blocks) b
      LEFT JOIN good g ON g.site = b.site AND g.timestamp = b.block_start - to_hours(3 + k)) GROUP BY site, block_start"""),
)
def recent_mean(t: Tables):
    b = blocks(t).select("site", "block_start", (F.col("block_start") - S.hours_interval(3)).alias("origin"))
    return rounded(A.recent_mean(b, t.good_hourly(), ["site", "block_start"], "target").drop("origin"))


@query(
    "aln08_month_threshold",
    sql("dfit dth", """SELECT d.site, d.timestamp, round(CASE WHEN t.n_fit_blocks >= 150 THEN high_threshold END, 6) AS threshold FROM dfit d LEFT JOIN dth t USING (site, month)"""),
)
def month_threshold(t: Tables):
    th = daily_thresholds(t).withColumn("supported", F.col("n_fit_blocks") >= 150)
    d = A.month_threshold(daily_split(t), th, ["site", "month"], "high_threshold")
    return rounded(d.select("site", "timestamp", "threshold"))


def weather(t: Tables, at_least=2):
    m = t.minutes()
    ok = F.when(S.qc_bits_ok(F.col("qc")), F.col("value"))
    return R.hourly_means(m.withColumn("ok", ok), ["var"], "ts", {"mean": F.col("ok")}, at_least, {"rain": F.col("ok")}, 3)


WX = """SELECT var, date_trunc('hour', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS origin, CASE WHEN count(x) >= 2 THEN avg(x) END AS mean,
    CASE WHEN count(x) = 3 THEN sum(x) END AS rain, count(x) AS n_mean FROM (SELECT var, ts, CASE WHEN (qc & ~8) = 0 THEN value END AS x FROM minutes) GROUP BY 1, 2"""

VARIABLES = ("click", "error", "purchase", "signup", "view")
MEANS = [f"mean_{v}" for v in VARIABLES]
WIDE_WX = f"SELECT origin, {', '.join(f'max(mean) FILTER (WHERE var = {v!r}) AS mean_{v}' for v in VARIABLES)} FROM w GROUP BY origin"


def wide_weather(t: Tables):
    """One row per origin with a column for each variable."""
    return weather(t).groupBy("origin").agg(*[F.max(F.when(F.col("var") == v, F.col("mean"))).alias(f"mean_{v}") for v in VARIABLES])


@query(
    "aln09_weather_at_origin",
    sql("origins minutes", f"SELECT site, block_start, lead_h, {', '.join(f'round(mean_{v}, 6) AS mean_{v}' for v in VARIABLES)} FROM origins LEFT JOIN ({WIDE_WX}) USING (origin)", w=WX),
)
def weather_at_origin(t: Tables):
    return rounded(A.at_origin(origins(t), wide_weather(t), "origin").select("site", "block_start", "lead_h", *MEANS))


@query(
    "aln10_align_predictions",
    sql("good", """SELECT g.site, g.timestamp, h AS lead_h, round(f.target * 2, 6) AS prediction, round(CASE WHEN hour(g.timestamp) < 6 THEN f.target * 3 END, 6) AS control
      FROM (SELECT *, unnest([1, 3])::INT AS h FROM good) g LEFT JOIN good f ON f.site = g.site AND f.timestamp = g.timestamp + to_hours(g.h)"""),
)
def align_predictions(t: Tables):
    g = t.good_hourly()
    rows = A.with_leads(g.select("site", "timestamp"), (1, 3))
    p = A.exact_lead(g.select("site", "timestamp"), g, "site", (1, 3), {"target": "f"}).where("f IS NOT NULL")
    p = p.withColumn("p", F.col("f") * 2).withColumn("c", F.when(F.hour("timestamp") < 6, F.col("f") * 3))
    out = A.align_predictions(rows, p, ["site", "timestamp", "lead_h"], {"p": "prediction", "c": "control"})
    return rounded(out.select("site", "timestamp", "lead_h", "prediction", "control"))


def lead_rows(t: Tables, leads=tuple(range(1, 25))):
    """Hours with a spectrum and the future target at each lead, with eligibility and the cut."""
    h = t.hourly_spectra().where("total > 0").select("timestamp", "total", "n82", "f82")
    hours = t.hourly().select("site", "timestamp", F.col("target").alias("now"), F.col("instrument_ok").alias("now_ok"))
    cut = C.date_fraction_cut(t.observations(), "site", "timestamp", 0.7).drop("n_days")
    e = A.exact_lead(hours.join(h, "timestamp"), t.hourly(), "site", leads, {"target": "future", "instrument_ok": "future_ok"})
    e = e.withColumn("eligible", S.usable_value(F.col("future")) & S.known_true(F.col("future_ok"))).join(cut, "site")
    fit, test = C.hourly_split(F.col("timestamp"), F.col("lead_h"), F.col("eligible"), F.col("cut"))
    return e.withColumn("fit", fit).withColumn("test", test)


CTES["hcut"] = (("obs",), """SELECT site, list_sort(list(DISTINCT date_trunc('day', timestamp)))[floor(0.7::DOUBLE * count(DISTINCT date_trunc('day', timestamp)))::INT + 1]::TIMESTAMP AS cut
    FROM obs GROUP BY site""")
CTES["leads"] = (("hourly", "hspec", "hcut"), """SELECT *, eligible AND timestamp + to_hours(lead_h) < cut AS fit, eligible AND timestamp >= cut AS test FROM
    (SELECT a.site, a.timestamp, a.lead_h, a.target AS now, a.instrument_ok AS now_ok, h.total, h.n82, h.f82, f.target AS future,
     coalesce(f.target >= 0, false) AND coalesce(f.instrument_ok, false) AS eligible, c.cut
     FROM (SELECT *, unnest(range(1, 25))::INT AS lead_h FROM hourly) a JOIN hspec h ON h.timestamp = a.timestamp AND h.total > 0 JOIN hcut c ON c.site = a.site
     LEFT JOIN hourly f ON f.site = a.site AND f.timestamp = a.timestamp + to_hours(a.lead_h))""")


@query("coh01_label_end_purge", sql("leads", "SELECT site, timestamp, lead_h, fit, test FROM leads"))
def label_end_purge(t: Tables):
    return lead_rows(t).select("site", "timestamp", "lead_h", "fit", "test")


@query("coh02_eligibility", sql("leads", "SELECT site, lead_h, count(*) AS n_hours, count(*) FILTER (WHERE eligible) AS n_eligible FROM leads GROUP BY site, lead_h"))
def eligibility(t: Tables):
    return lead_rows(t).groupBy("site", "lead_h").agg(F.count("*").alias("n_hours"), F.count_if("eligible").alias("n_eligible"))


SITE_LIST = ", ".join(f"'{s}'" for s in C.TEST_BOUNDARIES)


@query(
    "coh03_site_boundaries",
    f"""SELECT site, boundary, count(*) AS n, count(*) FILTER (WHERE x >= boundary) AS n_test FROM
    (SELECT ([{SITE_LIST}])[o_custkey % 9 + 1] AS site, o_orderdate + INTERVAL 22 YEAR AS x FROM orders) JOIN
    (SELECT unnest([{SITE_LIST}]) AS site, unnest([{', '.join("TIMESTAMP '" + v + "'" for v in C.TEST_BOUNDARIES.values())}]) AS boundary) USING (site) GROUP BY site, boundary""",
)
def site_boundaries(t: Tables):
    names = F.array(*[F.lit(s) for s in C.TEST_BOUNDARIES])
    o = t.read("orders").select(
        F.get(names, (F.col("o_custkey") % 9).cast("int")).alias("site"), (F.col("o_orderdate") + F.expr("INTERVAL 22 YEARS")).alias("x")
    ).withColumn("boundary", C.site_boundary(F.col("site")))
    return o.groupBy("site", "boundary").agg(F.count("*").alias("n"), F.count_if(F.col("x") >= F.col("boundary")).alias("n_test"))


@query(
    "coh04_common_origins",
    sql("leads", " UNION ALL ".join(f"""SELECT '{n}' AS cohort, site, timestamp FROM leads WHERE lead_h IN {tuple(s)} GROUP BY site, timestamp
      HAVING count(*) FILTER (WHERE eligible) = {len(s)}""" for n, s in (("1to6", range(1, 7)), ("1to24", range(1, 25)), ("136", (1, 3, 6))))),
)
def common_origins(t: Tables):
    e = lead_rows(t)
    parts = [
        C.common_origins(e, ["site", "timestamp"], s).select(F.lit(n).alias("cohort"), "site", "timestamp")
        for n, s in (("1to6", range(1, 7)), ("1to24", range(1, 25)), ("136", (1, 3, 6)))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("coh05_date_fraction_cut", sql("dcut", "SELECT site, cut, n_days FROM dcut"))
def date_fraction_cut(t: Tables):
    return C.date_fraction_cut(t.daily(), "site", "timestamp", 0.8)


PART = """CASE WHEN n_valid >= 4 AND origin_valid AND block_end <= cal_cut THEN 'fit' WHEN n_valid >= 4 AND origin_valid AND block_start >= cal_cut AND block_end <= outer_cut THEN 'calibration'
    WHEN n_valid >= 4 AND origin_valid AND origin >= outer_cut THEN 'test' END"""
CTES["parts"] = (("origins", "cuts"), f"SELECT o.*, c.cal_cut, c.outer_cut, {PART} AS partition FROM origins o JOIN cuts c USING (site)")


def partitioned(t: Tables):
    o = origins(t).join(cuts(t), "site")
    ok = (F.col("n_valid") >= 4) & F.col("origin_valid")
    return o.withColumn("partition", C.block_partition(*[F.col(c) for c in ("block_start", "block_end", "origin", "cal_cut", "outer_cut")], ok))


@query("coh06_block_partitions", sql("parts", "SELECT site, block_start, lead_h, coalesce(partition, 'none') AS partition FROM parts"))
def block_partitions(t: Tables):
    return partitioned(t).select("site", "block_start", "lead_h", F.coalesce("partition", F.lit("none")).alias("partition"))


@query(
    "coh07_inner_split",
    sql("parts", """SELECT p.site, block_start, coalesce(CASE WHEN block_end <= inner_cut THEN 'train' WHEN block_start >= inner_cut THEN 'validation' END, 'none') AS inner_partition
      FROM parts p JOIN i USING (site) WHERE partition = 'fit' AND lead_h = 3""",
      i="""SELECT site, list_sort(list(DISTINCT d))[floor(0.8::DOUBLE * count(DISTINCT d))::INT + 1]::TIMESTAMP + INTERVAL 3 HOUR AS inner_cut FROM
        (SELECT site, date_trunc('day', block_start) AS d FROM parts WHERE partition = 'fit' AND lead_h = 3) GROUP BY site"""),
)
def inner_split(t: Tables):
    p = partitioned(t).where("partition = 'fit' AND lead_h = 3")
    i = C.date_fraction_cut(p, "site", "block_start", 0.8, "inner_cut").drop("n_days")
    # shifted off the block grid so that one block straddles the cut
    i = i.withColumn("inner_cut", F.col("inner_cut") + S.hours_interval(3))
    part = C.inner_partition(F.col("block_start"), F.col("block_end"), F.col("inner_cut"))
    return p.join(i, "site").select("site", "block_start", F.coalesce(part, F.lit("none")).alias("inner_partition"))


@query(
    "coh08_fold_plan",
    sql("dfit", """SELECT f.site, fold, lft AS "left", rgt AS "right", count(*) FILTER (WHERE timestamp < lft) AS n_fit,
      count(*) FILTER (WHERE timestamp >= lft AND timestamp < rgt) AS n_score FROM f JOIN (SELECT * FROM dfit WHERE fit) d USING (site) GROUP BY f.site, fold, lft, rgt""",
      d1="SELECT site, list_sort(list(DISTINCT date_trunc('day', timestamp)::TIMESTAMP)) AS d, any_value(cut) AS e FROM dfit WHERE fit GROUP BY site",
      f="""SELECT site, unnest([0, 1, 2, 3])::INT AS fold, unnest([d[floor(len(d) * 0.2::DOUBLE)::INT + 1], d[floor(len(d) * 0.4::DOUBLE)::INT + 1], d[floor(len(d) * 0.6::DOUBLE)::INT + 1],
        d[floor(len(d) * 0.8::DOUBLE)::INT + 1]]) AS lft, unnest([d[floor(len(d) * 0.4::DOUBLE)::INT + 1], d[floor(len(d) * 0.6::DOUBLE)::INT + 1], d[floor(len(d) * 0.8::DOUBLE)::INT + 1], e]) AS rgt FROM d1"""),
)
def fold_plan(t: Tables):
    d = daily_split(t).where("fit")
    f = C.fold_plan(d, "site", "timestamp", "cut")
    n = C.assign_folds(d, f, "site", "timestamp").groupBy("site", "fold").agg(
        F.count_if(F.col("role") == "fit").alias("n_fit"), F.count_if(F.col("role") == "score").alias("n_score")
    )
    return f.join(n, ["site", "fold"])


@query(
    "coh09_support",
    sql("leads", """SELECT site, lead_h, count(*) FILTER (WHERE fit) AS n_fit, count(*) FILTER (WHERE test) AS n_test, count(DISTINCT CASE WHEN test THEN timestamp::DATE END) AS n_test_dates,
      min(timestamp) FILTER (WHERE test) AS test_start, max(timestamp) FILTER (WHERE test) AS test_end, count(*) FILTER (WHERE fit AND now_ok) AS n_control_fit,
      CASE WHEN count(*) FILTER (WHERE fit) >= 100 AND count(*) FILTER (WHERE test) >= 75 THEN 'supported' ELSE 'insufficient_hours' END AS status FROM leads GROUP BY site, lead_h"""),
)
def support(t: Tables):
    return C.support_table(lead_rows(t), ["site", "lead_h"], min_test=75, extra={"n_control_fit": F.count_if(F.col("fit") & F.col("now_ok"))})


@query(
    "coh10_boundary_crossings",
    sql("parts", """SELECT site, lead_h, boundary_name, boundary, origin, block_start, block_end, coalesce(partition, 'none') AS partition FROM
      (SELECT *, 'fit_calibration' AS boundary_name, cal_cut AS boundary FROM parts UNION ALL SELECT *, 'calibration_test', outer_cut FROM parts)
      WHERE origin < boundary AND block_end > boundary"""),
)
def boundary_crossings(t: Tables):
    x = C.boundary_crossings(partitioned(t), {"fit_calibration": "cal_cut", "calibration_test": "outer_cut"})
    return x.select("site", "lead_h", "boundary_name", "boundary", "origin", "block_start", "block_end", F.coalesce("partition", F.lit("none")).alias("partition"))


@query(
    "coh11_monthly_coverage",
    sql("dfit", """SELECT s.site, s.stage, m.month, count(d.site) AS n, count(d.site) FILTER (WHERE d.value > 100000) AS n_high FROM
      (SELECT DISTINCT site, CASE WHEN fit THEN 'fit' ELSE 'test' END AS stage FROM dfit) s CROSS JOIN (SELECT unnest(range(1, 13))::INT AS month) m
      LEFT JOIN dfit d ON d.site = s.site AND d.month = m.month AND d.fit = (s.stage = 'fit') GROUP BY s.site, s.stage, m.month"""),
)
def monthly_coverage(t: Tables):
    d = daily_split(t).withColumn("stage", F.when(F.col("fit"), "fit").otherwise("test"))
    return C.monthly_coverage(d, ["site", "stage"], {"n": F.count("*"), "n_high": F.count_if(F.col("value") > 100000)})


@query(
    "coh12_class_support",
    sql("dfit dth", """SELECT site, partition, count(*) AS n, sum(e::INT)::BIGINT AS n_events, sum(e::INT) >= 15 AND count(*) - sum(e::INT) >= 15 AS supported FROM
      (SELECT site, CASE WHEN fit THEN 'fit' ELSE 'test' END AS partition, coalesce(supported AND value >= high_threshold, false) AS e FROM dfit LEFT JOIN dth USING (site, month)) GROUP BY site, partition"""),
)
def class_support(t: Tables):
    d = labelled_daily(t).withColumn("partition", F.when(F.col("fit"), "fit").otherwise("test"))
    return C.class_support(d, ["site"], "partition", "high")


def labelled_daily(t: Tables):
    d = L.with_thresholds(daily_split(t), daily_thresholds(t), ["site"])
    return d.withColumn("high", L.is_high(F.col("value"), F.col("high_threshold"))).withColumn("low", L.is_low(F.col("value"), F.col("low_threshold")))


@query(
    "coh13_matched_rows",
    sql("origins minutes", f"""SELECT site, lead_h, count(*) AS n_all, count(*) FILTER (WHERE total IS NOT NULL AND mean_click IS NOT NULL AND mean_error IS NOT NULL
      AND mean_purchase IS NOT NULL AND mean_signup IS NOT NULL AND mean_view IS NOT NULL) AS n_matched FROM origins LEFT JOIN ({WIDE_WX}) USING (origin) GROUP BY site, lead_h""", w=WX),
)
def matched_rows(t: Tables):
    rows = A.at_origin(origins(t), wide_weather(t), "origin")
    m = C.matched_rows(rows, ["total", *MEANS]).groupBy("site", "lead_h").agg(F.count("*").alias("n_matched"))
    n = rows.groupBy("site", "lead_h").agg(F.count("*").alias("n_all"))
    return n.join(m, ["site", "lead_h"], "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))


@query(
    "coh14_complete_cohort",
    sql("hourly cells hcut", """SELECT a.site, a.timestamp, round(a.target, 6) AS target, round(f.target, 6) AS future_target, a.timestamp + INTERVAL 3 HOUR < cut AS fit, a.timestamp >= cut AS test
      FROM hourly a JOIN hcut c USING (site) JOIN hourly f ON f.site = a.site AND f.timestamp = a.timestamp + INTERVAL 3 HOUR
      JOIN s n ON n.timestamp = a.timestamp JOIN s l ON l.timestamp = f.timestamp
      WHERE a.instrument_ok AND f.instrument_ok AND n.ok AND l.ok AND (a.timestamp + INTERVAL 3 HOUR < cut OR a.timestamp >= cut)""",
      s="SELECT timestamp, count(v) >= 63 AS ok FROM cells GROUP BY timestamp"),
)
def complete_cohort(t: Tables):
    cut = C.date_fraction_cut(t.observations(), "site", "timestamp", 0.7).drop("n_days")
    now = t.hourly().join(cut, "site").select("site", "timestamp", "target", F.col("instrument_ok").alias("target_ok"), F.lit(True).alias("spectrum_ok"), "cut")
    sites = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
    ok = F.size(F.filter("density", lambda v: v.isNotNull())) >= 63
    spectra = t.spectra().select(F.explode(sites).alias("site"), "timestamp", ok.alias("mapped_ok"))
    c = C.complete_cohort(now, spectra, "site", 3, F.col("cut"))
    return rounded(c.select("site", "timestamp", "target", "future_target", "fit", "test"))


@query(
    "blk01_month_thresholds",
    sql("dth", """SELECT site, month, round(low_threshold, 6) AS low_threshold, round(high_threshold, 6) AS high_threshold, n_fit_blocks, n_fit_days, supported FROM dth"""),
)
def month_thresholds(t: Tables):
    return rounded(daily_thresholds(t))


@query(
    "blk02_labels",
    sql("dfit dth", """SELECT d.site, d.timestamp, supported IS NOT NULL AND supported AND value >= high_threshold AS high, supported IS NOT NULL AND supported AND value <= low_threshold AS low, value >= pooled AS pooled_high
      FROM dfit d LEFT JOIN dth USING (site, month) JOIN (SELECT site, quantile_cont(value, 0.75) AS pooled FROM dfit WHERE fit GROUP BY site) USING (site)"""),
)
def labels(t: Tables):
    pooled = L.pooled_thresholds(daily_split(t).where("fit"), ["site"], "value")
    d = labelled_daily(t).join(pooled, "site")
    return d.select("site", "timestamp", "high", "low", L.is_high(F.col("value"), F.col("pooled_high")).alias("pooled_high"))


# Day rows of an order series stand in for the hours of a block: six consecutive epoch days form one block.
CTES["dblocks"] = (("dfit",), """SELECT *, date_diff('day', DATE '1970-01-01', timestamp::DATE) // 6 AS block FROM dfit""")


def day_blocks(t: Tables):
    return daily_split(t).withColumn("block_start", F.floor(S.epoch_day(F.col("timestamp")) / 6).cast("bigint"))


@query(
    "blk03_median_label",
    sql("dblocks", """SELECT site, block AS block_start, round(med, 6) AS median_value, coalesce(med >= q, false) AS median_high FROM b LEFT JOIN
      (SELECT site, month, quantile_cont(med, 0.75) AS q FROM b WHERE fit GROUP BY site, month) USING (site, month)""",
      b="SELECT site, block, min(month) AS month, quantile_cont(value, 0.5) AS med, bool_and(fit) AS fit FROM dblocks GROUP BY site, block"),
)
def median_label(t: Tables):
    b = day_blocks(t).groupBy("site", "block_start").agg(
        F.min("month").alias("month"), F.percentile("value", F.lit(0.5)).alias("median_value"), F.bool_and("fit").alias("fit"),
        F.min("timestamp").alias("timestamp"),
    )
    th = L.month_thresholds(b.where("fit"), ["site"], "median_value", "timestamp", at_least=0)
    out = L.with_thresholds(b, th, ["site"])
    return rounded(out.select("site", "block_start", "median_value", L.is_high(F.col("median_value"), F.col("high_threshold")).alias("median_high")))


BLOCK_HOURS_SQL = """SELECT site, block AS block_start, {cols} FROM (SELECT d.*, high_threshold AS th FROM dblocks d LEFT JOIN dth USING (site, month)) GROUP BY site, block"""


@query(
    "blk04_sustained_label",
    sql("dblocks dth", BLOCK_HOURS_SQL.format(cols="count(value) = 6 AND bool_and(value >= th * 0.8) AS sustained_high")),
)
def sustained_label(t: Tables):
    th = daily_thresholds(t).withColumn("high_threshold", F.col("high_threshold") * 0.8)
    return L.block_hours(day_blocks(t), th, ["site"], "value").select("site", "block_start", "sustained_high")


@query(
    "blk05_block_descriptors",
    sql("dblocks dth", BLOCK_HOURS_SQL.format(cols="""round(max(value), 6) AS max_value, count(*) FILTER (WHERE value >= th) AS hours_ge_threshold,
      round(max(value) / sum(value), 6) AS max_hour_share, round(quantile_cont(value, 0.5), 6) AS median_value""")),
)
def block_descriptors(t: Tables):
    return rounded(L.block_hours(day_blocks(t), daily_thresholds(t), ["site"], "value").drop("sustained_high"))


@query("agg01_right_closed_hour", sql("minutes", "SELECT var, origin, round(mean, 6) AS mean FROM w", w=WX))
def right_closed_hour(t: Tables):
    return rounded(weather(t).select("var", "origin", "mean"))


@query("agg02_full_hour_sum", sql("minutes", "SELECT var, origin, round(rain, 6) AS rain FROM w", w=WX))
def full_hour_sum(t: Tables):
    return rounded(weather(t).select("var", "origin", "rain"))


@query("agg03_minute_counts", sql("minutes", "SELECT var, origin, n_mean FROM w", w=WX))
def minute_counts(t: Tables):
    return weather(t).select("var", "origin", "n_mean")


@query(
    "agg04_gain_summary",
    """SELECT task, round(median(gain), 6) AS median_gain, count(*) AS n, count(*) FILTER (WHERE gain > 0) AS n_positive, count(*) FILTER (WHERE low > 0) AS n_positive_lower FROM
      (SELECT l_linestatus AS task, l_suppkey, avg(l_discount - l_tax) AS gain, avg(l_discount - l_tax) - stddev_pop(l_discount - l_tax) / sqrt(count(*)) AS low
       FROM lineitem GROUP BY l_linestatus, l_suppkey) GROUP BY task""",
)
def gain_summary(t: Tables):
    x = F.col("l_discount") - F.col("l_tax")
    g = t.read("lineitem").groupBy(F.col("l_linestatus").alias("task"), "l_suppkey").agg(
        F.avg(x).alias("gain"), (F.avg(x) - F.stddev_pop(x) / F.sqrt(F.count("*"))).alias("low")
    )
    return rounded(R.gain_summary(g, ["task"], "gain", "low"))


R2 = "1 - sum(({y} - {p}) ** 2) / (var_pop({y}) * count(*))"


@query(
    "agg05_physical_bridge",
    sql("obs", f"""SELECT site, count(*) AS n, {', '.join(f"round(quantile_cont({e}, {q}), 6) AS {n}" for n, e, q in (
      ("ratio_now_q10", "target / n82", 0.1), ("ratio_now_median", "target / n82", 0.5), ("ratio_now_q90", "target / n82", 0.9),
      ("ratio_future_median", "ft / fn", 0.5), ("median_abs_log_change", "abs(lfn - ln_)", 0.5)))},
      round({R2.format(y='lfn', p='ln_')}, 6) AS r2_persistence, round({R2.format(y='lft', p='lfn')}, 6) AS r2_lookahead, round({R2.format(y='lft', p='ln_')}, 6) AS r2_from_now
      FROM (SELECT a.*, b.target AS ft, b.n82 AS fn, ln(1 + a.n82) AS ln_, ln(1 + b.n82) AS lfn, ln(1 + b.target) AS lft FROM obs a JOIN obs b ON a.site = b.site AND b.timestamp = a.timestamp + INTERVAL 3 HOUR)
      GROUP BY site"""),
)
def physical_bridge(t: Tables):
    o = t.observations()
    e = A.exact_lead(o, o, "site", (3,), {"target": "future_target", "n82": "future_n82"}).where("future_target IS NOT NULL")
    return rounded(R.physical_bridge(e, ["site"], "target", "n82", "future_target", "future_n82"))


@query(
    "agg06_stratified_contrast",
    sql("leads", """SELECT site, count(*) FILTER (WHERE fit AND mid) AS n_fit_middle, count(*) FILTER (WHERE test AND mid) AS n_test_middle, count(*) FILTER (WHERE g = 'low') AS n_test_low,
      count(*) FILTER (WHERE g = 'high') AS n_test_high, CASE WHEN least(count(*) FILTER (WHERE g = 'low'), count(*) FILTER (WHERE g = 'high')) >= 5 THEN 'contrast' ELSE 'insufficient_test_groups' END AS status,
      CASE WHEN least(count(*) FILTER (WHERE g = 'low'), count(*) FILTER (WHERE g = 'high')) >= 5 THEN round(median(total) FILTER (WHERE g = 'low'), 6) END AS n_low_median,
      CASE WHEN least(count(*) FILTER (WHERE g = 'low'), count(*) FILTER (WHERE g = 'high')) >= 5 THEN round(median(future) FILTER (WHERE g = 'high') - median(future) FILTER (WHERE g = 'low'), 6) END AS outcome_difference,
      CASE WHEN least(count(*) FILTER (WHERE g = 'low'), count(*) FILTER (WHERE g = 'high')) >= 5 THEN round(median(future) FILTER (WHERE g = 'high') / median(future) FILTER (WHERE g = 'low'), 6) END AS outcome_ratio
      FROM (SELECT *, CASE WHEN test AND mid AND f82 >= f75 THEN 'high' WHEN test AND mid AND f82 <= f25 THEN 'low' END AS g FROM m JOIN c USING (site)) GROUP BY site""",
      l3="SELECT * FROM leads WHERE lead_h = 3",
      m="""SELECT l3.*, total BETWEEN q30 AND q70 AS mid FROM l3 JOIN (SELECT site, quantile_cont(total, 0.3) AS q30, quantile_cont(total, 0.7) AS q70 FROM l3 WHERE fit GROUP BY site) USING (site)""",
      c="SELECT site, quantile_cont(f82, 0.25) AS f25, quantile_cont(f82, 0.75) AS f75 FROM m WHERE fit AND mid GROUP BY site"),
)
def stratified_contrast(t: Tables):
    c = R.stratified_contrast(lead_rows(t, (3,)), "site", "total", "f82", "future", at_least=5)
    c = c.select(
        "site", "n_fit_middle", "n_test_middle", "n_test_low", "n_test_high", "status", "n_low_median", "outcome_difference", "outcome_ratio"
    )
    return rounded(c)

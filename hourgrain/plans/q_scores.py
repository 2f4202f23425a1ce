"""Ranking, metrics and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrain.functions import scalars as S
from hourgrain.operators import metrics as M, ordering as O, ranking as K, resampling as B
from hourgrain.plans.q_spectra import rounded
from hourgrain.plans.registry import CTES, query, sql
from hourgrain.sources.views import Tables

TIES = ["t", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
TIE_SQL = "block_start, l_orderkey, l_linenumber, l_partkey, l_suppkey"

CTES["ev"] = (("pred",), f"""SELECT *, (target > 60)::INT AS event, strftime(block_start, '%Y-%m') AS ym, day // 7 AS week,
    (['DJF','MAM','JJA','SON'])[month(block_start) % 12 // 3 + 1] AS season FROM pred""")
CTES["rk"] = (("ev",), f"""SELECT *, row_number() OVER (PARTITION BY site ORDER BY prob0 DESC, {TIE_SQL}) AS r0,
    row_number() OVER (PARTITION BY site ORDER BY prob1 DESC, {TIE_SQL}) AS r1, count(*) OVER (PARTITION BY site) AS n_site,
    row_number() OVER (PARTITION BY site, ym ORDER BY prob0 DESC, {TIE_SQL}) AS m0,
    row_number() OVER (PARTITION BY site, ym ORDER BY prob1 DESC, {TIE_SQL}) AS m1, count(*) OVER (PARTITION BY site, ym) AS n_month FROM ev""")
LONG = "SELECT *, 'base' AS model, {a} AS p FROM {t} UNION ALL SELECT *, 'added', {b} FROM {t}"


def events(t: Tables):
    return t.predictions().withColumn("event", (F.col("target") > 60).cast("int")).withColumn(
        "ym", S.month_key(F.col("block_start"))
    ).withColumn("week", S.epoch_week(F.col("block_start"))).withColumn("season", S.season_of(F.month("block_start")))


def long_events(t: Tables, *more):
    return K.melt(events(t), ["site", "event", "target", *TIES, *more], {"base": "prob0", "added": "prob1"})


@query(
    "rnk01_stable_top",
    sql("rk", f"""SELECT 'base' AS model, site, l_orderkey, l_linenumber, l_partkey, event FROM rk WHERE r0 <= ceil(0.1::DOUBLE * n_site)
      UNION ALL SELECT 'added', site, l_orderkey, l_linenumber, l_partkey, event FROM rk WHERE r1 <= ceil(0.1::DOUBLE * n_site)"""),
)
def stable_top(t: Tables):
    top = K.select_top(long_events(t), ["site", "model"], "p", TIES)
    return top.select("model", "site", "l_orderkey", "l_linenumber", "l_partkey", "event")


@query(
    "rnk02_budgets",
    sql("rk", """SELECT site, model, f AS fraction, count(*) AS n_test, sum(event)::BIGINT AS n_events, count(*) FILTER (WHERE s) AS selected,
      sum(CASE WHEN s THEN event ELSE 0 END)::BIGINT AS hits, round(sum(CASE WHEN s THEN event ELSE 0 END) / count(*) FILTER (WHERE s), 6) AS precision,
      round(sum(CASE WHEN s THEN event ELSE 0 END) / sum(event), 6) AS recall, round(quantile_cont(CASE WHEN s THEN target END, 0.5), 6) AS median_value FROM
      (SELECT *, r <= ceil(f * n_site) AS s FROM (SELECT *, unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS f FROM
        (SELECT site, 'base' AS model, event, target, n_site, r0 AS r FROM rk UNION ALL SELECT site, 'added', event, target, n_site, r1 FROM rk))) GROUP BY site, model, f"""),
)
def budgets(t: Tables):
    return rounded(K.budget_table(long_events(t), ["site", "model"], "p", "event", "target", TIES), "fraction")


@query(
    "rnk03_within_month",
    sql("rk", """SELECT site, ym, count(*) AS n, sum(CASE WHEN m0 <= ceil(0.1::DOUBLE * n_month) THEN event ELSE 0 END)::BIGINT AS hits_base,
      sum(CASE WHEN m1 <= ceil(0.1::DOUBLE * n_month) THEN event ELSE 0 END)::BIGINT AS hits_added FROM rk GROUP BY site, ym"""),
)
def within_month(t: Tables):
    f = K.flag_pair(events(t), ["site", "ym"], "prob0", "prob1", TIES)
    e = F.col("event").cast("bigint")
    return f.groupBy("site", "ym").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("in_base"), e).otherwise(0)).alias("hits_base"),
        F.sum(F.when(F.col("in_added"), e).otherwise(0)).alias("hits_added"),
    )


FLAG_SQL = "SELECT *, r0 <= ceil(0.1::DOUBLE * n_site) AS a, r1 <= ceil(0.1::DOUBLE * n_site) AS b FROM rk"


@query(
    "rnk04_overlap",
    sql("rk", """SELECT site, CASE WHEN a AND b THEN 'both' WHEN a THEN 'base_only' WHEN b THEN 'added_only' ELSE 'neither' END AS selection, count(*) AS n,
      sum(event)::BIGINT AS events, round(quantile_cont(target, 0.25), 6) AS target_q25, round(quantile_cont(target, 0.5), 6) AS target_median,
      round(quantile_cont(target, 0.75), 6) AS target_q75 FROM f GROUP BY 1, 2""", f=FLAG_SQL),
)
def overlap(t: Tables):
    return rounded(K.overlap_table(K.flag_pair(events(t), ["site"], "prob0", "prob1", TIES), ["site"], "event", ["target"]))


CONTRAST = """avg(event) FILTER (WHERE b) - avg(event) FILTER (WHERE a) AS precision_gain, median(target) FILTER (WHERE b) - median(target) FILTER (WHERE a) AS median_ratio_gain,
      median(target) FILTER (WHERE b AND NOT a) - median(target) FILTER (WHERE a AND NOT b) AS exclusive_median_gain"""


@query(
    "rnk05_contrasts",
    sql("rk", f"""SELECT ranking, site, round(precision_gain, 6) AS precision_gain, round(median_ratio_gain, 6) AS median_ratio_gain, round(exclusive_median_gain, 6) AS exclusive_median_gain FROM
      (SELECT 'global' AS ranking, site, {CONTRAST} FROM f GROUP BY site UNION ALL SELECT 'within_year_month', site, {CONTRAST} FROM
        (SELECT *, m0 <= ceil(0.1::DOUBLE * n_month) AS a, m1 <= ceil(0.1::DOUBLE * n_month) AS b FROM rk) GROUP BY site)""", f=FLAG_SQL),
)
def contrasts(t: Tables):
    e = events(t)
    parts = []
    for name, keys in (("global", ["site"]), ("within_year_month", ["site", "ym"])):
        c = K.contrast_table(K.flag_pair(e, keys, "prob0", "prob1", TIES), ["site"], "event", "target")
        parts.append(c.withColumn("ranking", F.lit(name)))
    return rounded(parts[0].unionByName(parts[1]))


R2 = "(1 - sum((y - {p}) ** 2) / (var_pop(y) * count(*)))"


@query("evl01_r2", sql("pred", f"SELECT site, count(*) AS n, round({R2.format(p='p0')}, 6) AS r2_base, round({R2.format(p='p1')}, 6) AS r2_added FROM pred GROUP BY site"))
def r2(t: Tables):
    y = F.col("y")
    return rounded(t.predictions().groupBy("site").agg(
        F.count("*").alias("n"), M.r2(y, F.col("p0")).alias("r2_base"), M.r2(y, F.col("p1")).alias("r2_added")
    ))


@query(
    "evl02_regression_scores",
    sql("pred", "\nUNION ALL ".join(f"""SELECT site, '{m}' AS model, count(*) AS n, round({R2.format(p=p)}, 6) AS r2_log, round(avg(abs(y - {p})), 6) AS mae_log,
      round(avg(abs(exp(y) - exp({p}))), 6) AS mae_raw, round(avg(exp({p}) - exp(y)), 6) AS mean_bias FROM pred GROUP BY site""" for m, p in (("base", "p0"), ("added", "p1")))),
)
def regression_scores(t: Tables):
    long = K.melt(t.predictions(), ["site", "y"], {"base": "p0", "added": "p1"})
    return rounded(M.regression_scores(long, ["site", "model"], "y", "p"))


@query(
    "evl03_brier",
    sql("ev", f"""SELECT site, model, count(*) AS n, sum(event)::BIGINT AS events, round(avg((p - event) ** 2), 6) AS brier, count(DISTINCT p) AS distinct_probabilities,
      round(1 - avg((p - event) ** 2) / avg((0.25 - event) ** 2), 6) AS brier_skill FROM ({LONG.format(a='prob0', b='prob1', t='ev')}) GROUP BY site, model"""),
)
def brier(t: Tables):
    long = long_events(t).withColumn("prior", F.lit(0.25))
    return rounded(M.probability_scores(long, ["site", "model"], "event", "p", "prior"))


AP = """SELECT {k}, sum(h * ch / cn) / nullif(sum(h), 0) AS average_precision FROM (SELECT *, sum(h) OVER w AS ch, sum(n) OVER w AS cn FROM
      (SELECT {k}, p, count(*) AS n, sum(event) AS h FROM ({t}) GROUP BY {k}, p) WINDOW w AS (PARTITION BY {k} ORDER BY p DESC)) GROUP BY {k}"""


@query(
    "evl04_average_precision",
    sql("ev", f"SELECT site, model, round(average_precision, 6) AS average_precision FROM ({AP.format(k='site, model', t=LONG.format(a='prob0', b='prob1', t='ev'))})"),
)
def average_precision(t: Tables):
    return rounded(M.average_precision(long_events(t), ["site", "model"], "event", "p"))


@query(
    "evl05_alarm_counts",
    sql("ev", """SELECT site, count(*) FILTER (WHERE prob1 > 0.6 AND event = 1) AS hits, count(*) FILTER (WHERE NOT prob1 > 0.6 AND event = 1) AS misses,
      count(*) FILTER (WHERE prob1 > 0.6 AND event = 0) AS false_alarms, round(count(*) FILTER (WHERE prob1 > 0.6 AND event = 0) / count(*) FILTER (WHERE event = 0), 6) AS false_alarm_rate
      FROM ev GROUP BY site"""),
)
def alarm_counts(t: Tables):
    return rounded(M.alarm_counts(events(t).withColumn("alarm", F.col("prob1") > 0.6), ["site"], "event", "alarm"))


@query(
    "evl06_reliability",
    sql("ev", """SELECT s.site, b.bin, count(e.site) AS n, round(avg(e.p), 6) AS mean_probability, round(avg(e.event), 6) AS observed_frequency FROM (SELECT DISTINCT site FROM ev) s
      CROSS JOIN (SELECT unnest(range(10))::INT AS bin) b LEFT JOIN (SELECT *, prob1 * 0.7 AS p FROM ev) e ON e.site = s.site AND least(floor(e.p * 10), 9) = b.bin GROUP BY s.site, b.bin"""),
)
def reliability(t: Tables):
    return rounded(M.reliability(events(t).withColumn("p", F.col("prob1") * 0.7), ["site"], "event", "p"))


@query(
    "evl07_strata",
    sql("ev", f"""SELECT k.site, k.lead_h, s.season, count(e.site) AS n_rows, count(DISTINCT e.block_start::DATE) AS n_days, count(DISTINCT e.ym) AS n_months,
      round({R2.format(p='p0')}, 6) AS r2_base, round({R2.format(p='p1')}, 6) AS r2_added, round({R2.format(p='p1')} - {R2.format(p='p0')}, 6) AS delta_r2,
      round(avg(abs(exp(y) - exp(p0))), 6) AS mae_base, round(avg(abs(exp(y) - exp(p1))), 6) AS mae_added,
      round(avg(abs(exp(y) - exp(p0)) - abs(exp(y) - exp(p1))), 6) AS mae_gain, count(e.site) >= 100 AND count(DISTINCT e.block_start::DATE) >= 30 AS supported
      FROM (SELECT DISTINCT site, l_linenumber AS lead_h FROM ev) k CROSS JOIN (SELECT unnest(['DJF','MAM','JJA','SON']) AS season) s
      LEFT JOIN ev e ON e.site = k.site AND e.l_linenumber = k.lead_h AND e.season = s.season GROUP BY k.site, k.lead_h, s.season"""),
)
def strata(t: Tables):
    e = events(t).withColumn("lead_h", F.col("l_linenumber"))
    return rounded(M.seasonal_gain(e, ["site", "lead_h"], "block_start", "y", "p0", "p1"))


@query(
    "evl07_year_brier",
    sql("ev", """SELECT site, year(block_start)::INT AS stratum, count(*) AS n, sum(event)::BIGINT AS events, round(avg((prob0 - event) ** 2), 6) AS brier_base,
      round(avg((prob1 - event) ** 2), 6) AS brier_added, round(avg((prob0 - event) ** 2 - (prob1 - event) ** 2), 6) AS brier_gain FROM ev GROUP BY 1, 2"""),
)
def year_brier(t: Tables):
    return rounded(M.stratum_brier(events(t), ["site"], F.year("block_start"), "event", "prob0", "prob1"))


@query(
    "evl08_paired_gain",
    sql("rk", f"""SELECT g.site, n, events, round(brier_gain, 6) AS brier_gain, selected, hits_base, hits_added, hits_added - hits_base AS additional_hits,
      round((hits_added - hits_base) / selected, 6) AS precision_gain, round(ap_gain, 6) AS ap_gain, round(delta_r2, 6) AS delta_r2, round(mae_reduction, 6) AS mae_reduction FROM
      (SELECT site, count(*) AS n, sum(event)::BIGINT AS events, avg((prob0 - event) ** 2 - (prob1 - event) ** 2) AS brier_gain, count(*) FILTER (WHERE a) AS selected,
       sum(event) FILTER (WHERE a)::BIGINT AS hits_base, sum(event) FILTER (WHERE b)::BIGINT AS hits_added, {R2.format(p='p1')} - {R2.format(p='p0')} AS delta_r2,
       avg(abs(exp(y) - exp(p0)) - abs(exp(y) - exp(p1))) AS mae_reduction FROM f GROUP BY site) g
      JOIN (SELECT site, max(average_precision) FILTER (WHERE model = 'added') - max(average_precision) FILTER (WHERE model = 'base') AS ap_gain FROM
       ({AP.format(k='site, model', t=LONG.format(a='prob0', b='prob1', t='ev'))}) GROUP BY site) USING (site)""", f=FLAG_SQL),
)
def paired_gain(t: Tables):
    e = events(t)
    p = M.paired_probability_gain(e, ["site"], "event", "prob0", "prob1", TIES)
    r = M.paired_regression_gain(e, ["site"], "y", "p0", "p1").select("site", "delta_r2", "mae_reduction")
    return rounded(O.join_groups(p, r, ["site"]))


@query(
    "evl09_context_gain",
    sql("ev", """SELECT site, l_linenumber AS context, round(avg((prob0 - event) ** 2 - (prob1 - event) ** 2), 6) AS brier_gain,
      (sum(CASE WHEN r1 <= k THEN event ELSE 0 END) - sum(CASE WHEN r0 <= k THEN event ELSE 0 END))::BIGINT AS additional_hits FROM
      (SELECT *, ceil(0.1::DOUBLE * count(*) OVER (PARTITION BY site, l_linenumber)) AS k, row_number() OVER (PARTITION BY site, l_linenumber ORDER BY prob0 DESC, """ + TIE_SQL + """) AS r0,
       row_number() OVER (PARTITION BY site, l_linenumber ORDER BY prob1 DESC, """ + TIE_SQL + """) AS r1 FROM ev) GROUP BY site, l_linenumber"""),
)
def context_gain(t: Tables):
    e = events(t).withColumn("context", F.col("l_linenumber"))
    g = M.paired_probability_gain(e, ["site", "context"], "event", "prob0", "prob1", TIES)
    return rounded(g.select("site", "context", "brier_gain", "additional_hits"))


DRAWS = 1000


def draws_sql(src: str, keys: str, block: str, seed: int, draws: int = DRAWS) -> dict[str, str]:
    """SQL for the hashed block draws: (keys, draw, slot, block)."""
    return {
        "ix": f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {block}) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS nb FROM (SELECT DISTINCT {keys}, {block} FROM {src})",
        "dr": f"""SELECT d.{keys}, draw, slot, x.{block} FROM (SELECT {keys}, draw, slot, ('0x' || substr(md5(concat_ws('|', '{seed}', draw, slot)), 1, 8))::BIGINT % nb AS i FROM
          (SELECT {keys}, nb, draw, unnest(range(nb)) AS slot FROM (SELECT DISTINCT {keys}, nb, unnest(range({draws})) AS draw FROM ix))) d JOIN ix x ON x.{keys} = d.{keys} AND x.i = d.i""",
    }


GAIN_DRAWS = """SELECT site, draw, (sum(e0) - sum(e1)) / (sum(sy2) - sum(sy) ** 2 / sum(n)) AS g, sum(mg) / sum(n) AS m FROM dr JOIN
      (SELECT site, blk, count(*) AS n, sum(y) AS sy, sum(y * y) AS sy2, sum((y - p0) ** 2) AS e0, sum((y - p1) ** 2) AS e1, sum(abs(exp(y) - exp(p0)) - abs(exp(y) - exp(p1))) AS mg FROM src GROUP BY site, blk)
      USING (site, blk) GROUP BY site, draw"""
GAIN_OUT = """SELECT site, round(quantile_cont(g, 0.025), 6) AS delta_r2_lo95, round(quantile_cont(g, 0.975), 6) AS delta_r2_hi95, round(quantile_cont(m, 0.025), 6) AS mae_gain_lo95,
      round(quantile_cont(m, 0.975), 6) AS mae_gain_hi95, (SELECT max(nb) FROM ix WHERE ix.site = v.site) AS n_blocks FROM v GROUP BY site"""


@query("bst01_date_blocks", sql("ev", GAIN_OUT, src="SELECT *, day AS blk FROM ev", **draws_sql("src", "site", "blk", 260926), v=GAIN_DRAWS))
def date_blocks(t: Tables):
    e = events(t).withColumn("blk", B.date_block(F.col("block_start")))
    return rounded(B.r2_gain_interval(e, ["site"], "blk", "y", "p0", "p1", 260926, DRAWS))


@query(
    "bst02_anchored_blocks",
    sql("ev", GAIN_OUT, src="SELECT *, (day - min(day) OVER (PARTITION BY site)) // 3 AS blk FROM ev", **draws_sql("src", "site", "blk", 270927), v=GAIN_DRAWS),
)
def anchored_blocks(t: Tables):
    e = B.anchored_block(events(t), ["site"], "block_start", 3, "blk")
    return rounded(B.r2_gain_interval(e, ["site"], "blk", "y", "p0", "p1", 270927, DRAWS))


@query("bst03_epoch_weeks", sql("ev", GAIN_OUT, src="SELECT *, week AS blk FROM ev", **draws_sql("src", "site", "blk", 270928), v=GAIN_DRAWS))
def epoch_weeks(t: Tables):
    return rounded(B.r2_gain_interval(events(t), ["site"], "week", "y", "p0", "p1", 270928, DRAWS))


BRIER_V = """SELECT site, draw, sum(d) / sum(n) AS g FROM dr JOIN (SELECT site, week, count(*) AS n, sum((event - prob0) ** 2 - (event - prob1) ** 2) AS d FROM ev GROUP BY site, week)
      USING (site, week) GROUP BY site, draw"""


@query(
    "bst04_brier_interval",
    sql("ev", "SELECT site, round(quantile_cont(g, 0.025), 6) AS brier_gain_lo95, round(quantile_cont(g, 0.975), 6) AS brier_gain_hi95 FROM v GROUP BY site",
        **draws_sql("ev", "site", "week", 41, 2 * DRAWS), v=BRIER_V),
)
def brier_interval(t: Tables):
    return rounded(B.brier_gain_interval(events(t), ["site"], "week", "event", "prob0", "prob1", 41, 2 * DRAWS))


INST = f"""SELECT e.site, e.event, e.target, e.ym, d.draw, row_number() OVER (PARTITION BY e.site, d.draw ORDER BY prob0 DESC, slot, {TIE_SQL}) AS r0,
      row_number() OVER (PARTITION BY e.site, d.draw ORDER BY prob1 DESC, slot, {TIE_SQL}) AS r1, count(*) OVER (PARTITION BY e.site, d.draw) AS n FROM ev e JOIN dr d USING (site, week)"""


@query(
    "bst05_reranked_interval",
    sql("ev", """SELECT site, round(quantile_cont(g, 0.025), 6) AS brier_gain_lo95, round(quantile_cont(g, 0.975), 6) AS brier_gain_hi95, round(any_value(lo), 6) AS precision_gain_lo95,
      round(any_value(hi), 6) AS precision_gain_hi95, (SELECT max(nb) FROM ix WHERE ix.site = v.site) AS n_blocks FROM v JOIN w USING (site) GROUP BY site""",
        **draws_sql("ev", "site", "week", 51), v=BRIER_V, inst=INST,
        w="""SELECT site, quantile_cont(g, 0.025) AS lo, quantile_cont(g, 0.975) AS hi FROM (SELECT site, draw,
          (sum(event) FILTER (WHERE r1 <= ceil(0.1::DOUBLE * n)) - sum(event) FILTER (WHERE r0 <= ceil(0.1::DOUBLE * n))) / any_value(ceil(0.1::DOUBLE * n)) AS g FROM inst GROUP BY site, draw) GROUP BY site"""),
)
def reranked_interval(t: Tables):
    return rounded(B.selection_interval(events(t), ["site"], "week", "event", "prob0", "prob1", TIES, 51, DRAWS))


@query(
    "bst06_budget_interval",
    sql("ev", """SELECT site, f AS fraction, round(quantile_cont(pg, 0.025), 6) AS precision_gain_lo95, round(quantile_cont(pg, 0.975), 6) AS precision_gain_hi95,
      round(quantile_cont(mg, 0.025), 6) AS median_gain_lo95, round(quantile_cont(mg, 0.975), 6) AS median_gain_hi95 FROM
      (SELECT site, f, draw, avg(event) FILTER (WHERE r1 <= ceil(f * n)) - avg(event) FILTER (WHERE r0 <= ceil(f * n)) AS pg,
        median(target) FILTER (WHERE r1 <= ceil(f * n)) - median(target) FILTER (WHERE r0 <= ceil(f * n)) AS mg FROM
        (SELECT *, unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS f FROM inst) GROUP BY site, f, draw) GROUP BY site, f""",
        **draws_sql("ev", "site", "week", 61), inst=INST),
)
def budget_interval(t: Tables):
    return rounded(B.budget_interval(events(t), ["site"], "week", "event", "target", "prob0", "prob1", TIES, 61, DRAWS), "fraction")


@query(
    "bst07_median_difference",
    sql("ev", """SELECT site, round(quantile_cont(d, 0.025), 6) AS difference_lo95, round(quantile_cont(d, 0.975), 6) AS difference_hi95, count(d) AS difference_valid_draws FROM
      (SELECT site, draw, median(target) FILTER (WHERE prob0 >= 0.8) - median(target) FILTER (WHERE prob0 <= 0.2) AS d FROM ev JOIN dr USING (site, week) GROUP BY site, draw) GROUP BY site""",
        **draws_sql("ev", "site", "week", 71)),
)
def median_difference(t: Tables):
    e = events(t).withColumn("grp", F.when(F.col("prob0") >= 0.8, "high").when(F.col("prob0") <= 0.2, "low"))
    return rounded(B.median_difference_interval(e, ["site"], "week", "grp", "target", 71, DRAWS))


@query(
    "bst08_month_contrast_interval",
    sql("ev", f"""SELECT site, {', '.join(f"round(quantile_cont({c}, 0.025), 6) AS {c}_lo95, round(quantile_cont({c}, 0.975), 6) AS {c}_hi95, count({c}) AS {c}_valid_draws"
      for c in ('precision_gain', 'median_ratio_gain', 'exclusive_median_gain'))} FROM (SELECT site, draw, {CONTRAST} FROM
      (SELECT *, r0 <= ceil(0.1::DOUBLE * n) AS a, r1 <= ceil(0.1::DOUBLE * n) AS b FROM inst) GROUP BY site, draw) GROUP BY site""",
        **draws_sql("ev", "site", "week", 81),
        inst=INST.replace("PARTITION BY e.site, d.draw", "PARTITION BY e.site, d.draw, e.ym")),
)
def month_contrast_interval(t: Tables):
    return rounded(B.selection_contrast_interval(events(t), ["site"], "week", "event", "target", "prob0", "prob1", TIES, ["ym"], 81, DRAWS))

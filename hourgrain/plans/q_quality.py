"""Duplicate rules, gates, contracts and replay checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrain.functions import scalars as S, spectra as P
from hourgrain.operators import ordering as O, quality as Q
from hourgrain.plans.registry import query, sql
from hourgrain.sources.views import AXIS, GRID, Tables


@query(
    "dq01_keep_last_by_time",
    sql("raw", """SELECT site, hour, seq, ts, target FROM (SELECT *, row_number() OVER (PARTITION BY site, hour ORDER BY ts DESC, seq DESC) AS rn
    FROM raw) WHERE rn = 1"""),
)
def keep_last_by_time(t: Tables):
    r = t.target_raw().select("site", "hour", "seq", "ts", "target")
    return Q.keep_last(r, ["site", "hour"], ["ts", "seq"])


@query(
    "dq02_keep_last_by_ingest",
    sql("raw", "SELECT site, hour, max(seq) AS seq, arg_max(target, seq) AS target FROM raw GROUP BY site, hour"),
)
def keep_last_by_ingest(t: Tables):
    return Q.keep_last(t.target_raw().select("site", "hour", "seq", "target"), ["site", "hour"], ["seq"])


@query(
    "dq03_duplicate_conflicts",
    sql("raw", """SELECT site, hour, count(*) AS copies, max(target) - min(target) > 1e-8 OR
      coalesce(max(qc) - min(qc) > 1e-8, false) OR (count(qc) > 0 AND count(qc) < count(*)) AS conflict FROM raw GROUP BY site, hour"""),
)
def duplicate_conflicts(t: Tables):
    return Q.duplicate_conflicts(t.target_raw(), ["site", "hour"], ["target", "qc"])


@query(
    "dq04_series_checks",
    sql("raw", """SELECT a.site, n_rows, n_duplicate_rows, n_out_of_order, n_off_grid, n_uneven_steps FROM
      (SELECT site, sum(c)::BIGINT AS n_rows, sum(c - 1)::BIGINT AS n_duplicate_rows FROM
        (SELECT site, x, count(*) AS c FROM r GROUP BY site, x) GROUP BY site) a
      JOIN (SELECT site, count(*) FILTER (WHERE x < p) AS n_out_of_order,
          count(*) FILTER (WHERE epoch_us(x) % 3600000000 <> 0) AS n_off_grid
        FROM (SELECT site, x, lag(x) OVER (PARTITION BY site ORDER BY seq) AS p FROM r) GROUP BY site) b USING (site)
      JOIN (SELECT site, count(*) FILTER (WHERE x - p <> INTERVAL 1 HOUR) AS n_uneven_steps FROM
        (SELECT site, x, lag(x) OVER (PARTITION BY site ORDER BY x) AS p FROM (SELECT DISTINCT site, x FROM r)) GROUP BY site) c USING (site)""",
      r="SELECT site, seq, CASE WHEN seq % 500 = 0 THEN hour - INTERVAL 90 MINUTE ELSE hour END AS x FROM raw"),
)
def series_checks(t: Tables):
    late = F.when(F.col("seq") % 500 == 0, F.col("hour") - F.make_dt_interval(mins=F.lit(90))).otherwise(F.col("hour"))
    r = t.target_raw().select("site", "seq", late.alias("x"))
    return Q.series_checks(r, "site", "x", "seq", 3_600_000_000)


RATIO_SQL = """round({q05}, 6) AS q05, round({q50}, 6) AS median, round({q95}, 6) AS q95"""


@query(
    "dq05_ratio_gate",
    sql("pred", """SELECT *, abs(median - 1) <= 0.03 AND q05 >= 0.95 AND q95 <= 1.05 AS passed FROM
    (SELECT site, count(*) AS n, round(quantile_cont(p1 / p0, 0.05), 6) AS q05, round(quantile_cont(p1 / p0, 0.5), 6) AS median,
     round(quantile_cont(p1 / p0, 0.95), 6) AS q95 FROM pred GROUP BY site)"""),
)
def ratio_gate(t: Tables):
    p = t.predictions().select("site", (F.col("p1") / F.col("p0")).alias("r"))
    g = Q.ratio_gate(p, ["site"], F.col("r"), extra={"n": F.count("*")})
    return g.select("site", "n", "passed", *[F.round(c, 6).alias(c) for c in ("q05", "median", "q95")])


@query(
    "dq06_mapped_agreement",
    sql("mapped cells", """SELECT site, n, round(q05, 6) AS q05, round(median, 6) AS median, round(q95, 6) AS q95,
      q05 BETWEEN 0.95 AND 1.05 AND median BETWEEN 0.97 AND 1.03 AND q95 BETWEEN 0.95 AND 1.05 AS passed FROM
      (SELECT m.site, count(*) AS n, quantile_cont(mt / bt, 0.05) AS q05, quantile_cont(mt / bt, 0.5) AS median, quantile_cont(mt / bt, 0.95) AS q95
      FROM (SELECT vec_id, site, sum(b) AS mt FROM mapped GROUP BY vec_id, site HAVING count(b) = 24) m JOIN
      (SELECT vec_id, sum(coalesce(v, 0) * greatest(0, least(hi, log10(300::DOUBLE)) - greatest(lo, log10(15::DOUBLE)))) AS bt
       FROM cells GROUP BY vec_id) USING (vec_id) GROUP BY m.site)"""),
)
def mapped_agreement(t: Tables):
    d = F.col("density")
    m = t.spectra().select(
        "site", P.array_sum(P.regrid(d, AXIS, GRID)).alias("mapped"), P.band_value(d, AXIS, 15.0, 300.0).alias("native")
    ).where("mapped IS NOT NULL")
    g = Q.agreement_gate(m, ["site"], F.col("mapped") / F.col("native"), {"n": F.count("*")})
    return g.select("site", "n", "passed", *[F.round(c, 6).alias(c) for c in ("q05", "median", "q95")])


def flagged(t: Tables):
    """Hours with spectra, split at the 24th of the month; one site also leaks past the cut."""
    ts = F.col("timestamp")
    spec = t.hourly_spectra().where("total > 0").select("timestamp", "density", "total", "n82", "f82")
    o = t.good_hourly().join(spec, "timestamp")
    leak = (F.col("site") == "error") & (F.hour(ts) == 3)
    fit = (F.dayofmonth(ts) < 15) | leak
    test = F.dayofmonth(ts) >= 15
    return o.withColumn("fit", fit).withColumn("val", F.lit(False)).withColumn("test", test).withColumn("current", F.col("target"))


@query(
    "dq07_cohort_gate",
    sql("obs", """SELECT site, count(*) AS n_rows, count(*) FILTER (WHERE fit) AS n_fit, 0::BIGINT AS n_val, count(*) FILTER (WHERE test) AS n_test,
      count(*) FILTER (WHERE fit AND test) AS n_overlap, 0::BIGINT AS n_bad_bins, 0::BIGINT AS n_bad_labels, 0::BIGINT AS n_repeated_times,
      max(timestamp) FILTER (WHERE fit) AS last_fit, min(timestamp) FILTER (WHERE test) AS first_test,
      count(*) FILTER (WHERE fit AND test) = 0 AND coalesce(max(timestamp) FILTER (WHERE fit) < min(timestamp) FILTER (WHERE test), false) AS passed
      FROM (SELECT *, day(timestamp) < 15 OR (site = 'error' AND hour(timestamp) = 3) AS fit, day(timestamp) >= 15 AS test FROM obs) GROUP BY site"""),
)
def cohort_gate(t: Tables):
    return Q.cohort_checks(flagged(t), "site", P.bin_fractions(F.transform("density", lambda v: F.coalesce(v, F.lit(0.0)))))


@query(
    "dq08_closure",
    sql("spectra obs", """SELECT site, count(*) AS n_rows, round(max(abs(list_sum(list_transform(density, lambda x: coalesce(x, 0))) / (total * 24) - 1)), 6) AS max_total_error,
    0::BIGINT AS n_n82_errors, count(*) FILTER (WHERE hour(timestamp) = 0) AS n_leaking_origins
    FROM (SELECT o.*, s.density FROM obs o JOIN spectra s USING (timestamp)) GROUP BY site"""),
)
def closure(t: Tables):
    o = flagged(t).withColumn("scaled", F.col("total") * 24).withColumn("n82s", F.col("n82") * 24)
    start = F.when(F.hour("timestamp") == 0, F.col("timestamp")).otherwise(F.col("timestamp") + S.hours_interval(1))
    o = o.withColumn("block_start", start)
    c = Q.closure_checks(o, "site", F.col("density"), "scaled", "n82s", "f82", "timestamp", "block_start")
    return c.withColumn("max_total_error", F.round("max_total_error", 6))


@query(
    "dq09_replay",
    """SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS n_matched, count(*) FILTER (WHERE b.k IS NULL) AS n_only_new,
    count(*) FILTER (WHERE a.k IS NULL) AS n_only_old, round(max(abs(a.p - b.p)), 6) AS max_abs_p, false AS reproduced FROM
    (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey % 9 <> 0) a FULL OUTER JOIN
    (SELECT o_orderkey AS k, round(o_totalprice, 0) AS p FROM orders WHERE o_orderkey % 10 <> 0) b ON a.k = b.k""",
)
def replay(t: Tables):
    o = t.read("orders")
    new = o.where("o_orderkey % 9 <> 0").select("o_orderkey", F.col("o_totalprice").alias("p"))
    old = o.where("o_orderkey % 10 <> 0").select("o_orderkey", F.round("o_totalprice", 0).alias("p"))
    return Q.replay_check(new, old, ["o_orderkey"], ["p"], 1e-10).withColumn("max_abs_p", F.round("max_abs_p", 6))


@query(
    "dq10_channel_coverage",
    sql("cells", """SELECT site, j, round(any_value(d), 6) AS diameter_nm, count(v) AS n_finite, count(*) FILTER (WHERE v >= 0) AS n_nonnegative
    FROM cells GROUP BY site, j"""),
)
def channel_coverage(t: Tables):
    return Q.channel_coverage(t.spectra(), "site", "density", AXIS).withColumn("diameter_nm", F.round("diameter_nm", 6))


@query(
    "dq11_minute_qc_coverage",
    sql("minutes", """SELECT 'primary' AS policy, var, count(*) AS n_minutes, count(*) FILTER (WHERE (qc & ~8) = 0) AS n_valid FROM minutes GROUP BY var
    UNION ALL SELECT 'strict', var, count(*), count(*) FILTER (WHERE qc = 0) FROM minutes GROUP BY var"""),
)
def minute_qc_coverage(t: Tables):
    return Q.minute_qc_coverage(t.minutes(), "var", "value", "qc")


@query(
    "dq12_representation_contract",
    """WITH c AS (SELECT p_partkey AS dataset, (['bin_concentration','dndlog10dp','dndln_dp'])[p_partkey % 3 + 1] AS ds,
      CASE WHEN p_partkey % 10 = 0 THEN 'dndlog10dp' END AS es, CASE WHEN p_partkey % 7 <> 0 THEN 'cm-3' END AS unit,
      CASE WHEN p_partkey % 11 = 0 THEN 'edge_nm' ELSE 'midpoint_nm' END AS dd,
      CASE p_partkey % 5 WHEN 0 THEN 'guessed' WHEN 1 THEN NULL ELSE 'instrument_documented_bin_edges' END AS wm,
      p_size % 2 = 0 AS has_widths, p_size % 3 = 0 AS has_total FROM part)
    SELECT dataset, ds AS resolved_semantics, CASE WHEN es IS NOT NULL AND es <> ds THEN 'conflict'
      WHEN wm = 'guessed' THEN 'unsupported_width_method'
      WHEN unit IS NULL OR dd <> 'midpoint_nm' OR NOT has_total OR (ds = 'bin_concentration' AND NOT (has_widths AND wm IS NOT NULL)) THEN 'incomplete'
      ELSE 'passed' END AS status FROM c""",
)
def representation_contract(t: Tables):
    k = F.col("p_partkey")
    names = F.array(*[F.lit(s) for s in P.SEMANTICS])
    none = F.lit(None).cast("string")
    c = t.read("part").select(
        k.alias("dataset"),
        F.get(names, (k % 3).cast("int")).alias("declared_semantics"),
        F.when(k % 10 == 0, "dndlog10dp").alias("embedded_semantics"),
        F.when(k % 7 != 0, "cm-3").alias("declared_unit"), none.alias("embedded_unit"),
        F.when(k % 11 == 0, "edge_nm").otherwise("midpoint_nm").alias("declared_diameter_definition"),
        none.alias("embedded_diameter_definition"), none.alias("declared_width_method"),
        F.when(k % 5 == 0, "guessed").when(k % 5 == 1, None).otherwise("instrument_documented_bin_edges").alias("embedded_width_method"),
        F.lit("manual").alias("declared_width_evidence"), none.alias("embedded_width_evidence"),
        none.alias("semantics_evidence"), (F.col("p_size") % 2 == 0).alias("has_widths"), (F.col("p_size") % 3 == 0).alias("has_total"),
    )
    return Q.representation_contract(c).select("dataset", "resolved_semantics", "status")

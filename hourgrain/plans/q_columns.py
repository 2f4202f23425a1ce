"""Scalar projections, predicates and calendar keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrain.functions import scalars as S
from hourgrain.plans.registry import query, sql
from hourgrain.sources.views import Tables


@query(
    "col01_numeric",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL ELSE value END AS x
    FROM events""",
)
def numeric(t: Tables):
    e = F.col("event_id")
    text = (
        F.when(e % 11 == 0, "nan").when(e % 13 == 0, "bad").when(e % 17 == 0, "inf").otherwise(F.col("value").cast("string"))
    )
    return t.read("events").select("event_id", S.numeric(text).alias("x"))


@query(
    "col02_utc_floor",
    """SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS parsed,
    CASE WHEN event_id % 11 <> 0 THEN date_trunc('hour', ts) END AS hour,
    CASE WHEN event_id % 11 <> 0 THEN date_trunc('day', ts) + to_hours((hour(ts) // 6 * 6)::BIGINT) END AS six,
    CASE WHEN event_id % 11 <> 0 THEN date_trunc('day', ts)::TIMESTAMP END AS day FROM events""",
)
def utc_floor(t: Tables):
    text = F.when(F.col("event_id") % 11 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    p = t.read("events").select("event_id", S.utc_timestamp(text).alias("parsed"))
    return p.select(
        "*", S.floor_hour(F.col("parsed")).alias("hour"), S.floor_six_hours(F.col("parsed")).alias("six"),
        S.floor_day(F.col("parsed")).alias("day"),
    )


@query(
    "col03_quality_flag",
    sql("raw", "SELECT seq, qc IS NULL OR qc = 0 AS ok, coalesce(qc = 0, false) AS strict_ok FROM raw"),
)
def quality_flag(t: Tables):
    return t.target_raw().select("seq", S.qc_ok(F.col("qc")).alias("ok"), S.qc_strict(F.col("qc")).alias("strict_ok"))


@query(
    "col04_setpoint_tolerance",
    sql("raw", """SELECT site, count(*) FILTER (WHERE abs(s - 0.4::DOUBLE) <= 0.000005::DOUBLE) AS n_close, count(*) AS n
    FROM (SELECT site, ss + (seq % 5) * 0.000002::DOUBLE AS s FROM raw) GROUP BY site"""),
)
def setpoint(t: Tables):
    s = F.col("ss") + (F.col("seq") % 5) * F.lit(0.000002)
    return t.target_raw().groupBy("site").agg(F.count_if(S.close_to(s, 0.4)).alias("n_close"), F.count("*").alias("n"))


@query(
    "col05_calendar_angles",
    """SELECT event_id, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60) / 24), 6) AS sin_hour,
    round(cos(2 * pi() * (hour(ts) + minute(ts) / 60) / 24), 6) AS cos_hour,
    round(sin(2 * pi() * dayofyear(ts) / 365.25::DOUBLE), 6) AS sin_year,
    round(cos(2 * pi() * dayofyear(ts) / 365.25::DOUBLE), 6) AS cos_year FROM events""",
)
def calendar(t: Tables):
    a = S.calendar_angles(F.col("ts"))
    return t.read("events").select("event_id", *[F.round(c, 6).alias(n) for n, c in a.items()])


@query(
    "col06_season",
    """SELECT (['DJF','MAM','JJA','SON'])[month(o_orderdate) % 12 // 3 + 1] AS season, count(*) AS n,
    round(avg(o_totalprice), 6) AS mean_value FROM orders GROUP BY 1""",
)
def season(t: Tables):
    return t.read("orders").groupBy(S.season_of(F.month("o_orderdate")).alias("season")).agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_value")
    )


@query(
    "col07_log_features",
    """SELECT c_custkey, round(CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE ln(1 + greatest(c_acctbal, 0)) END, 6) AS n_balance,
    c_nationkey::DOUBLE AS key, round(exp(c_nationkey / 10) - 1, 6) AS back FROM customer""",
)
def log_features(t: Tables):
    c = t.read("customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("n_balance"),
        F.col("c_nationkey").cast("double").alias("key"),
    )
    z = c.select("c_custkey", *S.log_features(["n_balance", "key"]))
    return z.select(
        "c_custkey", F.round("n_balance", 6).alias("n_balance"), "key", F.round(F.expm1(F.col("key") / 10), 6).alias("back")
    )


@query(
    "col08_calendar_keys",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month,
    date_diff('day', DATE '1970-01-01', o_orderdate::DATE) // 7 AS week, count(*) AS n FROM orders GROUP BY 1, 2, 3""",
)
def calendar_keys(t: Tables):
    ts = F.col("o_orderdate")
    return t.read("orders").groupBy(
        S.date_key(ts).alias("day"), S.month_key(ts).alias("month"), S.epoch_week(ts).alias("week")
    ).agg(F.count("*").alias("n"))


@query(
    "col09_wind_components",
    """SELECT event_id, round(-value * sin(radians(user_id % 360)), 6) AS u, round(-value * cos(radians(user_id % 360)), 6) AS v
    FROM events""",
)
def wind(t: Tables):
    deg = (F.col("user_id") % 360).cast("double")
    return t.read("events").select(
        "event_id", F.round(S.wind_u(F.col("value"), deg), 6).alias("u"), F.round(S.wind_v(F.col("value"), deg), 6).alias("v")
    )


@query(
    "col10_qc_bits",
    """SELECT coalesce(q, -1) AS q, q IS NOT NULL AND q >= 0 AND (q & ~8) = 0 AS primary_ok, q IS NOT NULL AND q = 0 AS strict_ok, count(*) AS n
    FROM (SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id & 15 END AS q FROM events) GROUP BY 1, 2, 3""",
)
def qc_bits(t: Tables):
    q = F.when(F.col("user_id") % 5 != 0, F.col("user_id").bitwiseAND(F.lit(15).cast("bigint")))
    return t.read("events").select(q.alias("q")).groupBy(
        F.coalesce(F.col("q"), F.lit(-1).cast("bigint")).alias("q"), S.qc_bits_ok(F.col("q")).alias("primary_ok"), S.qc_bits_ok(F.col("q"), True).alias("strict_ok")
    ).agg(F.count("*").alias("n"))


@query(
    "col11_valid_range",
    sql("minutes", """SELECT var, count(*) AS n, count(CASE WHEN value BETWEEN 1 AND 100 THEN 1 END) AS n_in_range,
    round(sum(CASE WHEN value BETWEEN 1 AND 100 THEN value END), 4) AS sum_in_range,
    count(*) FILTER (WHERE (qc & 8) <> 0) AS n_retired FROM minutes GROUP BY var"""),
)
def valid_range(t: Tables):
    x = S.in_valid_range(F.col("value"), F.lit(1.0), F.lit(100.0))
    return t.minutes().groupBy("var").agg(
        F.count("*").alias("n"), F.count(x).alias("n_in_range"), F.round(F.sum(x), 4).alias("sum_in_range"),
        F.count_if(S.retire_bit4(F.col("qc")) == -1).alias("n_retired"),
    )

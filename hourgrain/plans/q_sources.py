"""Scans, coercion at landing, coverage, inventories and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrain.functions import scalars as S, spectra as P
from hourgrain.plans.registry import query, sql
from hourgrain.session import scratch_path
from hourgrain.sources import archive, files, predictions, weather
from hourgrain.sources.views import AXIS, Tables


def wide_spectra(t: Tables):
    """The stand-in spectra as a wide text table with one ``D_*`` column per channel."""
    names = [f"D_{d:.3f}".replace(".", "_") for d in AXIS]
    cols = [F.get("density", F.lit(j)).cast("string").alias(n) for j, n in enumerate(names)]
    s = t.spectra()
    return s.select(
        "vec_id", "site",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Start_date"),
        F.when(F.col("vec_id") % 7 == 0, "1").when(F.col("vec_id") % 7 == 1, None).otherwise("0").alias("Qc_CPC_SMPS"),
        P.array_sum(F.col("density")).cast("string").alias("N_CN_SMPS_STP"),
        *cols,
    )


@query(
    "src01_spectrum_csv_scan",
    sql("cells", """SELECT site, count(DISTINCT vec_id) AS n_rows, count(DISTINCT j)::INT AS n_channels, count(DISTINCT vec_id) FILTER (WHERE vec_id % 7 != 0) AS n_ok,
      round(sum(v), 3) AS sum_density FROM (SELECT vec_id, j, v, CASE WHEN vec_id % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS site FROM cells
        WHERE vec_id % 2 = 0 OR left(printf('%.3f', d), 1) != '4') GROUP BY site"""),
)
def spectrum_csv_scan(t: Tables):
    """Two channel layouts written as CSV, scanned back and united; one row per site."""
    root = scratch_path(t.spark, "landing")
    w = wide_spectra(t)
    full = [c for c in w.columns if c not in ("vec_id", "site")]
    short = [c for c in full if not c.startswith("D_4")]
    paths = []
    for name, part, cols in (
        ("even_smps_hour_2024", F.col("vec_id") % 2 == 0, full), ("odd_smps_hour_2024", F.col("vec_id") % 2 == 1, short),
    ):
        paths.append(files.write_table(w.where(part).select(*cols), f"{root}/{name}.csv", "csv"))
    got = archive.load_spectra(t.spark, paths)
    return got.groupBy("site").agg(
        F.count("*").alias("n_rows"), F.max(F.size("axis")).alias("n_channels"),
        F.count_if("spectrum_ok").alias("n_ok"), F.round(F.sum(P.array_sum(F.col("density"))), 3).alias("sum_density"),
    )


@query(
    "src02_site_glob",
    "SELECT site, count(*) AS n_rows FROM (SELECT 'SBS_CP' AS site FROM embeddings UNION ALL SELECT 'SBS_SPL' FROM embeddings WHERE vec_id % 7 = 0) GROUP BY site",
)
def site_glob(t: Tables):
    root = scratch_path(t.spark, "landing")
    w = wide_spectra(t).drop("vec_id", "site")
    files.write_table(w, f"{root}/SBS_cp_smps_hour_2024.csv", "csv")
    files.write_table(w.where("Qc_CPC_SMPS = '1'"), f"{root}/SBS_spl_smps_hour_2024.csv", "csv")
    parts = [
        t.spark.read.option("header", True).csv(archive.site_glob(root, s)).select(F.lit(s).alias("site"), "Start_date")
        for s in ("SBS_CP", "SBS_SPL")
    ]
    return parts[0].unionByName(parts[1]).groupBy("site").agg(F.count("Start_date").alias("n_rows"))


def text_target(t: Tables):
    """Raw target rows as the text columns of a target file."""
    r = t.target_raw()
    as_text = lambda c: F.col(c).cast("string")
    return r.select(
        "site", "seq", "hour", as_text("ts").alias("ts_text"), as_text("hour").alias("hour_text"),
        as_text("ss").alias("ss_text"), as_text("target").alias("target_text"), as_text("qc").alias("qc_text"),
        F.when(F.col("seq") % 4 == 0, "1").otherwise("0").alias("closure_text"),
    )


def column_b(rows):
    return rows.select(
        "site", "seq", F.col("hour_text").alias("Start_date"), F.col("ss_text").alias("SS_setpoint_B"),
        F.col("target_text").alias("N_CCN_mean_STP_B"), F.col("qc_text").alias("Qc_CPC_SMPS"),
        F.col("closure_text").alias("Qc_CCN04_N80_B"),
    )


def column_a(rows):
    return rows.select(
        "site", F.col("ts_text").alias("Start_date"), F.col("ss_text").alias("SS_harmonized_A"),
        F.col("target_text").alias("N_CCN_mean_STP_A"), F.col("closure_text").alias("Qc_CCN04_N80_A"),
    )


@query(
    "src03_target_hourly_file",
    sql("raw", """SELECT site, seq, hour AS timestamp, target, qc IS NULL OR qc = 0 AS instrument_ok, seq % 4 <> 0 AS closure_ok
    FROM raw WHERE abs(ss - 0.4::DOUBLE) <= 0.000005::DOUBLE"""),
)
def target_hourly_file(t: Tables):
    return archive.target_column_b(column_b(text_target(t)))


@query(
    "src04_target_two_layouts",
    sql("raw", """SELECT site, hour AS timestamp, round(arg_max(target, seq), 6) AS target, arg_max(qc IS NULL OR qc = 0, seq) AS instrument_ok,
      arg_max(seq % 4 <> 0, seq) AS closure_ok FROM raw
      WHERE abs(ss - 0.4::DOUBLE) <= 0.000005::DOUBLE AND site IN ('click', 'view') GROUP BY site, hour
    UNION ALL SELECT site, hour, round(avg(target), 6), true, bool_and(seq % 4 <> 0) FROM raw
      WHERE abs(ss - 0.4::DOUBLE) <= 0.000005::DOUBLE AND site NOT IN ('click', 'view') GROUP BY site, hour"""),
)
def target_two_layouts(t: Tables):
    rows = text_target(t)
    b = column_b(rows.where(F.col("site").isin("click", "view")))
    return archive.load_target(b, column_a(rows)).withColumn("target", F.round("target", 6))


@query(
    "src05_site_exclusion",
    sql("raw", "SELECT site, count(*) AS n FROM raw WHERE upper(site) NOT IN ('CLICK', 'ERROR') GROUP BY site"),
)
def site_exclusion(t: Tables):
    return archive.exclude_sites(t.target_raw(), " click, ,Error ").groupBy("site").agg(F.count("*").alias("n"))


def limits(t: Tables):
    """Per-variable limits taken from the data: the wrong unit for one variable, an old schema for another."""
    return t.minutes().groupBy("var").agg(
        F.lit(1.0).alias("valid_min"), F.lit(100.0).alias("valid_max")
    ).select(
        "var", F.when(F.col("var") == "view", "K").otherwise("degC").alias("unit"), "valid_min", "valid_max",
        (F.col("var") == "click").alias("old_schema"),
    )


@query(
    "src06_weather_minutes",
    sql("minutes", """SELECT var, count(*) AS n_minutes, CASE WHEN var = 'view' THEN count(*) ELSE 0 END AS n_wrong_unit,
    count(x) AS n_valid, min(x) AS min_value, max(x) AS max_value FROM
    (SELECT var, CASE WHEN value BETWEEN 1 AND 100 THEN value END AS x FROM minutes) GROUP BY var"""),
)
def weather_minutes(t: Tables):
    clean = weather.clean_minutes(t.minutes(), limits(t))
    return weather.unit_report(clean, {v: "degC" for v in ("click", "view", "error", "signup", "purchase")})


@query(
    "src07_expected_days",
    """SELECT event_type AS site, strftime(d, '%Y-%m-%d') AS day FROM (SELECT DISTINCT event_type FROM events),
      (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-03', INTERVAL 1 DAY)) AS d)
    WHERE (event_type, d::DATE) NOT IN (SELECT (event_type, ts::DATE) FROM events)""",
)
def expected_days(t: Tables):
    e = t.read("events").select(F.col("event_type").alias("site"), "ts")
    return weather.missing_days(e, "site", "ts", "2023-12-30", "2024-02-03").withColumn("day", F.col("day").cast("string"))


@query(
    "src09_sinks",
    sql("daily", """SELECT site, count(*) AS n, round(sum(value), 2) AS total FROM daily GROUP BY site"""),
)
def sinks(t: Tables):
    """Written partitioned by site, read back, then once more through gzip CSV."""
    first = files.write_table(t.daily(), scratch_path(t.spark, "daily"), partition_by=["site"])
    back = t.spark.read.parquet(first).select("site", "timestamp", "value")
    second = files.write_table(back, scratch_path(t.spark, "daily-csv"), "csv", gzip=True)
    text = t.spark.read.option("header", True).csv(second)
    return text.groupBy("site").agg(F.count("*").alias("n"), F.round(F.sum(S.numeric(F.col("value"))), 2).alias("total"))


@query(
    "src10_channel_axis",
    """SELECT vec_id, 64::BIGINT AS n_channels, 10::DOUBLE AS first_nm, 500::DOUBLE AS last_nm,
    round(list_sum(list_transform(embedding, lambda x: CASE WHEN x < -0.3 THEN NULL ELSE abs(x::DOUBLE) * 1000 END)), 4) AS total,
    round(CASE WHEN embedding[1] < -0.3 THEN NULL ELSE abs(embedding[1]::DOUBLE) * 1000 END, 4) AS first_channel FROM embeddings""",
)
def channel_axis(t: Tables):
    w = wide_spectra(t)
    shuffled = w.select("vec_id", *sorted(c for c in w.columns if c.startswith("D_")))
    packed, axis = archive.pack_channels(shuffled)
    return packed.select(
        "vec_id", F.size("density").cast("bigint").alias("n_channels"),
        F.round(F.lit(axis[0]), 3).alias("first_nm"), F.round(F.lit(axis[-1]), 3).alias("last_nm"),
        F.round(P.array_sum(F.col("density")), 4).alias("total"), F.round(F.get("density", F.lit(0)), 4).alias("first_channel"),
    )


@query(
    "src11_prediction_union",
    """WITH want AS (SELECT o_orderkey AS k, (o_totalprice > 100000)::INT AS e FROM orders),
    p AS (SELECT 'a' AS model, o_orderkey AS k, (o_totalprice > 100000)::INT AS e, (o_custkey % 100) / 100.0 AS p FROM orders
      UNION ALL SELECT 'b', o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE (o_totalprice > 100000)::INT END, (o_custkey % 120) / 100.0
        FROM orders WHERE o_orderkey % 4 <> 0
      UNION ALL SELECT 'b', o_orderkey, (o_totalprice > 100000)::INT, 0.5 FROM orders WHERE o_orderkey % 4 = 1)
    , r AS (SELECT model, k, count(*) AS c, max(e) AS e, max(p) AS hi, min(p) AS lo FROM p GROUP BY model, k)
    SELECT model, sum(c)::BIGINT AS n_rows, sum(c - 1)::BIGINT AS n_duplicates, 0::BIGINT AS n_foreign,
      count(*) FILTER (WHERE r.e <> w.e) AS n_changed_labels, count(*) FILTER (WHERE lo < 0 OR hi > 1) AS n_bad_probability,
      (SELECT count(*) FROM want) - count(*) AS n_missing
    FROM r JOIN want w USING (k) GROUP BY model""",
)
def prediction_union(t: Tables):
    event = (F.col("o_totalprice") > 100000).cast("int")
    o = t.read("orders").select(
        F.col("o_orderkey").alias("k"), event.alias("e"), "o_custkey",
    )
    a = o.select(F.lit("a").alias("model"), "k", "e", ((F.col("o_custkey") % 100) / 100.0).alias("p"))
    b = o.where("k % 4 <> 0").select(
        F.lit("b").alias("model"), "k", F.when(F.col("k") % 10 == 0, 1).otherwise(F.col("e")).alias("e"),
        ((F.col("o_custkey") % 120) / 100.0).alias("p"),
    )
    c = o.where("k % 4 = 1").select(F.lit("b").alias("model"), "k", "e", F.lit(0.5).alias("p"))
    united = predictions.union_families([a, b, c])
    return predictions.prediction_checks(united, o, ["model"], ["k"], "p", "e")

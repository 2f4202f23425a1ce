"""Small hand-made inputs with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from hourgrain.functions import scalars as S, spectra as P
from hourgrain.operators import align as A, cohort as C, preparation as Z, ranking as K, resampling as B, rollup as R, spectrum as X
from hourgrain.sources import archive, files

GRID = P.geometric_grid(15.0, 300.0, 24)


def spectra_df(spark, rows):
    return spark.createDataFrame([(i, [float(v) if v is not None else None for v in r]) for i, r in enumerate(rows)], "i int, x array<double>")


def test_cutoff_overlap(spark):
    df = spectra_df(spark, [P.log10_widths(GRID)] * 3)
    r = df.select(P.count_above(F.col("x"), GRID, 82.0).alias("n"), P.fraction_above(F.col("x"), GRID, 82.0).alias("f")).collect()
    for row in r:
        assert row.n == pytest.approx(math.log10(300 / 82), rel=1e-12)
        assert row.f == pytest.approx(math.log10(300 / 82) / math.log10(20), rel=1e-12)


def test_mapped_result_does_not_depend_on_channel_count(spark):
    target = [20.0 * 2.5 ** (k / 6) for k in range(7)]
    got = []
    for n in (9, 33):
        d = [10.0 * 10.0 ** (j / (n - 1)) for j in range(n)]
        w = P.log10_widths(d)
        df = spectra_df(spark, [[1000.0 * v for v in w]])
        got.append(df.select(P.regrid(F.col("x"), d, target, "bin_concentration", w).alias("b")).first().b)
    assert got[0] == pytest.approx(got[1], rel=1e-10)


def test_density_conversions(spark):
    df = spectra_df(spark, [[100.0 / math.log(10)] * 24])
    assert df.select(P.density_log10(F.col("x"), "dndln_dp").alias("d")).first().d == pytest.approx([100.0] * 24)
    with pytest.raises(ValueError):
        P.density_log10(F.col("x"), "bin_concentration")
    with pytest.raises(ValueError):
        P.density_log10(F.col("x"), "mass")


def test_bad_axes_are_rejected():
    for axis in ([15.0, 30.0, 30.0, 100.0], [15.0], [-1.0, 2.0], [1.0, float("nan")]):
        with pytest.raises(ValueError):
            P.log10_edges(axis)


def test_uniform_density_passes_the_audit(spark):
    df = spectra_df(spark, [[100.0] * 24] * 3).withColumn("site", F.lit("a"))
    total = 100.0 * math.log10(20)
    a = X.audit(df, ["site"], "x", F.lit(True), GRID, GRID, supplied=F.lit(total)).first()
    assert a.passed and a.n_mapped_valid == 3
    assert a.conservation_median == pytest.approx(1.0) and a.total_median == pytest.approx(1.0)
    nested = X.audit_struct(X.audit(df, ["site"], "x", F.lit(True), GRID, GRID), ["site"]).first()
    assert nested.conservation.median == pytest.approx(1.0) and nested.total.median is None


def test_regrid_needs_support_at_both_ends_and_skips_bad_channels(spark):
    d = [10.0, 20.0, 40.0, 80.0]
    rows = [[1.0, 2.0, 3.0, 4.0], [None, 2.0, 3.0, 4.0], [1.0, None, 3.0, 4.0], [1.0, -5.0, 3.0, 4.0], [1.0, 2.0, 3.0, None]]
    got = [r.b for r in spectra_df(spark, rows).select("i", P.regrid(F.col("x"), d, [20.0, 40.0], scale=False).alias("b")).orderBy("i").collect()]
    assert got[0] == pytest.approx([2.0, 3.0])
    assert got[1] == pytest.approx([2.0, 3.0])
    assert got[2] == pytest.approx([2.0, 3.0]) and got[3] == pytest.approx([2.0, 3.0])
    assert got[4] == pytest.approx([2.0, 3.0])
    assert spectra_df(spark, [[1.0, None, None, None], [None, None, 3.0, 4.0]]).where(P.regrid(F.col("x"), d, [20.0, 40.0]).isNotNull()).count() == 0


def test_feature_widths(spark):
    df = spark.range(10).select(
        F.array(*[F.lit(0.0)] * 4).alias("cal"), F.array(*[F.lit(1.0)] * 6).alias("n"), F.array(*[F.lit(0.5)] * 6).alias("f"),
        F.array(*[F.array(*[F.lit(1 / 24)] * 24)] * 6).alias("fr"),
    )
    sizes = df.select(*[
        F.size(Z.history_features(r, c, F.col("cal"), F.col("n"), F.col("n"), F.col("f"), F.col("fr"))).alias(f"{r}_{c}")
        for r, c in (("N_plus_f82", "current"), ("N_plus_f82", "history6"), ("full24", "current"), ("full24", "history6"))
    ]).first()
    assert tuple(sizes) == (6, 16, 29, 154)


def test_within_month_selection_and_stable_top(spark):
    df = spark.createDataFrame([("s", i, 1.0, "2020-01" if i < 10 else "2020-02") for i in range(20)], "site string, i int, p double, ym string")
    got = K.select_top(df, ["site", "ym"], "p", ["i"]).select("i").collect()
    assert sorted(r.i for r in got) == [0, 10]
    flat = spark.createDataFrame([("s", i, 1.0) for i in range(23)], "site string, i int, p double")
    assert sorted(r.i for r in K.select_top(flat, ["site"], "p", ["i"]).collect()) == [0, 1, 2]


def test_file_inventory(spark, tmp_path):
    (tmp_path / "input.txt").write_text("")
    (tmp_path / "more.txt").write_text("abc")
    now = files.inventory(spark, f"{tmp_path}/*")
    assert {(r.name, r.size_bytes) for r in now.collect()} == {("input.txt", 0), ("more.txt", 3)}
    old = spark.createDataFrame([("input.txt", 0), ("more.txt", 4), ("gone.txt", 1)], "name string, size_bytes bigint")
    assert {r.name: r.state for r in files.inventory_changes(now, old).collect()} == {"input.txt": "same", "more.txt": "resized", "gone.txt": "removed"}


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    p = files.write_table(spark.range(3), str(tmp_path / "t"))
    with pytest.raises(Exception):
        files.write_table(spark.range(3), p)


def test_label_end_purge(spark):
    start = dt.datetime(2020, 1, 1)
    cut = start + dt.timedelta(hours=70)
    df = spark.createDataFrame([(start + dt.timedelta(hours=i),) for i in range(100)], "ts timestamp_ntz").withColumn("cut", F.lit(cut).cast("timestamp_ntz"))
    fit, test = C.hourly_split(F.col("ts"), F.lit(6), F.lit(True), F.col("cut"))
    rows = df.select("ts", fit.alias("fit"), test.alias("test")).collect()
    assert all(r.ts + dt.timedelta(hours=6) < cut for r in rows if r.fit)
    assert all(r.ts >= cut for r in rows if r.test)
    assert sum(r.fit for r in rows) == 64 and sum(r.test for r in rows) == 30 and not any(r.fit and r.test for r in rows)


def test_identical_predictions_have_zero_gain(spark):
    df = spark.createDataFrame([("s", i // 10, i / 100.0) for i in range(200)], "site string, day int, y double").withColumn("p", F.col("y") + 0.1)
    g = B.r2_gain_interval(df, ["site"], "day", "y", "p", "p", 42, 100).first()
    assert g.delta_r2_lo95 == 0 and g.delta_r2_hi95 == 0 and g.n_blocks == 20


def test_gap_gives_no_lead_value(spark):
    t0 = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([("s", t0 + dt.timedelta(hours=h), float(h)) for h in (0, 1, 3, 4)], "site string, timestamp timestamp_ntz, target double")
    got = {r.timestamp.hour: r.f for r in A.exact_lead(df, df, "site", [1], {"target": "f"}).collect()}
    assert got == {0: 1.0, 1: None, 3: 4.0, 4: None}


def test_one_to_one_rejects_repeats(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, a double")
    b = spark.createDataFrame([(1, 5.0)], "k int, b double")
    with pytest.raises(Exception, match="repeated key"):
        A.one_to_one(a, b, ["k"]).collect()
    assert A.one_to_one(b, b.withColumnRenamed("b", "c"), ["k"]).collect()[0].c == 5.0


def test_right_closed_hour_and_missing_values(spark):
    df = spark.createDataFrame([("2020-01-01 01:00:00", "1"), ("2020-01-01 01:00:01", "nan"), ("2020-01-01 02:00:00", "x")], "t string, v string")
    df = df.select(S.utc_timestamp(F.col("t")).alias("ts"), S.numeric(F.col("v")).alias("v"))
    hours = [r[0].hour for r in df.select(R.right_closed_hour(F.col("ts"))).collect()]
    assert hours == [1, 2, 2] and [r.v for r in df.collect()] == [1.0, None, None]
    assert df.select(S.log1p_clipped(F.lit(None).cast("double")).alias("a"), S.log1p_clipped(F.lit(-3.0)).alias("b")).first()[:] == (None, 0.0)


def test_spectrum_files_of_two_layouts(spark, tmp_path):
    (tmp_path / "ab_smps_hour_2020.csv").write_text(
        "Start_date,D_12_5,D_20,Qc_CPC_SMPS,P_SMPS\n2020-01-01 00:00:00,1,2,0,9\n2020-01-01 00:00:00,3,4,,8\n2020-01-01 01:00:00,bad,6,1,7\n"
    )
    (tmp_path / "Cd_smps_hour_2021.csv").write_text("Start_date,D_30,D_10,D_20\nnot a time,1,2,3\n2021-01-01 00:00:00,3,1,2\n")
    paths = [str(p) for p in sorted(tmp_path.glob("*.csv"))]
    rows = {(r.site, r.timestamp): r for r in archive.load_spectra(spark, paths).collect()}
    t = dt.datetime(2020, 1, 1)
    assert rows["AB", t].density == [3.0, 4.0] and rows["AB", t].spectrum_ok and not rows["AB", t].spectrum_strict_ok
    assert rows["AB", t + dt.timedelta(hours=1)].density == [None, 6.0] and not rows["AB", t + dt.timedelta(hours=1)].spectrum_ok
    assert rows["CD", dt.datetime(2021, 1, 1)].density == [1.0, 2.0, 3.0] and rows["CD", dt.datetime(2021, 1, 1)].axis == [10.0, 20.0, 30.0]
    assert ("CD", None) in rows
    assert {s for s, _ in {(r.site, 1) for r in archive.load_spectra(spark, paths, " ab ,").collect()}} == {"CD"}
    assert archive.site_glob("/x", "SBS_CP") == "/x/SBS_cp_smps_hour*"


def test_partition_rules_leave_straddling_blocks_out(spark):
    t = dt.datetime(2020, 1, 1)
    h = lambda k: t + dt.timedelta(hours=k)
    rows = [(h(6 * i), h(6 * i + 6), h(6 * i - 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "s timestamp_ntz, e timestamp_ntz, o timestamp_ntz").withColumn("cut", F.lit(h(21)).cast("timestamp_ntz")).withColumn("outer", F.lit(h(42)).cast("timestamp_ntz"))
    got = [r.p for r in df.select("s", C.block_partition(*[F.col(c) for c in ("s", "e", "o", "cut", "outer")], F.lit(True)).alias("p")).orderBy("s").collect()]
    assert got == ["fit"] * 3 + [None] + ["calibration"] * 3 + [None] + ["test"] * 2


def test_date_fraction_uses_double_arithmetic(spark):
    days = [(("s"), dt.datetime(2020, 1, 1) + dt.timedelta(days=i)) for i in range(90)]
    r = C.date_fraction_cut(spark.createDataFrame(days, "site string, ts timestamp_ntz"), "site", "ts", 0.7).first()
    assert r.cut == dt.datetime(2020, 1, 1) + dt.timedelta(days=int(0.7 * 90)) and int(0.7 * 90) == 62

"""Studies whose cohort or training part is empty, as good hours become rare in long series."""

import pytest
from pyspark.sql import functions as F

from hourgrain.operators import logistic as G, trees as T
from hourgrain.plans import studies as ST

ROWS = "site string, block_start timestamp_ntz, partition string, event int, features array<double>"


def some(spark, parts, event=None):
    rows = spark.range(40).withColumn("partition", F.element_at(F.array(*map(F.lit, parts)), (F.col("id") % len(parts) + 1).cast("int")))
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id * 6 AS INT))")
    event = F.lit(event) if event is not None else (F.xxhash64("id") % 2 == 0).cast("int")
    return rows.select(F.lit("a").alias("site"), start.alias("block_start"), "partition", event.cast("int").alias("event"), F.array(F.sin("id"), F.cos("id")).alias("features"))


def test_wide_logistic_without_training_rows_predicts_nothing(spark):
    train, score = spark.createDataFrame([], ROWS), some(spark, ["test"])
    p = T.wide_logistic(ST.scaled(train, train), ST.scaled(score, train), "features", "event")
    assert [r.p for r in p.collect()] == [None] * 40


@pytest.mark.parametrize("event", [0, 1])
def test_wide_logistic_with_one_class_predicts_it(spark, event):
    train, score = some(spark, ["train"], event), some(spark, ["test"])
    p = T.wide_logistic(ST.scaled(train, train), ST.scaled(score, train), "features", "event")
    assert {r.p for r in p.collect()} == {float(event)}


def test_calibration_leaves_rows_without_probability_out(spark):
    rows = some(spark, ["cal", "test"]).withColumn("is_cal", F.col("partition") == "cal").withColumn("model", F.explode(F.array(F.lit("none"), F.lit("some"))))
    rows = rows.withColumn("p", F.when((F.col("model") == "some") & (F.hour("block_start") > 0), 0.5 + 0.4 * F.sin(F.unix_micros(F.col("block_start").cast("timestamp")) / 1e9)))
    out = G.calibrate(rows, ["model"], "p", "event", "is_cal").collect()
    assert {r.model for r in out} == {"some"} and len(out) == 40
    assert all(r.p_calibrated is None if r.p is None else 0 < r.p_calibrated < 1 for r in out) and any(r.p is None for r in out)


@pytest.mark.parametrize("parts", [[], ["test", "calibration"]])
def test_studies_of_wide_models_without_training_rows(spark, parts):
    rows = some(spark, parts) if parts else spark.createDataFrame([], ROWS)
    rows = rows.withColumn("calendar", F.col("features"))
    feats = {(r, c): F.col("features") for r in ("N", "N82") for c in ("current", "history6")}
    tables = ST.model_benchmark(rows, "calendar", feats, families=("logistic",), draws=5)
    assert [tables[n].count() for n in ("scores", "gains", "history", "strata")] == [0, 0, 0, 0]
    assert tables["predictions"].count() == len(feats) * rows.count() + rows.count()
    assert ST.logistic_parameterisation(rows, feats).count() == 0

"""Plans of block intervals: no group's rows meet in one task, and no row meets the draws."""

import pytest
from pyspark.sql import functions as F

from hourgrain.operators import resampling as B


def rows(spark):
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(id % 90 AS INT))")
    df = spark.range(900).select("id", F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("site"), start.alias("ts"), (F.col("id") % 90 / 7).cast("int").alias("week"))
    p = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    return df.withColumns({"p": p, "q": p, "event": (F.xxhash64("id", F.lit(1)) % 3 == 0).cast("int"), "value": p * 10, "ym": F.date_format("ts", "yyyy-MM")})


def test_anchored_blocks_do_not_shuffle_rows_by_group(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = B.anchored_block(rows(spark), ["site"], "ts", 3, "blk")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert out.agg(F.max("blk")).first()[0] == 29
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("within", [None, [], ["ym"]])
def test_selected_rows_are_not_copied_per_draw(spark, monkeypatch, within):
    def fail(*_):
        raise AssertionError("rows are joined to draws")

    monkeypatch.setattr(B, "sampled_rows", fail)
    if within is None:
        got = B.budget_interval(rows(spark), ["site"], "week", "event", "value", "p", "q", ["id"], 5, 20, (0.1, 0.3)).collect()
        assert len(got) == 4 and all(r[c] == 0 for r in got for c in ("precision_gain_lo95", "precision_gain_hi95", "median_gain_lo95", "median_gain_hi95"))
    else:
        got = B.selection_contrast_interval(rows(spark), ["site"], "week", "event", "value", "p", "q", ["id"], within, 5, 20).collect()
        assert len(got) == 2 and all(r["precision_gain_lo95"] == r["median_ratio_gain_hi95"] == 0 and r["exclusive_median_gain_valid_draws"] == 0 for r in got)

"""Decoded minute weather: unit contract, valid ranges, expected days."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hourgrain.functions import scalars as S

# Variables, units.
VARIABLES = {
    "temp_mean": "degC",
    "rh_mean": "%",
    "atmos_pressure": "kPa",
    "wspd_arith_mean": "m/s",
    "wspd_vec_mean": "m/s",
    "wdir_vec_mean": "degree",
    "tbrg_precip_total": "mm",
}


def clean_minutes(minutes: DataFrame, limits: DataFrame) -> DataFrame:
    """Mask values outside each variable's limits and retire bit 4 where the file schema is old.

    ``limits(var, unit, valid_min, valid_max, old_schema)`` has one row per variable and is joined
    without a hint: its measured size decides.
    """
    j = minutes.join(limits, "var")
    return j.select(
        *[c for c in minutes.columns if c not in ("value", "qc")],
        "unit",
        S.in_valid_range(F.col("value"), F.col("valid_min"), F.col("valid_max")).alias("value"),
        F.when(F.col("old_schema"), S.retire_bit4(F.col("qc"))).otherwise(F.col("qc")).alias("qc"),
    )


def unit_report(minutes: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Rows and wrong-unit rows per variable. ``minutes(var, unit, value, ...)``."""
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    wrong = ~F.coalesce(F.col("unit") == F.try_element_at(want, F.col("var")), F.lit(False))
    return minutes.groupBy("var").agg(
        F.count("*").alias("n_minutes"),
        F.count_if(wrong).alias("n_wrong_unit"),
        F.count("value").alias("n_valid"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def missing_days(df: DataFrame, key: str, ts: str, first: str, last: str) -> DataFrame:
    """Calendar days of the period without any row, per key."""
    present = df.select(key, F.to_date(ts).alias("day")).distinct()
    wanted = present.select(key).distinct().select(
        key, F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")
    )
    return wanted.join(present, [key, "day"], "left_anti")

"""Views over the driver's tables that stand in for the archive inputs (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hourgrain.functions import scalars as S, spectra as P
from hourgrain.session import cut_lineage

# The axis of the 64-channel stand-in spectra and the mapped grid.
AXIS = [10.0 * 50.0 ** (j / 63.0) for j in range(64)]
GRID = P.geometric_grid(15.0, 300.0, 24)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._daily: DataFrame | None = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def target_raw(self) -> DataFrame:
        """Raw target rows: setpoint, quality flag, several rows per hour."""
        user = F.col("user_id")
        return self.read("events").select(
            F.col("event_type").alias("site"),
            "ts",
            S.floor_hour(F.col("ts")).alias("hour"),
            F.col("event_id").alias("seq"),
            F.col("value").alias("target"),
            F.when(user % 3 == 0, 0.2).otherwise(0.4).alias("ss"),
            F.when(user % 7 == 0, 1).when(user % 7 == 1, None).otherwise(0).alias("qc"),
        )

    def hourly(self) -> DataFrame:
        raw = self.target_raw().where(S.close_to(F.col("ss"), 0.4))
        return raw.groupBy("site", F.col("hour").alias("timestamp")).agg(
            F.avg("target").alias("target"),
            F.bool_and(S.qc_ok(F.col("qc"))).alias("instrument_ok"),
            F.count("*").alias("n"),
        )

    def good_hourly(self) -> DataFrame:
        return self.hourly().where(F.col("instrument_ok") & S.usable_value(F.col("target"))).select(
            "site", "timestamp", "target"
        )

    def daily(self) -> DataFrame:
        """Stored once for all uses: a mean of many rows can differ in its last digit from run to run, and a day's value must equal a threshold made from it."""
        if self._daily is None:
            days = self.read("orders").groupBy(F.col("o_orderpriority").alias("site"), F.col("o_orderdate").alias("timestamp"))
            self._daily = cut_lineage(days.agg(F.avg("o_totalprice").alias("value"), F.count("*").alias("n")))
        return self._daily

    def spectra(self) -> DataFrame:
        return self.read("embeddings").select(
            "vec_id",
            F.col("label").cast("string").alias("site"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + S.hours_interval(F.col("vec_id"))).alias("timestamp"),
            F.transform(
                "embedding", lambda x: F.when(~(x < F.lit(-0.3)), F.abs(x.cast("double")) * 1000)
            ).alias("density"),
        )

    def predictions(self) -> DataFrame:
        price, qty = F.col("l_extendedprice"), F.col("l_quantity")
        return self.read("lineitem").select(
            F.col("l_returnflag").alias("site"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("l_shipdate").alias("block_start"),
            (price / 1000).alias("target"),
            F.log1p(price / 1000).alias("y"),
            F.log1p(qty * 1.5).alias("p0"),
            F.log1p(qty * 1.5 * (1 - F.col("l_discount"))).alias("p1"),
            (qty / 50).alias("prob0"),
            ((qty / 50 + F.least(price / 100000, F.lit(1.0))) / 2).alias("prob1"),
            S.micros(F.col("l_shipdate")).alias("t"),
        )

    def minutes(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_type").alias("var"),
            "ts",
            S.floor_minute(F.col("ts")).alias("minute"),
            "value",
            F.col("user_id").bitwiseAND(F.lit(15).cast("bigint")).alias("qc"),
        )

    def hourly_spectra(self) -> DataFrame:
        """Numbers derived from each hour's spectrum (all sites share the stand-in spectra)."""
        d = F.col("density")
        total = P.range_integral(d, AXIS, "dndlog10dp", 15.0, 300.0)
        above = P.range_integral(d, AXIS, "dndlog10dp", 82.0, 300.0)
        return (
            self.spectra()
            .select("timestamp", "density", total.alias("total"), above.alias("n82"))
            .withColumn("f82", F.col("n82") / F.nullif(F.col("total"), F.lit(0.0)))
        )

    def observations(self) -> DataFrame:
        """Hours with a usable target and a usable spectrum: (site, timestamp, target, total, n82, f82)."""
        return self.good_hourly().join(
            self.hourly_spectra().where("total > 0").select("timestamp", "total", "n82", "f82"), "timestamp"
        ).select("site", "timestamp", "target", "total", "n82", "f82")

"""Values that meet thresholds made from them are the same values, even if a mean's last digit differs from run to run."""

from pyspark.sql import functions as F

from hourgrain.plans import q_align as Q
from hourgrain.sources.views import Tables


def test_the_row_at_a_threshold_reaches_it(spark, tmp_path):
    # 9 years of one price a day: with 4k + 1 fit days of a month, the quartile is a day's own value
    days = spark.range(9 * 365).select(
        F.lit("a").alias("o_orderpriority"), F.expr("timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(CAST(id AS INT))").alias("o_orderdate"), (F.xxhash64("id") % 100_000 / 7).alias("p")
    )
    days.write.parquet(f"{tmp_path}/orders.parquet")

    class Noisy(Tables):
        """Every reading differs in the last digits, as sums in another order do."""

        readings = 0

        def read(self, name):
            self.readings += 1
            return super().read(name).withColumn("o_totalprice", F.col("p") * (1 + F.pmod(F.xxhash64("p", F.lit(self.readings)), F.lit(3)) * 1e-13))

    t = Noisy(spark, str(tmp_path))
    rows = Q.labels.__wrapped__(t).join(Q.daily_split(t), ["site", "timestamp"]).where("fit")
    got = rows.groupBy("month").agg(F.count("*").alias("n"), F.count_if("high").alias("high"), F.count_if("low").alias("low")).collect()
    own = [r for r in got if r.n % 4 == 1]
    assert own and all(r.high == r.low == (r.n - 1) // 4 + 1 for r in own), own

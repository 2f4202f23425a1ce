"""Spectrum integrals, regridding, audits and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrain.functions import scalars as S, spectra as P
from hourgrain.operators import quality as Q, spectrum as X
from hourgrain.plans.registry import query, sql
from hourgrain.sources.views import AXIS, GRID, Tables

WIDTHS = P.log10_widths(AXIS)


def D():
    return F.col("density")


SEASON_SQL = "(['DJF','MAM','JJA','SON'])[month(timestamp) % 12 // 3 + 1]"
OVER = "greatest(0, least(hi, log10({b}::DOUBLE)) - greatest(lo, log10({a}::DOUBLE)))"


def over(a: float, b: float) -> str:
    return OVER.format(a=a, b=b)


def rounded(df, *skip):
    """Round every double column to 6 places."""
    return df.select(
        *[F.round(c, 6).alias(c) if k == "double" and c not in skip else F.col(c) for c, k in df.dtypes]
    )


@query(
    "spc01_channel_edges",
    sql("cells", """SELECT site, j, round(any_value(d), 6) AS diameter_nm, round(any_value(lo), 6) AS edge_lo, round(any_value(hi), 6) AS edge_hi,
    round(any_value(hi - lo), 6) AS width, true AS valid_axis FROM cells GROUP BY site, j"""),
)
def channel_edges(t: Tables):
    axis = P.array_lit(AXIS)
    channels = t.spectra().select("site", F.posexplode("density").alias("j", "v")).select("site", "j").distinct()
    channels = channels.select("site", F.col("j").cast("bigint").alias("j"), F.get(axis, F.col("j")).alias("diameter_nm"))
    return rounded(X.channel_edges(channels, "site", "diameter_nm"))


@query(
    "spc02_density",
    sql("cells", """SELECT vec_id, round(sum(v / (hi - lo)), 4) AS from_bins, round(sum(v), 4) AS from_log10,
    round(sum(v * ln(10)), 4) AS from_ln FROM cells GROUP BY vec_id"""),
)
def density(t: Tables):
    w = P.array_lit(WIDTHS)
    return t.spectra().select(
        "vec_id",
        F.round(P.array_sum(P.density_log10(D(), "bin_concentration", w)), 4).alias("from_bins"),
        F.round(P.array_sum(P.density_log10(D(), "dndlog10dp")), 4).alias("from_log10"),
        F.round(P.array_sum(P.density_log10(D(), "dndln_dp")), 4).alias("from_ln"),
    )


@query(
    "spc03_range_integral",
    sql("cells", f"""SELECT vec_id, round(coalesce(sum(v * {over(15, 300)}), 0), 6) AS from_log10,
      round(coalesce(sum(v * ln(10) * {over(15, 300)}), 0), 6) AS from_ln,
      round(coalesce(sum(v * greatest(0, least(log10(d) + hi - lo, log10(300::DOUBLE)) - greatest(log10(d), log10(15::DOUBLE))) / (hi - lo)), 0), 6) AS from_bins
    FROM cells GROUP BY vec_id"""),
)
def range_integral(t: Tables):
    return rounded(t.spectra().select(
        "vec_id",
        P.range_integral(D(), AXIS, "dndlog10dp", 15.0, 300.0).alias("from_log10"),
        P.range_integral(D(), AXIS, "dndln_dp", 15.0, 300.0).alias("from_ln"),
        P.range_integral(D(), AXIS, "bin_concentration", 15.0, 300.0, WIDTHS).alias("from_bins"),
    ))


@query(
    "spc04_full_integral",
    sql("cells", """SELECT vec_id, round(sum(v * (hi - lo)), 6) AS from_log10, round(sum(v * ln(10) * (hi - lo)), 6) AS from_ln,
    round(sum(v), 6) AS from_bins FROM cells GROUP BY vec_id"""),
)
def full_integral(t: Tables):
    return rounded(t.spectra().select(
        "vec_id",
        P.full_integral(D(), AXIS, "dndlog10dp").alias("from_log10"),
        P.full_integral(D(), AXIS, "dndln_dp").alias("from_ln"),
        P.full_integral(D(), AXIS, "bin_concentration", WIDTHS).alias("from_bins"),
    ))


@query(
    "spc05_regrid",
    sql("mapped", """SELECT vec_id, count(b) = 24 AS mapped_ok, round(sum(b), 6) AS total, round(max(b) FILTER (WHERE k = 0), 6) AS first_bin,
    round(max(b) FILTER (WHERE k = 11), 6) AS mid_bin, round(max(b) FILTER (WHERE k = 23), 6) AS last_bin FROM mapped GROUP BY vec_id"""),
)
def regrid(t: Tables):
    m = t.spectra().select("vec_id", P.regrid(D(), AXIS, GRID).alias("b"))
    return rounded(m.select(
        "vec_id", F.col("b").isNotNull().alias("mapped_ok"), P.array_sum(F.col("b")).alias("total"),
        *[F.get("b", F.lit(k)).alias(n) for k, n in ((0, "first_bin"), (11, "mid_bin"), (23, "last_bin"))],
    ))


VALID_SQL = f"""bool_and(v IS NOT NULL OR {over(15, 300)} = 0) AND count(v) / 64 >= 0.8 AND sum(v) > 0"""


def row_ok():
    return P.row_valid(D(), len(AXIS), P.channels_complete(D(), AXIS, 15.0, 300.0))


@query("spc06_row_valid", sql("cells", f"SELECT vec_id, {VALID_SQL} AS valid, count(v) / 64 >= 0.8 AND sum(v) > 0 AS loose FROM cells GROUP BY vec_id"))
def row_valid(t: Tables):
    return t.spectra().select("vec_id", row_ok().alias("valid"), P.row_valid(D(), len(AXIS)).alias("loose"))


AUDIT_ROWS = sql("mapped cells", "", base=f"""SELECT vec_id, any_value(site) AS site, {VALID_SQL} AS ok, coalesce(sum(v * {over(15, 300)}), 0) AS native,
      sum(v * (hi - lo)) AS full_n, sum(v * (hi - lo)) * (1 + (vec_id % 5 - 2) / 100) AS supplied FROM cells GROUP BY vec_id""",
    m="SELECT vec_id, CASE WHEN count(b) = 24 THEN sum(b) END AS mapped FROM mapped GROUP BY vec_id",
    r="""SELECT site, ok, mapped IS NOT NULL AND ok AS mok, CASE WHEN ok AND native > 0 THEN mapped / native END AS c,
      CASE WHEN ok THEN full_n / supplied END AS s FROM base JOIN m USING (vec_id)""")


@query(
    "spc07_audit",
    AUDIT_ROWS + """SELECT *, abs(conservation_median - 1) <= 0.03 AND conservation_q05 >= 0.95 AND conservation_q95 <= 1.05 AS conservation_gate,
      abs(total_median - 1) <= 0.05 AND total_q05 >= 0.95 AND total_q95 <= 1.05 AS total_gate, mapped_valid_fraction >= 0.95 AS coverage_gate,
      abs(conservation_median - 1) <= 0.03 AND conservation_q05 >= 0.95 AND conservation_q95 <= 1.05 AND
      abs(total_median - 1) <= 0.05 AND total_q05 >= 0.95 AND total_q95 <= 1.05 AND mapped_valid_fraction >= 0.95 AS passed FROM
      (SELECT site, count(*) AS n_rows, count(*) FILTER (WHERE ok) AS n_input_valid, count(*) FILTER (WHERE mok) AS n_mapped_valid,
        0::BIGINT AS n_negative_cells, round(count(*) FILTER (WHERE mok) / greatest(count(*) FILTER (WHERE ok), 1), 6) AS mapped_valid_fraction,
        round(quantile_cont(c, 0.05), 6) AS conservation_q05, round(quantile_cont(c, 0.5), 6) AS conservation_median, round(quantile_cont(c, 0.95), 6) AS conservation_q95,
        round(quantile_cont(s, 0.05), 6) AS total_q05, round(quantile_cont(s, 0.5), 6) AS total_median, round(quantile_cont(s, 0.95), 6) AS total_q95
      FROM r GROUP BY site)""",
)
def audit(t: Tables):
    supplied = P.full_integral(D(), AXIS, "dndlog10dp") * (1 + (F.col("vec_id") % 5 - 2) / 100)
    a = X.audit(t.spectra(), ["site"], "density", row_ok(), AXIS, GRID, supplied=supplied)
    return rounded(a.drop("direct_q05", "direct_median", "direct_q95", "n_usable"))


@query(
    "spc08_direct_bias",
    sql("mapped cells", """SELECT site, round(quantile_cont(x / native, 0.05), 5) AS direct_q05, round(quantile_cont(x / native, 0.5), 5) AS direct_median,
      round(quantile_cont(x / native, 0.95), 5) AS direct_q95 FROM n JOIN m USING (vec_id) WHERE ok AND native > 0 GROUP BY site""",
      g="SELECT min(log10(d)) AS lo0, max(log10(d)) + max(hi - lo) AS hi0 FROM grid",
      n=f"""SELECT vec_id, any_value(site) AS site, {VALID_SQL} AS ok,
        sum(v * greatest(0, least(log10(d) + hi - lo, hi0) - greatest(log10(d), lo0)) / (hi - lo)) AS native FROM cells, g GROUP BY vec_id""",
      m="SELECT vec_id, CASE WHEN count(b) = 24 THEN sum(b / (g.hi - g.lo)) END AS x FROM mapped JOIN grid g USING (k) GROUP BY vec_id"),
)
def direct_bias(t: Tables):
    a = X.audit(t.spectra(), ["site"], "density", row_ok(), AXIS, GRID, "bin_concentration", widths=WIDTHS)
    return a.select("site", *[F.round(c, 5).alias(c) for c in ("direct_q05", "direct_median", "direct_q95")])


def band_sql(a, b, alias):
    return f"""CASE WHEN sum(CASE WHEN v IS NOT NULL THEN {over(a, b)} ELSE 0 END) >= 0.75 * sum({over(a, b)})
        THEN coalesce(sum(v * {over(a, b)}), 0) END AS {alias}"""


BANDS_CTE = "SELECT vec_id, any_value(timestamp) AS timestamp, " + ", ".join(band_sql(a, b, n) for n, (a, b) in P.BANDS.items()) + """,
    CASE WHEN sum(v * (hi - lo)) > 0 THEN pow(10, sum(v * (hi - lo) * log10(d)) / sum(v * (hi - lo))) END AS pnsd_gmd FROM cells GROUP BY vec_id"""
FRACTIONS_SQL = ", ".join(f"{n} / nullif(n_15_300, 0) AS frac_{n[2:]}" for n in P.BANDS if n != "n_15_300")


def bands(t: Tables):
    s = t.spectra().select("vec_id", "timestamp", *[c.alias(n) for n, c in P.band_values(D(), AXIS).items()],
                           P.geometric_mean_diameter(D(), AXIS).alias("pnsd_gmd"))
    return s.select("*", *[c.alias(n) for n, c in P.band_fractions().items()])


@query("spc09_band_values", sql("cells", "SELECT vec_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in P.BANDS) + " FROM b", b=BANDS_CTE))
def band_values(t: Tables):
    return rounded(bands(t).select("vec_id", *P.BANDS))


FRACTION_NAMES = [f"frac_{n[2:]}" for n in P.BANDS if n != "n_15_300"]


@query(
    "spc10_band_fractions",
    sql("cells", "SELECT vec_id, " + ", ".join(f"round({n} / nullif(n_15_300, 0), 6) AS frac_{n[2:]}" for n in P.BANDS if n != "n_15_300") + " FROM b", b=BANDS_CTE),
)
def band_fractions(t: Tables):
    return rounded(bands(t).select("vec_id", *FRACTION_NAMES))


@query("spc11_geometric_mean_diameter", sql("cells", "SELECT vec_id, round(pnsd_gmd, 6) AS gmd FROM b", b=BANDS_CTE))
def gmd(t: Tables):
    return rounded(t.spectra().select("vec_id", P.geometric_mean_diameter(D(), AXIS).alias("gmd")))


def above_sql(c):
    return f"sum(b * greatest(0, least(1, (hi - greatest(lo, log10({c}::DOUBLE))) / (hi - lo))))"


def mapped_bins(t: Tables):
    return t.spectra().select("vec_id", "site", "timestamp", P.regrid(D(), AXIS, GRID).alias("bins")).where("bins IS NOT NULL")


@query(
    "spc12_fraction_above",
    sql("mapped", f"""SELECT vec_id, round({above_sql(82)}, 6) AS count, round({above_sql(82)} / sum(b), 6) AS fraction
    FROM mapped JOIN grid USING (k) GROUP BY vec_id HAVING count(b) = 24"""),
)
def fraction_above(t: Tables):
    b = F.col("bins")
    return rounded(mapped_bins(t).select("vec_id", P.count_above(b, GRID, 82.0).alias("count"), P.fraction_above(b, GRID, 82.0).alias("fraction")))


CUTOFFS = (50.0, 65.0, 82.0, 100.0, 125.0, 150.0, 80.0)


@query(
    "spc13_cutoff_scan",
    sql("mapped", "\nUNION ALL ".join(f"""SELECT site, {c}::DOUBLE AS cutoff_nm, count(*) AS n, round(avg(f), 6) AS mean_fraction, round(sum(a), 4) AS sum_count FROM
      (SELECT vec_id, any_value(site) AS site, {above_sql(c)} AS a, {above_sql(c)} / sum(b) AS f FROM mapped JOIN grid USING (k) GROUP BY vec_id HAVING count(b) = 24) GROUP BY site"""
      for c in CUTOFFS)),
)
def cutoff_scan(t: Tables):
    c = X.with_cutoffs(mapped_bins(t), F.col("bins"), GRID, CUTOFFS)
    return c.groupBy("site", "cutoff_nm").agg(
        F.count("*").alias("n"), F.round(F.avg("fraction_above"), 6).alias("mean_fraction"), F.round(F.sum("count_above"), 4).alias("sum_count")
    )


@query(
    "spc14_bin_fractions",
    sql("mapped", """SELECT vec_id, round(max(b) FILTER (WHERE k = 0) / sum(b), 6) AS first_share, round(1 - max(b) FILTER (WHERE k = 23) / sum(b), 6) AS sum23,
    1::DOUBLE AS sum24 FROM mapped GROUP BY vec_id HAVING count(b) = 24"""),
)
def bin_fractions(t: Tables):
    b = F.col("bins")
    return rounded(mapped_bins(t).select(
        "vec_id", F.get(P.bin_fractions(b), F.lit(0)).alias("first_share"), P.array_sum(P.bin_fractions(b, 23)).alias("sum23"),
        P.array_sum(P.bin_fractions(b)).alias("sum24"),
    ))


EXT_CTE = f"""SELECT *, total + tail AS total_ext, n82 + tail AS n82_ext, (n82 + tail) / nullif(total + tail, 0) AS f82_ext, n82 / nullif(total, 0) AS f82 FROM
      (SELECT vec_id, any_value(site) AS site, any_value(timestamp) AS timestamp, coalesce(sum(v * {over(15, 300)}), 0) AS total,
       coalesce(sum(v * {over(82, 300)}), 0) AS n82, bool_and(v IS NOT NULL OR {over(15, 500)} = 0) AS extended_ok,
       CASE WHEN bool_and(v IS NOT NULL OR {over(15, 500)} = 0) THEN sum(v * {over(300, 500)}) END AS tail FROM cells GROUP BY vec_id)"""


def extended(t: Tables):
    s = t.spectra().select(
        "vec_id", "site", "timestamp", "density",
        P.range_integral(D(), AXIS, "dndlog10dp", 15.0, 300.0).alias("total"), P.range_integral(D(), AXIS, "dndlog10dp", 82.0, 300.0).alias("n82"),
    ).withColumn("f82", F.col("n82") / F.nullif(F.col("total"), F.lit(0.0)))
    return X.extend_range(s, "density", AXIS)


@query(
    "spc15_range_extension",
    sql("cells", """SELECT site, count(*) AS n_rows, count(*) FILTER (WHERE extended_ok) AS n_extended, round(sum(tail), 4) AS sum_tail,
    round(sum(total_ext), 4) AS sum_total_ext, round(avg(f82_ext), 6) AS mean_f82_ext,
    CASE WHEN count(*) FILTER (WHERE extended_ok) = 0 THEN 'unavailable' ELSE 'available' END AS status FROM e GROUP BY site""", e=EXT_CTE),
)
def range_extension(t: Tables):
    n = F.count_if("extended_ok")
    return extended(t).groupBy("site").agg(
        F.count("*").alias("n_rows"), n.alias("n_extended"), F.round(F.sum("tail"), 4).alias("sum_tail"),
        F.round(F.sum("total_ext"), 4).alias("sum_total_ext"), F.round(F.avg("f82_ext"), 6).alias("mean_f82_ext"),
        F.when(n == 0, "unavailable").otherwise("available").alias("status"),
    )


@query(
    "spc16_tail_contribution",
    sql("cells", """SELECT site, period, metric, count(*) AS n, round(quantile_cont(x, 0.05), 6) AS q05, round(quantile_cont(x, 0.5), 6) AS median,
      round(quantile_cont(x, 0.95), 6) AS q95 FROM (SELECT site, unnest(p) AS period, metric, x FROM l) GROUP BY site, period, metric""",
      e=EXT_CTE,
      l=f"""SELECT site, ['all', CASE WHEN vec_id >= 400 THEN 'test' ELSE 'fit' END, {SEASON_SQL}] AS p,
        unnest(['tail_over_total', 'tail_over_n82', 'tail_share', 'fraction_change']) AS metric,
        unnest([tail / total, tail / n82, tail / total_ext, f82_ext - f82]) AS x FROM e WHERE extended_ok"""),
)
def tail_contribution(t: Tables):
    return rounded(X.tail_contribution(extended(t), "site", "timestamp", F.col("vec_id") >= 400))


@query(
    "spc17_profiles",
    sql("mapped", f"""SELECT season, grp AS "group", k, round(any_value(d), 6) AS diameter_nm, count(*) AS n, round(quantile_cont(x, 0.25), 6) AS q25,
      round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75 FROM
      (SELECT {SEASON_SQL} AS season, CASE WHEN vec_id % 3 = 0 THEN 'high' ELSE 'low' END AS grp, k, d, b / sum(b) OVER (PARTITION BY vec_id) / (hi - lo) AS x
       FROM mapped JOIN grid USING (k) WHERE b IS NOT NULL) GROUP BY season, grp, k"""),
)
def profiles(t: Tables):
    m = mapped_bins(t).withColumn("season", S.season_of(F.month("timestamp"))).withColumn(
        "group", F.when(F.col("vec_id") % 3 == 0, "high").otherwise("low")
    )
    p = X.profiles(m, ["season", "group"], F.col("bins"), GRID)
    return rounded(p.withColumn("k", F.col("k").cast("bigint")))


@query(
    "spc18_spectrum_complete",
    sql("cells", f"SELECT vec_id, {' AND '.join(f'{c} IS NOT NULL' for c in P.SPECTRUM_COLUMNS)} AS complete FROM (SELECT *, {FRACTIONS_SQL} FROM b)", b=BANDS_CTE),
)
def spectrum_complete(t: Tables):
    b = bands(t)
    ok = F.lit(True)
    for c in P.SPECTRUM_COLUMNS:
        ok = ok & F.col(c).isNotNull()
    return b.select("vec_id", ok.alias("complete"))

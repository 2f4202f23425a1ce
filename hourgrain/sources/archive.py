"""Scans of the archive's CSV files. Everything is read as text and coerced, bad values become NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourgrain.functions import scalars as S, spectra as P
from hourgrain.operators.quality import keep_last

# File-name pattern of hourly spectra, and sites whose files are not named in capitals.
SPECTRUM_FILE = r"([A-Za-z][A-Za-z0-9_]*?)_smps_hour"
FILE_TOKENS = {"SBS_CP": "SBS_cp", "SBS_SPL": "SBS_spl"}
SETPOINT = 0.4


def read_text_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All-text scan plus the ingest order: (file, block offset, position) sorts as the rows stand."""
    raw = spark.read.option("header", True).csv(list(paths))
    return raw.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_path").alias("f"),
            F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("i"),
        ).alias("seq"),
    )


def pack_channels(df: DataFrame, out: str = "density") -> tuple[DataFrame, list[float]]:
    """Replace the wide ``D_*`` columns by one array ordered by diameter; also return the axis."""
    axis = P.channel_axis(df.columns)
    names = [c for _, c in axis]
    packed = F.array(*[S.numeric(F.col(f"`{c}`")) for c in names])
    return df.select(*[c for c in df.columns if c not in names], packed.alias(out)), [d for d, _ in axis]


def _optional(df: DataFrame, name: str) -> Column:
    return S.numeric(F.col(name)) if name in df.columns else F.lit(None).cast("double")


def spectra_from_rows(df: DataFrame, axis_name: str = "axis") -> DataFrame:
    """Typed spectrum rows of one channel layout; the layout travels along as an array."""
    packed, axis = pack_channels(df)
    qc = _optional(packed, "Qc_CPC_SMPS")
    return packed.select(
        F.upper(F.regexp_extract("file", SPECTRUM_FILE, 1)).alias("site"),
        S.utc_timestamp(F.col("Start_date")).alias("timestamp"),
        "seq",
        "density",
        P.array_lit(axis).alias(axis_name),
        _optional(packed, "N_CN_SMPS_STP").alias("supplied_total"),
        _optional(packed, "P_SMPS").alias("p_smps"),
        _optional(packed, "T_SMPS").alias("t_smps"),
        _optional(packed, "RH_SMPS").alias("rh_smps"),
        S.qc_ok(qc).alias("spectrum_ok"),
        S.qc_strict(qc).alias("spectrum_strict_ok"),
    )


def scan_spectra(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Scan many files; files that share a header are one scan, layouts are united by name.

    Only header lines reach the driver (one small read per path, a few per site and year).
    """
    layouts: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        layouts.setdefault(tuple(spark.read.option("header", True).csv(p).columns), []).append(p)
    parts = [spectra_from_rows(read_text_csv(spark, group)) for group in layouts.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_spectra(spark: SparkSession, paths: Sequence[str], excluded: str = "") -> DataFrame:
    """Last row per site and hour in ingest order, without the excluded sites."""
    return keep_last(exclude_sites(scan_spectra(spark, paths), excluded), ["site", "timestamp"], ["seq"])


def exclude_sites(df: DataFrame, listed: str, site: str = "site") -> DataFrame:
    """Drop the sites of a comma-separated list; blanks and letter case do not matter."""
    names = sorted({s.strip().upper() for s in listed.split(",") if s.strip()})
    return df.where(~F.upper(site).isin(names)) if names else df


def site_glob(root: str, site: str) -> str:
    """Path pattern of one site's hourly spectrum files."""
    return f"{root}/{FILE_TOKENS.get(site, site)}_smps_hour*"


def target_column_b(rows: DataFrame) -> DataFrame:
    """Hourly target rows (text columns) at the 0.4 setpoint with their two flags."""
    return (
        rows.select(
            "site", "seq",
            S.utc_timestamp(F.col("Start_date")).alias("timestamp"),
            S.numeric(F.col("SS_setpoint_B")).alias("ss"),
            S.numeric(F.col("N_CCN_mean_STP_B")).alias("target"),
            S.qc_ok(S.numeric(F.col("Qc_CPC_SMPS"))).alias("instrument_ok"),
            S.qc_ok(S.numeric(F.col("Qc_CCN04_N80_B"))).alias("closure_ok"),
        )
        .where(S.close_to(F.col("ss"), SETPOINT))
        .drop("ss")
    )


def target_column_a(rows: DataFrame) -> DataFrame:
    """Sub-hourly target rows: hourly mean, an hour passes closure when all its rows do."""
    return (
        rows.select(
            "site",
            S.floor_hour(S.utc_timestamp(F.col("Start_date"))).alias("timestamp"),
            S.numeric(F.col("SS_harmonized_A")).alias("ss"),
            S.numeric(F.col("N_CCN_mean_STP_A")).alias("v"),
            S.qc_ok(S.numeric(F.col("Qc_CCN04_N80_A"))).alias("ok"),
        )
        .where(S.close_to(F.col("ss"), SETPOINT) & F.col("timestamp").isNotNull())
        .groupBy("site", "timestamp")
        .agg(F.avg("v").alias("target"), F.bool_and("ok").alias("closure_ok"))
        .withColumn("instrument_ok", F.lit(True))
    )


def load_target(column_b: DataFrame, column_a: DataFrame) -> DataFrame:
    """Column B wherever a site has any, column A for the other sites."""
    cols = ["site", "timestamp", "target", "instrument_ok", "closure_ok"]
    b = keep_last(target_column_b(column_b), ["site", "timestamp"], ["seq"]).select(cols)
    a = target_column_a(column_a).join(column_b.select("site").distinct(), "site", "left_anti")
    return b.unionByName(a.select(cols))

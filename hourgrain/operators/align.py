"""Time alignment by exact equality: leads, origins, blocks, histories.

Leads and slots are generated per row from a fixed list, so every join below is an equi-join on
(key, time) and a hot site spreads over its own hours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hourgrain.functions import scalars as S

BLOCK_HOURS = 6


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails at run time when a key repeats on either side.

    Each side carries its copies per key through an aggregate, so the check costs no second join.
    """
    def once(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        g = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*rest)).alias("__row"))
        checked = F.when(F.col("__n") == 1, F.col("__row")).otherwise(
            F.raise_error(F.lit(f"repeated key on the {side} side")).cast(g.schema["__row"].dataType)
        )
        return g.select(*keys, checked.alias("__row")).select(*keys, "__row.*")

    return once(left, "left").join(once(right, "right"), list(keys), "inner")


def with_leads(df: DataFrame, leads: Sequence[int], ts: str = "timestamp") -> DataFrame:
    """One row per row and lead, with the exact future time."""
    return df.withColumn("lead_h", F.explode(F.array(*[F.lit(int(h)) for h in leads]))).withColumn(
        "future_ts", F.col(ts) + S.hours_interval(F.col("lead_h"))
    )


def exact_lead(df: DataFrame, future: DataFrame, key: str, leads: Sequence[int], values: dict[str, str], ts: str = "timestamp") -> DataFrame:
    """Values at exactly ``ts + h``; a gap gives NULL (``lead()`` would skip over it)."""
    right = future.select(key, F.col(ts).alias("future_ts"), *[F.col(c).alias(n) for c, n in values.items()])
    return with_leads(df, leads, ts).join(right, [key, "future_ts"], "left")


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], valid: str) -> DataFrame:
    """Left lookup of a row and its validity; an absent row is not valid."""
    found = table.withColumn("__hit", F.lit(True))
    return (
        df.join(found, list(on), "left")
        .withColumn("found", F.coalesce("__hit", F.lit(False)))
        .withColumn(valid, S.known_true(F.col(valid)))
        .drop("__hit")
    )


def six_hour_blocks(hourly: DataFrame, key: str = "site", value: str = "target", ts: str = "timestamp", extra: dict | None = None) -> DataFrame:
    """Dense calendar of six-hour blocks per key with the count and mean of its valid hours.

    ``hourly`` holds the valid hours only. The blocks with data come from one aggregate; the
    calendar between each key's first and last block is generated, not taken from the data.
    """
    start = S.floor_six_hours(F.col(ts))
    filled = hourly.groupBy(key, start.alias("block_start")).agg(
        F.count(value).alias("n_valid"), F.avg(value).alias("mean_value"), *[c.alias(n) for n, c in (extra or {}).items()]
    )
    span = filled.groupBy(key).agg(F.min("block_start").alias("a"), F.max("block_start").alias("b"))
    step = F.expr(f"INTERVAL {BLOCK_HOURS} HOURS")
    calendar = span.select(key, F.explode(F.sequence("a", "b", step)).alias("block_start"))
    out = calendar.join(filled, [key, "block_start"], "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    month = F.month("block_start")
    return out.withColumn("block_end", F.col("block_start") + S.hours_interval(BLOCK_HOURS)).withColumn(
        "month", month.cast("int")
    ).withColumn("season", S.season_of(month))


def block_origins(blocks: DataFrame, predictors: DataFrame, leads: Sequence[int], key: str = "site", ts: str = "timestamp", valid: str = "current_ok") -> DataFrame:
    """Long form (block, lead) with the predictors valid at ``block_start - lead``."""
    rows = blocks.withColumn("lead_h", F.explode(F.array(*[F.lit(int(h)) for h in leads]))).withColumn(
        "origin", F.col("block_start") - S.hours_interval(F.col("lead_h"))
    )
    right = predictors.withColumnRenamed(ts, "origin")
    names = [c for c in right.columns if c not in (key, "origin", valid)]
    j = rows.join(right, [key, "origin"], "left").withColumn("origin_valid", S.known_true(F.col(valid)))
    return j.select(*rows.columns, "origin_valid", *[F.when(F.col("origin_valid"), F.col(c)).alias(c) for c in names])


def history(rows: DataFrame, series: DataFrame, keys: Sequence[str], values: Sequence[str], steps: int = 6,
            origin: str = "origin", key: str = "site", ts: str = "timestamp") -> DataFrame:
    """Arrays of ``steps`` hourly values ending at the origin, oldest first, and whether all exist.

    Each origin asks for its own hours, so the grouping key is the row and never a whole series.
    """
    wanted = rows.select(*keys, origin, F.explode(F.array(*[F.lit(k) for k in range(steps)])).alias("__k"))
    wanted = wanted.withColumn(ts, F.col(origin) - S.hours_interval(F.col("__k")))
    hit = wanted.join(series.select(key, ts, *values), [key, ts], "inner")
    back = F.struct((-F.col("__k")).alias("k"), *[F.col(v) for v in values])
    packed = hit.groupBy(*keys).agg(F.array_sort(F.collect_list(back)).alias("__h"))
    out = packed.select(*keys, *[F.col(f"__h.{v}").alias(f"{v}_history") for v in values], (F.size("__h") == steps).alias("history_complete"))
    return rows.join(out, list(keys), "left").withColumn("history_complete", S.known_true(F.col("history_complete")))


def recent_mean(rows: DataFrame, series: DataFrame, keys: Sequence[str], value: str, hours: int = 6, at_least: int = 4,
                origin: str = "origin", key: str = "site", ts: str = "timestamp") -> DataFrame:
    """Mean of the last ``hours`` values up to the origin (with enough of them) and the value at it."""
    wanted = rows.select(*keys, origin, F.explode(F.array(*[F.lit(k) for k in range(hours)])).alias("__k")).withColumn(
        ts, F.col(origin) - S.hours_interval(F.col("__k"))
    )
    hit = wanted.join(series.select(key, ts, F.col(value).alias("__v")), [key, ts], "inner")
    stats = hit.groupBy(*keys).agg(
        F.count("__v").alias("recent_n"),
        F.when(F.count("__v") >= at_least, F.avg("__v")).alias("recent_mean"),
        F.max(F.when(F.col("__k") == 0, F.col("__v"))).alias("current_value"),
    )
    return rows.join(stats, list(keys), "left").withColumn("recent_n", F.coalesce("recent_n", F.lit(0)))


def month_threshold(rows: DataFrame, thresholds: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Threshold of the row's calendar month; unsupported months stay NULL."""
    t = thresholds.select(*keys, F.when(F.col("supported"), F.col(value)).alias("threshold"))
    return rows.join(t, list(keys), "left")


def at_origin(rows: DataFrame, hourly: DataFrame, ts: str, on: Sequence[str] = ()) -> DataFrame:
    """Hourly weather (or any hourly table) at the row's origin."""
    return rows.join(hourly.withColumnRenamed(ts, "origin"), [*on, "origin"], "left")


def align_predictions(rows: DataFrame, predictions: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Bring predictions back to every row; rows without one stay NULL."""
    return rows.join(predictions.select(*keys, *[F.col(c).alias(n) for c, n in columns.items()]), list(keys), "left")


"""Block-bootstrap intervals with predictions held fixed.

Draws are a pure function of (seed, draw, slot), so lost tasks recompute the same sample. Rows are
aggregated to calendar blocks before they meet the draws: what is multiplied by the number of draws
is bounded by the calendar, not by the table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from hourgrain.functions import scalars as S
from hourgrain.operators import ordering as O, redraw as R
from hourgrain.session import few


def date_block(ts: Column) -> Column:
    return S.epoch_day(ts)


def week_block(ts: Column) -> Column:
    return S.epoch_week(ts)


def anchored_block(df: DataFrame, keys: Sequence[str], ts: str, days: int, out: str = "block") -> DataFrame:
    """Blocks of ``days`` days counted from the first date of each group's sample.

    The first dates are counted and broadcast: shuffled by the group, all rows of a group would meet in one task.
    """
    first = df.groupBy(*keys).agg(F.min(S.epoch_day(F.col(ts))).alias("__first"))
    j = O.join_groups(df, few(first), keys)
    return j.withColumn(out, F.floor((S.epoch_day(F.col(ts)) - F.col("__first")) / days).cast("bigint")).drop("__first")


def pick(seed: int | Column, draw: Column, slot: Column, n: Column) -> Column:
    """Uniform block index from a hash."""
    seed = F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")
    text = F.concat_ws("|", seed, draw.cast("string"), slot.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), n)


def draw_blocks(blocks: DataFrame, keys: Sequence[str], block: str, draws: int, seed: int) -> DataFrame:
    """(keys, draw, slot, block): as many picks per draw as the group has distinct blocks.

    Each group's distinct blocks are numbered in order; there are at most as many as calendar days.
    """
    keys = list(keys)
    distinct = blocks.select(*keys, block).distinct()
    index = distinct.withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy(block)) - 1)
    size = distinct.groupBy(*keys).agg(F.count("*").alias("__nb"))
    slots = (
        size.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__nb") - 1)))
        .withColumn("__i", pick(seed, F.col("draw"), F.col("slot"), F.col("__nb")).cast("int"))
        .drop("__nb")
    )
    return O.join_groups(slots, index, [*keys, "__i"]).drop("__i")


def interval(values: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """2.5 and 97.5 percentiles over the draws (their number bounds the group); NULL draws are skipped.

    Between two draws the share of their difference is added to the lower one, as in SQL, so that ends halfway between two rounded values round alike.
    """
    by = values.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.col(n).cast("double"))).alias(n) for n in names])

    def end(n: str, q: float) -> Column:
        place = (F.size(n) - 1) * F.lit(q)
        below, above = (F.try_element_at(F.col(n), side(place).cast("int") + 1) for side in (F.floor, F.ceil))
        return F.when(F.size(n) > 0, F.when(below == above, below).otherwise(below + (above - below) * (place - F.floor(place))))

    ends = [end(n, q).alias(f"{n}_{side}95") for n in names for side, q in (("lo", 0.025), ("hi", 0.975))]
    return by.select(*keys, *ends, *[F.size(n).cast("bigint").alias(f"{n}_valid_draws") for n in names])


def resampled_sums(df: DataFrame, keys: Sequence[str], block: str, sums: dict[str, Column], draws: int, seed: int) -> DataFrame:
    """Per draw, the sums over the sampled blocks: (keys, draw, *sums). NULL sums of blocks are left out; a draw whose sum is NaN is NULL.

    Blocks of a group are bounded by the calendar, so a task weighs a group's block sums by the array of all draws.
    """
    keys, names = list(keys), list(sums)
    per = df.groupBy(*keys, block).agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()])
    known = [F.col(n).isNotNull().alias(f"__is_{n}") for n in names]
    schema = T.StructType([per.schema[k] for k in keys] + [T.StructField("draw", T.IntegerType())] + [T.StructField(n, T.DoubleType()) for n in names])

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(block, na_position="first")
        taken = R.times(seed, draws, len(rows)).T
        out = {k: [rows[k].iloc[0]] * draws for k in keys} | {"draw": np.arange(draws)}
        for n in names:
            is_known = rows[f"__is_{n}"].to_numpy(dtype=bool)
            value, mine = rows[n].to_numpy(dtype=float)[is_known], taken[:, is_known]
            total = np.multiply(mine, value, where=mine > 0, out=np.zeros_like(mine)).sum(axis=1)
            out[n] = [x if some else None for x, some in zip(total.tolist(), (mine > 0).any(axis=1).tolist())]
        return pd.DataFrame(out, columns=schema.names)

    return per.select("*", *known).groupBy(*keys).applyInPandas(weigh, schema)


def r2_gain_interval(df: DataFrame, keys: Sequence[str], block: str, y: str, p0: str, p1: str, seed: int, draws: int = 1000) -> DataFrame:
    """Interval of the R2 change and of the raw error reduction of two fixed predictions."""
    yy, a, b = F.col(y), F.col(p0), F.col(p1)
    s = resampled_sums(
        df, keys, block,
        {
            "__n": F.lit(1.0), "__sy": yy, "__sy2": yy * yy, "__e0": (yy - a) * (yy - a), "__e1": (yy - b) * (yy - b),
            "__mae": F.abs(F.expm1(yy) - F.expm1(a)) - F.abs(F.expm1(yy) - F.expm1(b)),
        },
        draws, seed,
    )
    sst = F.col("__sy2") - F.col("__sy") * F.col("__sy") / F.col("__n")
    v = s.select(
        *keys, S.finite(F.try_divide(F.col("__e0") - F.col("__e1"), sst)).alias("delta_r2"), (F.col("__mae") / F.col("__n")).alias("mae_gain")
    )
    blocks = df.select(*keys, block).distinct().groupBy(*keys).agg(F.count("*").alias("n_blocks"))
    return O.join_groups(interval(v, keys, ["delta_r2", "mae_gain"]), blocks, keys).drop("delta_r2_valid_draws", "mae_gain_valid_draws")


def brier_gain_interval(df: DataFrame, keys: Sequence[str], block: str, event: str, p0: str, p1: str, seed: int, draws: int = 2000) -> DataFrame:
    e = F.col(event).cast("double")
    gain = (e - F.col(p0)) * (e - F.col(p0)) - (e - F.col(p1)) * (e - F.col(p1))
    s = resampled_sums(df, keys, block, {"__n": F.lit(1.0), "__g": gain}, draws, seed)
    v = s.select(*keys, (F.col("__g") / F.col("__n")).alias("brier_gain"))
    return interval(v, keys, ["brier_gain"]).drop("brier_gain_valid_draws")


def resampled_cut(rows: DataFrame, keys: Sequence[str], draw_keys: Sequence[str], taken: DataFrame, block: str, p: str, event: str,
                  ties: Sequence[str], fractions: Sequence[float], buckets: int = 256) -> DataFrame:
    """Where a re-ranked top selection ends in each draw, and its hits, without copying rows per draw.

    A draw orders its rows by (p descending, slot, ties). Three steps find the last selected row:
    counts per (block, probability bucket) locate the bucket, counts per (block, exact p) inside
    that bucket locate the (p, slot), and the stored order of that one block's tied rows gives the
    row. ``taken`` is (draw_keys, draw, slot, block). Result: (keys, draw, fraction, k, hits, cut).
    """
    keys, draw_keys = list(keys), list(draw_keys)
    top = F.least(F.greatest(F.floor(F.col(p) * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")
    rows = rows.withColumn("__b", F.lit(buckets - 1) - top)
    hit = F.col(event).cast("bigint")
    cells = rows.groupBy(*keys, block, "__b").agg(F.count("*").alias("__n"), F.sum(hit).alias("__h"))
    times = taken.groupBy(*draw_keys, "draw", block).agg(F.count("*").alias("__m"))
    per = cells.join(times, [*draw_keys, block]).groupBy(*keys, "draw", "__b").agg(
        F.sum(F.col("__n") * F.col("__m")).alias("__n"), F.sum(F.col("__h") * F.col("__m")).alias("__h")
    )
    group = W.partitionBy(*keys, "draw")
    upto = group.orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    per = per.select(
        *keys, "draw", "__b", "__n", "__h", F.sum("__n").over(upto).alias("__cn"), F.sum("__h").over(upto).alias("__ch"),
        F.sum("__n").over(group).alias("__total"),
    )
    per = per.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    per = per.withColumn("k", F.ceil(F.col("fraction") * F.col("__total").cast("double")))
    edge = per.where((F.col("__cn") >= F.col("k")) & (F.col("__cn") - F.col("__n") < F.col("k"))).select(
        *keys, "draw", "fraction", "k", "__b", (F.col("k") - F.col("__cn") + F.col("__n")).alias("__need"),
        (F.col("__ch") - F.col("__h")).alias("__h0"),
    )
    tied = rows.groupBy(*keys, block, "__b", p).agg(F.count("*").alias("__n"), F.sum(hit).alias("__h"))
    units = edge.join(tied, [*keys, "__b"]).join(taken, [*draw_keys, "draw", block])
    along = W.partitionBy(*keys, "draw", "fraction").orderBy(F.desc(p), "slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    units = units.withColumn("__cn", F.sum("__n").over(along)).withColumn("__ch", F.sum("__h").over(along))
    last = units.where((F.col("__cn") >= F.col("__need")) & (F.col("__cn") - F.col("__n") < F.col("__need"))).select(
        *keys, "draw", "fraction", "k", block, p, "slot", (F.col("__need") - F.col("__cn") + F.col("__n")).alias("__rn"),
        (F.col("__h0") + F.col("__ch") - F.col("__h")).alias("__h1"),
    )
    inside = rows.join(last.select(*keys, block, p).distinct(), [*keys, block, p], "left_semi")
    stored = W.partitionBy(*keys, block, p).orderBy(*ties)
    inside = inside.select(
        *keys, block, p, *ties, F.row_number().over(stored).cast("bigint").alias("__rn"),
        F.sum(hit).over(stored.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("__h2"),
    )
    return last.join(inside, [*keys, block, p, "__rn"]).select(
        *keys, "draw", "fraction", "k", (F.col("__h1") + F.col("__h2")).alias("hits"),
        draw_order(p, "slot", ties).alias("cut"),
    )


def draw_order(p: str, slot: str, ties: Sequence[str]) -> Column:
    """Ascending sort key of a sampled row inside its draw."""
    return F.struct((-F.col(p)).alias("p"), F.col(slot).alias("slot"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)])


def precision_gain_draws(df: DataFrame, keys: Sequence[str], block: str, event: str, p0: str, p1: str, ties: Sequence[str], seed: int,
                         draws: int, fractions: Sequence[float] = (0.1,)) -> DataFrame:
    """Per draw and budget: precision of the added minus the base model, both re-ranked in the draw."""
    from hourgrain.operators.ranking import melt

    long = melt(R.numbered(df, keys, block), [*keys, event, *ties, "__i", "__nb"], {"base": p0, "added": p1}, "__side", "__p")
    cut = R.selection_hits(long, [*keys, "__side"], "__p", event, ties, fractions, draws, seed)
    signed = F.when(F.col("__side") == "added", F.col("hits")).otherwise(-F.col("hits")) / F.col("k")
    return cut.groupBy(*keys, "draw", "fraction").agg(F.sum(signed).alias("precision_gain"))


def selection_interval(df: DataFrame, keys: Sequence[str], block: str, event: str, p0: str, p1: str, ties: Sequence[str], seed: int,
                       draws: int = 1000, fraction: float = 0.1) -> DataFrame:
    """Intervals of the Brier gain and of the re-ranked top-budget precision gain."""
    g = precision_gain_draws(df, keys, block, event, p0, p1, ties, seed, draws, (fraction,))
    b = brier_gain_interval(df, keys, block, event, p0, p1, seed, draws)
    out = O.join_groups(b, interval(g, keys, ["precision_gain"]).drop("precision_gain_valid_draws"), keys)
    n = df.select(*keys, block).distinct().groupBy(*keys).agg(F.count("*").alias("n_blocks"))
    return O.join_groups(out, n, keys)


def sampled_rows(df: DataFrame, draw_keys: Sequence[str], taken: DataFrame, block: str) -> DataFrame:
    """Every row once per (draw, slot) that took its block."""
    return df.join(taken, [*draw_keys, block])


def budget_interval(df: DataFrame, keys: Sequence[str], block: str, event: str, value: str, p0: str, p1: str, ties: Sequence[str],
                    seed: int, draws: int = 1000, fractions: Sequence[float] = (0.05, 0.1, 0.2, 0.3)) -> DataFrame:
    """Precision and median-value gains at several budgets with their intervals.

    Hits and medians of all draws come from weights of rows, see ``redraw.selection_medians``; no row meets the draws.
    """
    keys, sides = list(keys), {"base": p0, "added": p1}
    names = {(side, i): f"{side}_{i}" for side in sides for i in range(len(fractions))}
    selections = {n: (sides[side], float(fractions[i])) for (side, i), n in names.items()}
    m = R.selection_medians(df, keys, [], block, event, value, selections, {n: (n, None) for n in selections}, ties, draws, seed)
    gain = lambda i, of: of(names["added", i]) - of(names["base", i])
    precision = lambda n: F.col(f"hits_{n}") / F.col(f"k_{n}")
    each = F.explode(F.array(*[
        F.struct(F.lit(float(f)).alias("fraction"), gain(i, precision).alias("precision_gain"), gain(i, lambda n: F.col(f"median_{n}")).alias("median_gain"))
        for i, f in enumerate(fractions)
    ]))
    gains = m.select(*keys, "draw", each.alias("s")).select(*keys, "draw", "s.*")
    out = interval(gains, [*keys, "fraction"], ["precision_gain", "median_gain"])
    return out.drop("precision_gain_valid_draws", "median_gain_valid_draws")


def median_difference_interval(df: DataFrame, keys: Sequence[str], block: str, group: str, value: str, seed: int, draws: int = 1000) -> DataFrame:
    """Interval of median(high) - median(low) over block resamples; draws without both are skipped.

    Medians of all draws come from counts per (value cell, block), see ``redraw``; no row meets the draws.
    """
    keys = list(keys)
    rows = R.numbered(df, keys, block).where(F.col(group).isin("high", "low"))
    m = R.medians(rows, [*keys, group], value, draws, seed)
    sides = {n: F.max(F.when(F.col(group) == n, F.col("median"))) for n in ("high", "low")}
    d = m.groupBy(*keys, "draw").agg((sides["high"] - sides["low"]).alias("difference"))
    out = O.join_groups(df.select(*keys).distinct(), interval(d, keys, ["difference"]), keys, "left")
    return out.withColumn("difference_valid_draws", F.coalesce("difference_valid_draws", F.lit(0).cast("bigint")))


def selection_contrast_interval(df: DataFrame, keys: Sequence[str], block: str, event: str, ratio: str, p0: str, p1: str, ties: Sequence[str],
                                within: Sequence[str], seed: int, draws: int = 1000, fraction: float = 0.1) -> DataFrame:
    """Intervals of the three selection contrasts, ranking inside ``within`` (e.g. year-month) in each draw; no row meets the draws."""
    keys = list(keys)
    selections = {"base": (p0, fraction), "added": (p1, fraction)}
    sets = {"base": ("base", None), "added": ("added", None), "base_only": ("base", "added"), "added_only": ("added", "base")}
    m = R.selection_medians(df, keys, within, block, event, ratio, selections, sets, ties, draws, seed)
    precision = lambda n: F.col(f"hits_{n}") / F.nullif(F.col(f"taken_{n}"), F.lit(0))
    v = m.select(
        *keys, (precision("added") - precision("base")).alias("precision_gain"), (F.col("median_added") - F.col("median_base")).alias("median_ratio_gain"),
        (F.col("median_added_only") - F.col("median_base_only")).alias("exclusive_median_gain"),
    )
    return interval(v, keys, ["precision_gain", "median_ratio_gain", "exclusive_median_gain"])

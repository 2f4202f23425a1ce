"""Selections at fixed budgets and comparisons of two models' selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hourgrain.operators import ordering as O


def melt(df: DataFrame, keep: Sequence[str], models: dict[str, str], name: str = "model", value: str = "p") -> DataFrame:
    """Long form: one row per row and model."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(c).alias("p")) for m, c in models.items()]))
    return df.select(*keep, pairs.alias("__s")).select(*keep, F.col("__s.m").alias(name), F.col("__s.p").alias(value))


def budget(fraction: float | Column) -> Column:
    """ceil(fraction * n) in DOUBLE arithmetic, over a group count column ``n``."""
    f = F.lit(float(fraction)) if not isinstance(fraction, Column) else fraction.cast("double")
    return F.ceil(f * F.col("n").cast("double"))


def order_by(p: str, ties: Sequence[str]) -> list[tuple[str, bool]]:
    """Highest score first, then the stored row order."""
    return [(p, True), *[(c, False) for c in ties]]


def select_top(df: DataFrame, keys: Sequence[str], p: str, ties: Sequence[str], fraction: float = 0.1, **kw) -> DataFrame:
    return O.top_rows(df, keys, order_by(p, ties), budget(fraction), **kw)


def budget_table(df: DataFrame, keys: Sequence[str], p: str, event: str, value: str, ties: Sequence[str],
                 fractions: Sequence[float] = (0.05, 0.1, 0.2, 0.3), **kw) -> DataFrame:
    """Selected rows, hits, precision, recall and median value per budget."""
    fs = list(fractions)
    marked = O.flag_top(df, keys, {"__sel": order_by(p, ties)}, {str(i): budget(f) for i, f in enumerate(fs)}, **kw)
    e = F.col(event).cast("bigint")
    # a row once for each budget that takes it
    sizes = F.explode(F.array_compact(F.array(*[F.when(F.col(f"__sel_{i}"), F.lit(i)) for i in range(len(fs))])))
    chosen = marked.select(*keys, sizes.alias("__i"), e.alias("__e"), F.col(value).alias("__v"))
    parts = O.quantiles(chosen, [*keys, "__i"], {"median_value": (F.col("__v"), 0.5)}, {"selected": F.count("*"), "hits": F.sum(F.coalesce("__e", F.lit(0)))}, **kw)
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("__i"), F.lit(float(f)).alias("fraction")) for i, f in enumerate(fs)]))
    frame = df.groupBy(*keys).agg(F.count("*").alias("n_test"), F.sum(e).alias("n_events")).select(*keys, "n_test", "n_events", every.alias("s")).select(*keys, "n_test", "n_events", "s.*")
    out = O.join_groups(frame, parts, [*keys, "__i"], "left").drop("__i").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("selected", "hits")})
    return out.withColumn("precision", F.col("hits") / F.nullif(F.col("selected"), F.lit(0))).withColumn(
        "recall", F.col("hits") / F.nullif(F.col("n_events"), F.lit(0))
    )


def flag_pair(df: DataFrame, keys: Sequence[str], p0: str, p1: str, ties: Sequence[str], fraction: float = 0.1, **kw) -> DataFrame:
    """Flags ``in_base`` and ``in_added`` of two models' selections on the same rows."""
    return O.flag_top(df, keys, {"in_base": order_by(p0, ties), "in_added": order_by(p1, ties)}, budget(fraction), **kw)


def overlap_label() -> Column:
    a, b = F.col("in_base"), F.col("in_added")
    return F.when(a & b, "both").when(a, "base_only").when(b, "added_only").otherwise("neither")


def overlap_table(flagged: DataFrame, keys: Sequence[str], event: str, values: Sequence[str], **kw) -> DataFrame:
    """Counts, events and quartiles of each part of the overlap; all four parts stay in the table."""
    rows = flagged.withColumn("selection", overlap_label())
    wanted = {}
    for v in values:
        wanted |= {f"{v}_q25": (F.col(v), 0.25), f"{v}_median": (F.col(v), 0.5), f"{v}_q75": (F.col(v), 0.75)}
    have = O.quantiles(
        rows, [*keys, "selection"], wanted, {"n": F.count("*"), "events": F.sum(F.col(event).cast("bigint"))}, **kw
    )
    parts = F.explode(F.array(*[F.lit(x) for x in ("both", "base_only", "added_only", "neither")]))
    frame = have.select(*keys).distinct().withColumn("selection", parts)
    out = O.join_groups(frame, have, [*keys, "selection"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("events", F.coalesce("events", F.lit(0)))


def contrast_table(flagged: DataFrame, keys: Sequence[str], event: str, ratio: str, copies: str | None = None, **kw) -> DataFrame:
    """Added minus base: precision, median ratio, and median ratio of the exclusive parts."""
    a, b, r = F.col("in_base"), F.col("in_added"), F.col(ratio)
    times = F.lit(1) if copies is None else F.col(copies)
    e = F.col(event).cast("double") * times
    out = O.quantiles(
        flagged, keys,
        {
            "__ra": (F.when(a, r), 0.5), "__rb": (F.when(b, r), 0.5),
            "__xa": (F.when(a & ~b, r), 0.5), "__xb": (F.when(b & ~a, r), 0.5),
        },
        {"__pa": F.sum(F.when(a, e)) / F.sum(F.when(a, times)), "__pb": F.sum(F.when(b, e)) / F.sum(F.when(b, times))},
        copies=copies, **kw,
    )
    return out.select(
        *keys,
        (F.col("__pb") - F.col("__pa")).alias("precision_gain"),
        (F.col("__rb") - F.col("__ra")).alias("median_ratio_gain"),
        (F.col("__xb") - F.col("__xa")).alias("exclusive_median_gain"),
    )

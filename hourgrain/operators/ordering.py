"""Exact order statistics per group that never put a whole group into one task.

Quantiles and selections rest on ``at_ranks``: rows are counted in cells that ascend with the sort key, the cell that holds a wanted
rank is found from the counts, and only its rows are looked at again, in finer cells, until a cell is small enough to sort. Counts
combine before they are shuffled, all ranks of all groups are sought at once, and rows are never moved, except those of the cells
that hold a rank. Running totals rest on ``cumulative``: rows are dealt into ranges of (group, order), each range keeps its own
running sums, and a table with one row per group and range says what came before. Either plan is the same at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hourgrain.session import cut_lineage, few


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """NULL-safe equality on the group keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join with NULL-safe keys, keeping the left copy of the keys."""
    r = right.select([F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], F.lit(True))
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def cumulative(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``rows`` plus ``cum_<name>``: the sum up to and including each row of its group in ascending ``order``.

    ``order`` must be unique within a group, or its ties are broken at random. The input is stored first, since dealing by
    ranges samples it; the dealt rows are stored too, since the number of a range is only good for one run.
    """
    keys = list(keys)
    dealt = cut_lineage(rows).repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    dealt = cut_lineage(dealt.withColumn("__range", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "__range").agg(*[F.sum(s).alias(f"__s_{s}") for s in sums])
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(*keys, "__range", *[F.coalesce(F.sum(f"__s_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums])
    inside = W.partitionBy("__range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = dealt.select("*", *[F.sum(s).over(inside).alias(f"__i_{s}") for s in sums])
    out = join_groups(out, starts, [*keys, "__range"])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"__i_{s}") + F.col(f"__o_{s}"))
    return out.drop("__range", *[f"__i_{s}" for s in sums], *[f"__o_{s}" for s in sums])


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[Column, float]],
    extra: dict[str, Column] | None = None,
    bounded: bool = False,
    copies: str | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group: ``{output: (value, q)}``; NULL values are ignored.

    ``extra`` holds plain aggregates computed in the same grouping. ``bounded=True`` states that a group's size is limited by a
    parameter (for example the number of resampling draws); such groups are held by one aggregate. ``copies`` names a
    bigint column that says how often each row counts. Rows are copied once per distinct value, not once per output.
    """
    keys, extra = list(keys), extra or {}
    if bounded:
        times = F.lit(1) if copies is None else F.col(copies)
        aggs = [F.percentile(v.cast("double"), F.lit(q), times).alias(n) for n, (v, q) in wanted.items()]
        aggs += [a.alias(n) for n, a in extra.items()]
        return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    numbers: dict[str, int] = {}
    columns: list[Column] = []
    for v, _ in wanted.values():
        if str(v) not in numbers:
            numbers[str(v)] = len(columns)
            columns.append(v)
    melted = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), v.cast("double").alias("v")) for i, v in enumerate(columns)]))
    plain = [F.count("*").alias("__rows"), *[a.alias(n) for n, a in extra.items()]]
    base = df.groupBy(*keys).agg(*plain) if keys else df.agg(*plain)
    values = (
        df.select(*keys, (F.lit(1) if copies is None else F.col(copies)).cast("bigint").alias("__w"), melted.alias("s"))
        .where(F.col("s.v").isNotNull() & (F.col("__w") > 0)).select(*keys, F.col("s.m").alias("__m"), F.col("s.v").alias("v"), "__w")
    )
    places = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(numbers[str(v)]).alias("m"), side.alias("side"), where(F.lit(float(q)) * (F.col("__all") - 1)).cast("bigint").alias("k"))
        for name, (v, q) in wanted.items() for side, where in ((F.lit("low"), F.floor), (F.lit("high"), F.ceil))
    ])

    def targets(totals: DataFrame) -> DataFrame:
        each = totals.select(*keys, "__m", "__all", F.explode(places).alias("t")).where("t.m = __m")
        return each.select(*keys, "__m", F.struct("t.name", "t.side", "__all").alias("__t"), (F.col("t.k") + 1).alias("__k"))

    found = at_ranks(values, [*keys, "__m"], ["v"], targets)
    aggs = []
    for name, (_, q) in wanted.items():
        at = F.lit(float(q)) * (F.col("__t.__all") - 1)
        low, high = F.floor(at), F.ceil(at)
        share = F.when(low == high, F.when(F.col("__t.side") == "low", F.col("v"))).when(F.col("__t.side") == "low", F.col("v") * (high - at)).otherwise(F.col("v") * (at - low))
        aggs.append(F.sum(F.when(F.col("__t.name") == name, share)).alias(name))
    wide = found.groupBy(*keys).agg(*aggs) if keys else found.agg(*aggs)
    return join_groups(base, wide, keys, "left").select(*keys, *wanted, *extra)


#: Cells of a unit of the logarithmic scale, or of the range that is being narrowed.
CELLS = 1024
#: Rows of a cell that are sorted by one task.
SORTED = 50_000


def _number(df: DataFrame, column: str) -> Column:
    """A finite DOUBLE that never descends where the column ascends; strings by their first six bytes."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind.startswith(("string", "char", "varchar")):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        c = F.unix_micros(c.cast("timestamp"))
    return F.least(F.greatest(c.cast("double"), F.lit(-4e307)), F.lit(4e307))


def at_ranks(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], targets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(keys, __t, fields): in each group, the fields of the row that holds the wanted rank in ascending order of ``fields``.

    ``rows`` are (keys, fields, __w), where a row counts ``__w`` times; ``targets`` makes (keys, __t, __k), ranks from one, from the
    totals (keys, __all). Fields are not NULL; the first of two equal rows is any of them.
    """
    keys, fields = list(keys), list(fields)
    spots, size, first = None, None, _number(rows, fields[0])
    cell = F.floor(F.signum(first) * F.log1p(F.abs(first)) * CELLS)
    left, by = rows.withColumn("__path", F.lit("")), [*keys, "__path"]
    while True:
        lows, highs = [f"__lo_{f}" for f in fields], [f"__hi_{f}" for f in fields]
        ends = [x for f in fields for x in (F.min(f).alias(f"__lo_{f}"), F.max(f).alias(f"__hi_{f}"))]
        cells = cut_lineage(left.withColumn("__cell", cell).groupBy(*by, "__cell").agg(F.sum("__w").alias("__n"), F.count("*").alias("__rows"), *ends))
        if spots is None:
            totals = cells.groupBy(*keys).agg(F.sum("__n").alias("__all")) if keys else cells.agg(F.sum("__n").alias("__all"))
            spots = targets(totals).withColumn("__path", F.lit(""))
        upto = W.partitionBy(*by).orderBy("__cell").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = join_groups(spots, cells.withColumn("__cum", F.sum("__n").over(upto)), by)
        placed = placed.where((F.col("__k") <= F.col("__cum")) & (F.col("__k") > F.col("__cum") - F.col("__n")))
        deeper = F.concat_ws("/", "__path", F.col("__cell").cast("string"))
        found = cut_lineage(placed.select(*keys, "__t", (F.col("__k") - F.col("__cum") + F.col("__n")).alias("__k"), deeper.alias("__path"), "__rows", *lows, *highs))
        largest, count = found.agg(F.coalesce(F.max("__rows"), F.lit(0)), F.count("*")).first()
        wanted = few(found.select(*by, *lows, *highs).dropDuplicates(by), count)
        tagged = left.withColumn("__path", F.concat_ws("/", "__path", cell.cast("string")))
        left = join_groups(tagged, wanted, by)
        if largest <= SORTED or size is not None and largest >= size:
            break
        left, size = cut_lineage(left), largest
        spots = found.select(*keys, "__t", "__k", "__path")
        left = left.select(*by, *fields, "__w", *[F.col(c).alias(f"{c}_") for c in (*lows, *highs)])
        renamed = {c: f"{c}_" for c in (*lows, *highs)}
        cell = F.lit(0).cast("bigint")
        for f in reversed(fields):  # the first field that still differs
            low, high = (_number(left, renamed[f"{end}_{f}"]) for end in ("__lo", "__hi"))
            share = F.coalesce(F.try_divide(_number(left, f) - low, high - low), F.lit(0.0))
            cell = F.when(F.col(renamed[f"__lo_{f}"]) == F.col(renamed[f"__hi_{f}"]), cell).otherwise(F.floor(share * CELLS))
    left = left.select(*by, *fields, "__w")
    if largest <= SORTED:
        ranked = left.withColumn("cum___w", F.sum("__w").over(W.partitionBy(*by).orderBy(*fields).rowsBetween(W.unboundedPreceding, W.currentRow)))
    else:  # fields that no number tells apart
        ranked = cumulative(left, by, fields, ["__w"])
    hit = join_groups(ranked, few(found.select(*by, "__t", "__k"), count), by).where((F.col("__k") <= F.col("cum___w")) & (F.col("__k") > F.col("cum___w") - F.col("__w")))
    return hit.select(*keys, "__t", *fields)


def _sort_key(order: Sequence[tuple[str, bool]]) -> Column:
    """Struct that ascends in the wanted order, of the columns' own types; structs compare field by field."""
    return F.struct(*[(-F.col(c) if d else F.col(c)).alias(f"k{i}") for i, (c, d) in enumerate(order)])


def _ranked(df: DataFrame, order: Sequence[tuple[str, bool]]) -> Column:
    """Whether a row takes part: the leading column is neither NULL nor NaN."""
    first = order[0][0]
    return F.col(first).isNotNull() & ~F.isnan(first) if dict(df.dtypes)[first] in ("double", "float") else F.col(first).isNotNull()


def kth_keys(df: DataFrame, keys: Sequence[str], orders: dict[str, Sequence[tuple[str, bool]]], sizes: dict[str, Column]) -> DataFrame:
    """Sort key of the last row that each named top selection takes from each group, as ``<order>_<size>``, from one ranking.

    An order is [(column, descending)], descending ones numeric, and must end in a unique key, as a stable sort of the rows in
    their stored order does; all orders have columns of the same types. ``sizes`` are expressions over the group's row count
    ``n``. Rows whose leading column is NULL or NaN count in ``n`` but are never taken.
    """
    keys, names = list(keys), list(orders)
    fields = [f"k{i}" for i in range(len(orders[names[0]]))]
    able = [F.count_if(_ranked(df, orders[o])).alias(f"__able_{i}") for i, o in enumerate(names)]
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), *able) if keys else df.agg(F.count("*").alias("n"), *able)
    each = F.explode(F.array(*[
        F.struct(F.lit(i).alias("__o"), F.lit(f"{o}_{size}").alias("__t"), F.least(c, F.col(f"__able_{i}")).cast("bigint").alias("__k"))
        for i, o in enumerate(names) for size, c in sizes.items()
    ]))
    wanted = cut_lineage(counts.select(*keys, each.alias("s")).select(*keys, "s.*"))
    melted = F.explode(F.array(*[F.struct(F.lit(i).alias("__o"), _ranked(df, orders[o]).alias("__able"), _sort_key(orders[o]).alias("__key")) for i, o in enumerate(names)]))
    rows = df.select(*keys, melted.alias("s")).where("s.__able").select(*keys, "s.__o", "s.__key.*", F.lit(1).cast("bigint").alias("__w"))
    hit = at_ranks(rows, [*keys, "__o"], fields, lambda totals: wanted)
    aggs = [F.max(F.when(F.col("__t") == f"{o}_{size}", F.struct(*fields))).alias(f"{o}_{size}") for o in names for size in sizes]
    return hit.groupBy(*keys).agg(*aggs) if keys else hit.agg(*aggs)


def flag_top(df: DataFrame, keys: Sequence[str], orders: dict[str, Sequence[tuple[str, bool]]], sizes: Column | dict[str, Column], bounded: bool = False) -> DataFrame:
    """Add one boolean per named order (and size): is the row among the group's first rows?

    Rows are compared with the group's k-th sort key, so no ranks are attached to rows. With several
    sizes the columns are called ``<order>_<size>``. The keys of all orders and sizes are found together. ``bounded=True`` states
    that a group's size is limited by the calendar or a parameter; such groups are ranked by a window.
    """
    named = sizes if isinstance(sizes, dict) else {"": sizes}
    if bounded:
        out = df.withColumn("n", F.count("*").over(W.partitionBy(*keys))) if "n" not in df.columns else df.withColumn("__n", F.col("n")).withColumn("n", F.count("*").over(W.partitionBy(*keys)))
        for o, order in orders.items():
            able = _ranked(df, order)
            rank = F.row_number().over(W.partitionBy(*keys, able).orderBy(_sort_key(order)))
            out = out.withColumn("__rank", F.when(able, rank))
            for n, size in named.items():
                out = out.withColumn(f"{o}_{n}" if n else o, F.coalesce(F.col("__rank") <= size, F.lit(False)))
        out = out.drop("__rank", "n")
        return out.withColumnRenamed("__n", "n") if "n" in df.columns else out
    kth = kth_keys(df, keys, {f"__kth_{o}": order for o, order in orders.items()}, named)
    out = join_groups(df, few(kth), keys, "left") if keys else df.crossJoin(F.broadcast(cut_lineage(kth)))  # without keys, one row
    for o, order in orders.items():
        for n in named:
            out = out.withColumn(f"{o}_{n}" if n else o, _taken(df, order, F.col(f"__kth_{o}_{n}"))).drop(f"__kth_{o}_{n}")
    return out


def _taken(df: DataFrame, order: Sequence[tuple[str, bool]], kth: Column) -> Column:
    """Whether a row comes no later than ``kth``; most rows are told by the leading column alone."""
    (column, descending), last = order[0], kth["k0"]
    lead = -F.col(column) if descending else F.col(column)
    return F.coalesce(_ranked(df, order) & ((lead < last) | ((lead == last) & (_sort_key(order) <= kth))), F.lit(False))


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], size: Column, bounded: bool = False) -> DataFrame:
    """The first ``size`` rows of each group under ``order``."""
    return flag_top(df, keys, {"__top": order}, size, bounded).where("__top").drop("__top")


def running_totals(cells: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], descending: bool = True, bounded: bool = False) -> DataFrame:
    """Cumulative ``sums`` up to and including each row, as ``cum_<name>``; ``value`` is unique within a group."""
    if bounded:
        along = W.partitionBy(*keys).orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(W.unboundedPreceding, W.currentRow)
        return cells.select("*", *[F.sum(x).over(along).alias(f"cum_{x}") for x in sums])
    signed = cells.withColumn("__o", F.col(value) * F.lit(-1.0 if descending else 1.0))
    return cumulative(signed, keys, ["__o"], sums).drop("__o")


def previous_in_order(df: DataFrame, keys: Sequence[str], order: str, column: str, width: int, out: str) -> DataFrame:
    """``lag(column)`` over a whole group, computed in slices of ``width`` units of a bigint order.

    Inside a slice a window does it; the first row of a slice takes the last value of the nearest
    earlier slice, from a table with one row per slice.
    """
    keys = list(keys)
    cut = df.withColumn("__s", F.floor(F.col(order) / width))
    last = cut.groupBy(*keys, "__s").agg(F.max_by(F.struct(column), order).alias("__last"))
    slices = W.partitionBy(*keys).orderBy("__s")
    last = last.select(*keys, "__s", F.lag("__last").over(slices)[column].alias("__carry"))
    inside = W.partitionBy(*keys, "__s").orderBy(order)
    cut = cut.withColumn("__first", F.row_number().over(inside) == 1).withColumn("__lag", F.lag(column).over(inside))
    joined = join_groups(cut, last, [*keys, "__s"])
    return joined.withColumn(out, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__lag"))).drop(
        "__s", "__first", "__lag", "__carry"
    )

"""Order statistics of every block-bootstrap draw at once, from counted histograms and without a row per draw.

A draw takes calendar blocks with repetition, so a row's weight in it is how often its block was taken. How often, for all draws, is
one small array that depends on the number of blocks alone and is shared by all groups with that number. Rows are counted in cells
(value cell, block), which ascend with the value; counts times the array give every draw's running totals, hence the cell in which each
draw's rank lies. Only rows of such cells are looked at again, in finer cells, until a cell holds few rows; then its values
themselves are the cells. What a task holds is bounded by cells, blocks and draws. Draws are those of ``resampling.pick``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from hourgrain.functions import scalars as S
from hourgrain.operators import ordering as O
from hourgrain.session import cut_lineage, few

#: Cells of a unit of the logarithmic scale; cells of a range that is narrowed; rows up to which values are cells of their own.
UNIT_CELLS, CELLS, ALONE = 128, 1024, 4096
#: Draws whose running totals are held at a time.
AT_ONCE = 128


@lru_cache(maxsize=16)
def picks(seed: int, draws: int, blocks: int) -> np.ndarray:
    """(draws, blocks): the number of the block in each slot."""
    heads = [hashlib.md5(f"{seed}|{d}|{s}".encode()).hexdigest()[:8] for d in range(draws) for s in range(blocks)]
    return (np.array([int(x, 16) for x in heads], dtype=np.int64) % blocks).reshape(draws, blocks)


@lru_cache(maxsize=16)
def times(seed: int, draws: int, blocks: int) -> np.ndarray:
    """(blocks, draws): how often each draw took each block."""
    flat = picks(seed, draws, blocks) + np.arange(draws)[:, None] * blocks
    return np.bincount(flat.ravel(), minlength=draws * blocks).reshape(draws, blocks).T.astype(np.float64)


def numbered(rows: DataFrame, keys: Sequence[str], block: str) -> DataFrame:
    """Adds ``__i``, the number of the row's block among its group's in order, and ``__nb``, how many there are."""
    distinct, group = rows.select(*keys, block).distinct(), W.partitionBy(*keys)
    index = distinct.withColumn("__i", F.row_number().over(group.orderBy(block)) - 1).withColumn("__nb", F.count("*").over(group).cast("int"))
    return O.join_groups(rows, few(index), [*keys, block])


def _spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By the keys over all shuffle partitions: groups are small in bytes but not in work, so they must not be coalesced by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _counted(left: DataFrame, by: Sequence[str], cell: Column) -> DataFrame:
    return left.withColumn("__cell", cell).groupBy(*by, "__path", "__cell", "__i", "__nb").agg(
        F.count("*").alias("__n"), F.sum("__h").alias("__h"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")
    )


def _located(cells: pd.DataFrame, wanted: pd.DataFrame, seed: int, draws: int) -> pd.DataFrame:
    """``wanted`` (draw, tag, total, k, rest, hits) with the cell of each rank: rest and hits within it, its ends, its rows, and the
    slot, block and rank in the block that hold the rank if the cell is one value."""
    names, code = np.unique(cells["__cell"].to_numpy(), return_inverse=True)
    blocks = int(cells["__nb"].iloc[0])
    used, column = np.unique(cells["__i"].to_numpy(), return_inverse=True)  # few of the blocks, if groups are months or opened cells
    m, drawn, place = times(seed, draws, blocks)[used], picks(seed, draws, blocks), np.full(blocks, len(used))
    place[used] = np.arange(len(used))
    n, h = np.zeros((len(names), len(used) + 1)), np.zeros((len(names), len(used) + 1))  # the last column stands for the other blocks
    n[code, column], h[code, column] = cells["__n"], cells["__h"]
    low, high = np.full(len(names), np.inf), np.full(len(names), -np.inf)
    np.minimum.at(low, code, cells["__lo"].to_numpy())
    np.maximum.at(high, code, cells["__hi"].to_numpy())
    parts = []
    for start in range(0, draws, AT_ONCE):
        part = wanted[(wanted["draw"] >= start) & (wanted["draw"] < start + AT_ONCE)].copy()
        if part.empty:
            continue
        who, d = np.unique(part["draw"].to_numpy(), return_inverse=True)
        cum, hits = np.cumsum(n[:, :-1] @ m[:, who], axis=0), np.cumsum(h[:, :-1] @ m[:, who], axis=0)
        k = part["rest"].to_numpy()
        at = np.array([np.searchsorted(cum[:, i], x) for i, x in zip(d, k)])
        before = np.where(at > 0, cum[at - 1, d], 0)
        rest, so_far = k - before, part["hits"].to_numpy() + np.where(at > 0, hits[at - 1, d], 0)
        taken = drawn[who[d]]
        slots = place[taken]
        upto = np.cumsum(n[at[:, None], slots], axis=1)
        slot = (upto < rest[:, None]).sum(axis=1)
        row = np.arange(len(part))
        slot = np.minimum(slot, blocks - 1)
        last = taken[row, slot]
        own = slots[row, slot]
        inside = np.cumsum(h[at[:, None], slots], axis=1)[row, slot] - h[at, own]
        parts.append(part.assign(
            rest=rest.astype(np.int64), hits=so_far.astype(np.int64), cell=names[at], lo=low[at], hi=high[at], rows=n[at].sum(axis=1).astype(np.int64),
            slot=slot, i=last, rank=(rest - upto[row, slot] + n[at, own]).astype(np.int64), inside=inside.astype(np.int64),
        ))
    return pd.concat(parts) if parts else wanted.assign(cell=0.0, lo=0.0, hi=0.0, rows=0, slot=0, i=0, rank=0, inside=0)


FOUND = "draw int, tag string, total bigint, k bigint, rest bigint, hits bigint, cell double, lo double, hi double, rows bigint, slot bigint, i int, rank bigint, inside bigint"


def draw_ranks(rows: DataFrame, by: Sequence[str], places: Callable[[np.ndarray], dict[str, np.ndarray]], draws: int, seed: int) -> DataFrame:
    """(by, draw, tag, total, k, x, slot, i, rank, hits): in each draw, the value ``x`` at the wanted ranks.

    ``rows`` are (by, __x, __h, __i, __nb) with ``__x`` not NULL; ``places`` makes ranks from one, by tag, from the draws' totals of
    rows. Rows of one value are ordered by the slot of their block: ``slot`` and block ``i`` hold the rank, as the ``rank``-th row of
    the block with that value; ``hits`` sums ``__h`` over all earlier rows but those of that block in that slot.
    A draw that takes no row of a group has no row there.
    """
    by = list(by)
    schema = T.StructType([rows.schema[c] for c in by] + [T.StructField("__path", T.StringType())] + T.StructType.fromDDL(FOUND).fields)
    keyed = [*by, "__path"]
    finite = lambda c: F.least(F.greatest(c, F.lit(-4e307)), F.lit(4e307))

    def first(cells: pd.DataFrame) -> pd.DataFrame:
        blocks = int(cells["__nb"].iloc[0])
        each = np.bincount(cells["__i"], weights=cells["__n"], minlength=blocks)
        total = (each @ times(seed, draws, blocks)).astype(np.int64)
        some = np.flatnonzero(total)
        wanted = [pd.DataFrame({"draw": some, "tag": tag, "total": total[some], "k": k[some].astype(np.int64)}) for tag, k in places(total).items()]
        wanted = pd.concat(wanted).assign(hits=0)
        return finished(cells, wanted.assign(rest=wanted["k"]))

    def finished(cells: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = _located(cells, wanted, seed, draws)
        for c in keyed:
            out[c] = [cells[c].iloc[0]] * len(out)
        return out[schema.names]

    def again(cells: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        return finished(cells, wanted[["draw", "tag", "total", "k", "rest", "hits"]])

    x = finite(F.col("__x"))
    cell = F.floor(F.signum(x) * F.log1p(F.abs(x)) * UNIT_CELLS).cast("double")
    left = rows.select(*by, "__x", "__h", "__i", "__nb").withColumn("__path", F.lit(""))
    found = cut_lineage(_spread(_counted(left, by, cell), keyed).groupBy(*keyed).applyInPandas(first, schema))
    exact, before = False, None
    while not exact:
        path = F.concat_ws("/", "__path", F.col("cell").cast("string"))
        wide, spots = found.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("rows")))).first()[0] or 0, found.withColumn("__path", path)
        opened = few(spots.select(*keyed, "lo", "hi").dropDuplicates(keyed))
        tagged = left.withColumn("__path", F.concat_ws("/", "__path", cell.cast("string")))
        left = O.join_groups(tagged.drop("lo", "hi"), opened, keyed)
        exact, before = wide <= ALONE or wide == before, wide  # or values that their differences do not tell apart
        if not exact:
            left = cut_lineage(left)
        share = F.coalesce(F.try_divide(finite(F.col("__x")) - finite(F.col("lo")), finite(F.col("hi")) - finite(F.col("lo"))), F.lit(0.0))
        cell = F.col("__x") if exact else F.floor(share * CELLS).cast("double")
        cells = _counted(left, by, cell)
        found = cut_lineage(_spread(cells, keyed).groupBy(*keyed).cogroup(_spread(spots, keyed).groupBy(*keyed)).applyInPandas(again, schema))
    return found.select(*by, "draw", "tag", "total", "k", F.col("cell").alias("x"), "slot", "i", "rank", (F.col("hits") + F.col("inside")).alias("hits"))


def selection_hits(rows: DataFrame, by: Sequence[str], p: str, event: str, ties: Sequence[str], fractions: Sequence[float], draws: int, seed: int) -> DataFrame:
    """(by, draw, fraction, k, hits): the events among the top ``fraction`` of each draw, re-ranked in it by (p descending, slot, ties).

    ``rows`` come from ``numbered``. NULL and NaN ``p`` count in the budget's base and rank last, but are no hits.
    """
    by, able = list(by), F.col(p).isNotNull() & ~F.isnan(p)
    rows = rows.select(*by, *ties, "__i", "__nb", F.when(able, -F.col(p).cast("double") + F.lit(0.0)).otherwise(F.lit(float("inf"))).alias("__x"), F.when(able, F.col(event).cast("bigint")).otherwise(F.lit(0)).alias("__h"))
    budgets = [float(f) for f in fractions]
    ranks = draw_ranks(rows, by, lambda total: {str(f): np.maximum(np.ceil(f * total), 1) for f in budgets}, draws, seed)
    same = [*by, "__i", "__x"]
    ranks = ranks.withColumnRenamed("i", "__i").withColumnRenamed("x", "__x")
    tied = O.join_groups(rows, few(ranks.select(*same).distinct()), same)
    order = W.partitionBy(*same).orderBy(*ties)
    tied = tied.select(*same, F.row_number().over(order).cast("bigint").alias("rank"), F.sum("__h").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("__upto"))
    out = O.join_groups(ranks, tied, [*same, "rank"])
    return out.select(*by, "draw", F.col("tag").cast("double").alias("fraction"), "k", (F.col("hits") + F.col("__upto")).alias("hits"))


def medians(rows: DataFrame, by: Sequence[str], value: str, draws: int, seed: int) -> DataFrame:
    """(by, draw, median) of ``value`` in each draw; NULL and NaN values are left out. ``rows`` come from ``numbered``."""
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("__x"), F.lit(0).cast("bigint").alias("__h"), "__i", "__nb")
    ends = draw_ranks(rows, by, lambda total: {"low": (total - 1) // 2 + 1, "high": total // 2 + 1}, draws, seed)
    return ends.groupBy(*by, "draw").agg(F.avg("x").alias("median"))


#: Rows of a part; partial sums that are added by one task; cells of a unit of the logarithmic scale, and of a narrowed range, whose weights
#: are held for all draws; rows up to which values are cells of their own.
PART_ROWS, FAN, VALUE_CELLS, SPLIT, SORTED = 100_000, 32, 16, 64, 512
#: Rows whose weights in all draws are held at a time.
WEIGHED_AT_ONCE = 1024

PARTIAL = "set int, spot double, cell double, lo double, hi double, rows bigint, w binary"
SPOT = "set int, draw int, tag string, rest bigint, lo double, hi double, rows bigint"


def _with_tie_rank(rows: DataFrame, same: Sequence[str], marks: DataFrame, ties: Sequence[str], out: str) -> DataFrame:
    """``out``: the row's place in ``ties`` among the rows that agree in ``same``, for those in ``marks``; the others have 0."""
    flagged = O.join_groups(rows, few(marks.select(*same).distinct()).withColumn("__mark", F.lit(True)), same, "left")
    tied = flagged.where("__mark").withColumn(out, F.row_number().over(W.partitionBy(*same).orderBy(*ties)).cast("bigint"))
    return tied.unionByName(flagged.where("__mark IS NULL").withColumn(out, F.lit(0).cast("bigint"))).drop("__mark")


class _Weights:
    """How often each draw selects a row: of the slots that took its block, always the first ones."""

    def __init__(self, cut: pd.Series, sel: int, blocks: int, seed: int, draws: int):
        mine = cut["c_sel"] == sel
        draw = cut["c_draw"][mine]
        self.x, self.slot, self.i, self.rank = np.full(draws, -np.inf), np.zeros(draws, int), np.full(draws, -1), np.zeros(draws, int)
        for name in ("x", "slot", "i", "rank"):
            getattr(self, name)[draw] = cut[f"c_{name}"][mine]
        self.all = times(seed, draws, blocks)
        self.low, self.high = (self.x[self.x > -np.inf].min(), self.x.max()) if len(draw) else (-np.inf, -np.inf)
        drawn = picks(seed, draws, blocks)
        self.before = np.zeros((blocks, draws))
        d, s = np.nonzero(np.arange(blocks)[None, :] < self.slot[:, None])
        np.add.at(self.before, (drawn[d, s], d), 1)

    def of(self, x: np.ndarray, i: np.ndarray, rank: np.ndarray) -> np.ndarray:
        tied = self.before[i] + ((self.i[None, :] == i[:, None]) & (rank[:, None] <= self.rank[None, :]))
        w = np.where(x[:, None] < self.x[None, :], self.all[i], np.where(x[:, None] == self.x[None, :], tied, 0))
        w[~np.isfinite(x)] = 0
        return w


def _value_cell(v: np.ndarray) -> np.ndarray:
    return np.floor(np.sign(v) * np.log1p(np.abs(v)) * VALUE_CELLS)


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of equal (set, spot, cell) added up."""
    out = []
    for (name, spot, cell), g in parts.groupby(["set", "spot", "cell"], sort=False):
        w = np.sum([np.frombuffer(b, dtype=np.int64) for b in g["w"]], axis=0)
        out.append((name, spot, cell, g["lo"].min(), g["hi"].max(), g["rows"].sum(), w.tobytes()))
    return pd.DataFrame(out, columns=["set", "spot", "cell", "lo", "hi", "rows", "w"])


def selection_medians(
    df: DataFrame, keys: Sequence[str], within: Sequence[str], block: str, event: str, value: str, selections: dict[str, tuple[str, float]],
    sets: dict[str, tuple[str, str | None]], ties: Sequence[str], draws: int, seed: int,
) -> DataFrame:
    """(keys, draw, k_<selection>, taken_<selection>, hits_<selection>, median_<set>) of selections that are ranked again in each draw.

    A selection is (score, fraction): the top rows of each group of (keys, within) by (score descending, slot, ties). A set is
    (selection, other): its rows that the other, if named, does not select; its median of ``value`` is over all groups of the keys, NULL and
    NaN left out. Rows whose score is NULL or NaN count in the budget but are never taken. A row's weight in all draws follows from
    its score, block and place among ties; tasks add the weights of a part's rows in cells of the value, and the cells that hold a median
    are narrowed. Neither rows nor values meet the draws as rows; partial sums are bounded by cells and draws, and added as a tree.
    """
    keys, by, names = list(keys), [*keys, *within], list(selections)
    scores = list(dict.fromkeys(p for p, _ in selections.values()))
    able = lambda p: F.col(p).isNotNull() & ~F.isnan(p)
    number = lambda p: F.when(able(p), -F.col(p).cast("double") + F.lit(0.0)).otherwise(F.lit(float("inf")))
    # Blocks are numbered among those of the keys, as the draws are; a draw that takes no row of a group has no budget there.
    rows = numbered(df, keys, block).select(
        *by, *ties, "__i", "__nb", F.col(event).cast("bigint").alias("__e"), S.finite(F.col(value).cast("double")).alias("__v"),
        *[number(p).alias(f"__x{n}") for n, p in enumerate(scores)],
    )
    rows = cut_lineage(rows)
    cuts, worst = None, None
    for n, p in enumerate(scores):
        mine = [(s, f) for s, (q, f) in selections.items() if q == p]
        place = rows.select(*by, "__i", "__nb", F.col(f"__x{n}").alias("__x"), F.lit(0).cast("bigint").alias("__h"))
        found = draw_ranks(place, by, lambda total, mine=mine: {str(names.index(s)): np.maximum(np.ceil(f * total), 1) for s, f in mine}, draws, seed)
        found = found.select(*by, F.col("tag").cast("int").alias("sel"), "draw", "k", "x", "slot", "i", "rank")
        most = found.groupBy(*by).agg(F.max("x").alias(f"__most{n}"))
        worst = most if worst is None else O.join_groups(worst, most, by)
        marks = found.select(*by, F.col("i").alias("__i"), F.col("x").alias(f"__x{n}"))
        rows = _with_tie_rank(rows, [*by, "__i", f"__x{n}"], marks, ties, f"__rank{n}")
        cuts = found if cuts is None else cuts.unionByName(found)
    able_rows = O.join_groups(rows, few(worst), by)
    able_rows = able_rows.where(" OR ".join(f"(__x{n} <= __most{n} AND __x{n} < double('infinity'))" for n in range(len(scores))))
    fields = ["__i", "__nb", "__e", "__v", *[c for n in range(len(scores)) for c in (f"__x{n}", f"__rank{n}")]]
    counts = cut_lineage(able_rows.groupBy(*by).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("__parts")))
    able_rows = O.join_groups(able_rows, few(counts), by)
    able_rows = able_rows.select(*by, F.pmod(F.xxhash64(*ties), "__parts").cast("int").alias("__part"), *fields)
    able_rows = cut_lineage(able_rows)
    units = counts.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    units = units.withColumn("__unit", F.row_number().over(W.partitionBy(*keys).orderBy(*within, "__part")) - 1)
    each = ["sel", "draw", "x", "slot", "i", "rank"]
    packed = cuts.groupBy(*by).agg(F.collect_list(F.struct(*each)).alias("c")).select(*by, *[F.col(f"c.{c}").alias(f"c_{c}") for c in each])
    packed = cut_lineage(O.join_groups(units, packed, by))
    most_units = (packed.agg(F.max("__unit")).first()[0] or 0) + 1
    kept = [able_rows.schema[k] for k in keys]
    partial = T.StructType([*kept, T.StructField("__unit", T.IntegerType()), *T.StructType.fromDDL(PARTIAL).fields])
    spot_schema = T.StructType([*kept, *T.StructType.fromDDL(SPOT).fields])
    pairs = [(names.index(a), None if b is None else names.index(b)) for a, b in sets.values()]
    score_of = [scores.index(p) for p, _ in selections.values()]

    def stamped(out: pd.DataFrame, source: pd.DataFrame, columns: Sequence[str]) -> pd.DataFrame:
        if out.empty:
            return pd.DataFrame(columns=list(columns), dtype=object)
        for k in keys:
            out[k] = [source[k].iloc[0]] * len(out)
        return out[list(columns)]

    def settled(out: list, mine: pd.DataFrame, weights: list) -> tuple[pd.DataFrame, dict]:
        """Adds the rows that every draw of their block selects, counted by block before they meet the draws. Returns the rows that only
        some draws select, with the masks of those that a selection or a set still has to weigh."""
        i, v, e = mine["__i"].to_numpy(), mine["__v"].to_numpy(dtype=float), mine["__e"].fillna(0).to_numpy(dtype=float)
        every, x = weights[0].all, [mine[f"__x{n}"].to_numpy() for n in score_of]
        sure = [x[s] < w.low for s, w in enumerate(weights)]
        never = [(x[s] > w.high) | ~np.isfinite(x[s]) for s, w in enumerate(weights)]
        some = [~(a | b) for a, b in zip(sure, never)]
        for s in range(len(names)):
            for cell, of in ((0.0, None), (1.0, e[sure[s]])):
                total = np.bincount(i[sure[s]], of, len(every)) @ every
                out.append((-1 - s, 0.0, cell, 0.0, 0.0, 0, total.astype(np.int64).tobytes()))
        used, masks = every.any(axis=1)[i] & ~np.isnan(v), {}
        for number, (a, b) in enumerate(pairs):
            masks["set", number] = some[a] if b is None else some[a] | (sure[a] & some[b])
            here = np.flatnonzero((sure[a] if b is None else sure[a] & never[b]) & used)
            if not len(here):
                continue
            cells, code = np.unique(_value_cell(v[here]), return_inverse=True)
            counts = np.bincount(code * len(every) + i[here], minlength=len(cells) * len(every)).reshape(len(cells), -1)
            low, high = np.full(len(cells), np.inf), np.full(len(cells), -np.inf)
            np.minimum.at(low, code, v[here])
            np.maximum.at(high, code, v[here])
            sums = (counts.astype(np.float64) @ every).astype(np.int64)
            out += [(number, 0.0, *own, row.tobytes()) for *own, row in zip(cells, low, high, counts.sum(axis=1), sums)]
        kept = np.logical_or.reduce(some)
        masks |= {("taken", s): x for s, x in enumerate(some)}
        return mine[kept], {k: m[kept] for k, m in masks.items()}

    def weigh(first: bool, exact: bool):
        def task(mine: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
            if mine.empty or plan.empty:
                return pd.DataFrame(columns=partial.names, dtype=object)
            cut, spots = plan.iloc[0], {}
            weights = [_Weights(cut, s, int(mine["__nb"].iloc[0]), seed, draws) for s in range(len(names))]
            if not first:
                listed = pd.DataFrame({c: cut[f"s_{c}"] for c in ("set", "lo", "hi", "draw")})
                for s, g in listed.groupby("set"):
                    ends = g.groupby("lo")["hi"].first()
                    spots[s] = ends.index.to_numpy(), ends.to_numpy(), {lo: np.unique(d) for lo, d in g.groupby("lo")["draw"]}
            out, mine, masks = [], mine.sort_values("__v"), {}  # so that few cells meet at a time
            if first:
                mine, masks = settled(out, mine, weights)
            else:
                v, inside = mine["__v"].to_numpy(dtype=float), np.zeros(len(mine), dtype=bool)
                for lows, highs, _ in spots.values():
                    at = np.searchsorted(lows, v, side="right") - 1
                    inside |= (at >= 0) & (v <= highs[np.maximum(at, 0)])
                mine = mine[inside]
            for start in range(0, len(mine), WEIGHED_AT_ONCE):
                rows = mine.iloc[start : start + WEIGHED_AT_ONCE]
                i, v, e = rows["__i"].to_numpy(), rows["__v"].to_numpy(dtype=float), rows["__e"].fillna(0).to_numpy()
                w = [weights[s].of(rows[f"__x{n}"].to_numpy(), i, rows[f"__rank{n}"].to_numpy()) for s, n in enumerate(score_of)]
                if first:
                    for s in range(len(names)):
                        mask = masks["taken", s][start : start + WEIGHED_AT_ONCE]
                        for cell, total in ((0.0, w[s][mask].sum(axis=0)), (1.0, e[mask] @ w[s][mask])):
                            out.append((-1 - s, 0.0, cell, 0.0, 0.0, 0, total.astype(np.int64).tobytes()))
                for number, (a, b) in enumerate(pairs):
                    here = w[a] if b is None else np.maximum(w[a] - w[b], 0)
                    if first:
                        lows, highs, takers = np.array([-np.inf]), np.array([np.inf]), {-np.inf: slice(None)}
                    elif number in spots:
                        lows, highs, takers = spots[number]
                    else:
                        continue
                    at = np.searchsorted(lows, v, side="right") - 1
                    inside = (at >= 0) & ~np.isnan(v)
                    if first:
                        inside &= masks["set", number][start : start + WEIGHED_AT_ONCE]
                    inside[inside] = v[inside] <= highs[at[inside]]
                    for j in np.unique(at[inside]):
                        pick = np.flatnonzero(inside & (at == j))
                        ww = here[pick][:, takers[lows[j]]]
                        pick, ww = pick[ww.any(axis=1)], ww[ww.any(axis=1)]
                        if not len(pick):
                            continue
                        x = v[pick]
                        if first:
                            cell = _value_cell(x)
                        else:
                            cell = x if exact or lows[j] == highs[j] else np.floor((x - lows[j]) / (highs[j] - lows[j]) * SPLIT)
                        order = np.lexsort((x, cell))
                        x, cell = x[order], cell[order]
                        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                        ends = np.r_[starts[1:], len(x)]
                        sums = np.add.reduceat(ww[order], starts, axis=0).astype(np.int64)
                        spot = 0.0 if first else lows[j]
                        out += [(number, spot, cell[a_], x[a_], x[b_ - 1], b_ - a_, row.tobytes()) for a_, b_, row in zip(starts, ends, sums)]
            got = _merged(pd.DataFrame(out, columns=["set", "spot", "cell", "lo", "hi", "rows", "w"]))
            got["__unit"] = cut["__unit"]
            return stamped(got, mine, partial.names)

        return task

    def fold(parts: pd.DataFrame) -> pd.DataFrame:
        return stamped(_merged(parts).assign(__unit=parts["__unit"].iloc[0] // FAN), parts, partial.names)

    def locate(cells: pd.DataFrame, wanted: pd.DataFrame | None) -> pd.DataFrame:
        out = []
        if cells.empty:
            return pd.DataFrame(columns=spot_schema.names, dtype=object)
        for (name, spot), g in _merged(cells).sort_values("cell").groupby(["set", "spot"]):
            w = np.stack([np.frombuffer(b, dtype=np.int64) for b in g["w"]])
            if name < 0:
                for tag, row in zip(g["cell"], w):
                    out += [(name, d, "taken" if tag == 0 else "hits", n, 0.0, 0.0, 0) for d, n in enumerate(row.tolist())]
                continue
            cum = np.cumsum(w, axis=0)
            if wanted is None:
                who, total = np.arange(draws), cum[-1]
                asked = [(d, tag, k) for d in np.flatnonzero(total) for tag, k in (("low", (total[d] - 1) // 2 + 1), ("high", total[d] // 2 + 1))]
            else:
                mine = wanted[(wanted["set"] == name) & (wanted["lo"] == spot)]
                who = np.unique(mine["draw"])
                asked = zip(mine["draw"], mine["tag"], mine["rest"])
            for d, tag, k in asked:
                column = cum[:, np.searchsorted(who, d)]
                at = int(np.searchsorted(column, k))
                cell = g.iloc[at]
                out.append((name, d, tag, k - (column[at - 1] if at else 0), cell["lo"], cell["hi"], cell["rows"]))
        return stamped(pd.DataFrame(out, columns=["set", "draw", "tag", "rest", "lo", "hi", "rows"]), cells, spot_schema.names)

    def summed(found: DataFrame) -> DataFrame:
        left = most_units
        while left > FAN:
            found = found.groupBy(*keys, F.floor(F.col("__unit") / FAN)).applyInPandas(fold, partial)
            left = -(-left // FAN)
        return found

    group, fresh = [*by, "__part"], lambda d: d.toDF(*d.columns)  # both sides stem from the same rows
    found = summed(_spread(able_rows, group).groupBy(*group).cogroup(_spread(fresh(packed), group).groupBy(*group)).applyInPandas(weigh(True, False), partial))
    done = cut_lineage(found.groupBy(*keys).applyInPandas(lambda cells: locate(cells, None), spot_schema))
    open_spots, before = done.where("lo < hi"), None
    done = done.where("NOT lo < hi")
    while True:
        largest = open_spots.agg(F.max("rows")).first()[0]
        if largest is None:
            break
        exact, before = largest <= SORTED or largest == before, largest
        ends = ["set", "lo", "hi", "draw"]
        sought = open_spots.groupBy(*keys).agg(F.collect_list(F.struct(*ends)).alias("s"), F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
        sought = few(sought.select(*keys, "__lo", "__hi", *[F.col(f"s.{c}").alias(f"s_{c}") for c in ends]))
        near = O.join_groups(able_rows, sought.select(*keys, "__lo", "__hi"), keys).where("__v BETWEEN __lo AND __hi").drop("__lo", "__hi")
        plan = O.join_groups(packed, sought.drop("__lo", "__hi"), keys)
        found = summed(_spread(near, group).groupBy(*group).cogroup(_spread(fresh(plan), group).groupBy(*group)).applyInPandas(weigh(False, exact), partial))
        step = cut_lineage(found.groupBy(*keys).cogroup(fresh(open_spots).groupBy(*keys)).applyInPandas(locate, spot_schema))
        done, open_spots = done.unionByName(step.where("NOT lo < hi")), step.where("lo < hi")
    totals = cuts.groupBy(*keys, "draw").agg(*[F.sum(F.when(F.col("sel") == s, F.col("k"))).alias(f"k_{n}") for s, n in enumerate(names)])
    own = lambda s, tag: F.max(F.when((F.col("set") == -1 - s) & (F.col("tag") == tag), F.col("rest")))
    wide = done.groupBy(*keys, "draw").agg(
        *[own(s, tag).alias(f"{tag}_{n}") for s, n in enumerate(names) for tag in ("taken", "hits")],
        *[F.avg(F.when(F.col("set") == s, F.col("lo"))).alias(f"median_{n}") for s, n in enumerate(sets)],
    )
    return O.join_groups(totals, wide, [*keys, "draw"], "left")

"""Plans for groups of any size give the same rows as brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrain.operators import metrics as M, ordering as O, quality as Q, ranking as K, resampling as B

RNG = random.Random(7)


def rows_with_hot_group():
    out = []
    for i in range(1200):
        g = "hot" if i % 3 else ("b" if i % 2 else "c")
        v = None if i % 17 == 0 else (5.0 if i % 4 == 0 else RNG.lognormvariate(0, 3))
        out.append((g, i, v, RNG.randint(1, 3), RNG.choice([0.1, 0.1, 0.5, 0.9]), int(RNG.random() < 0.3)))
    out.append(("nulls", 5000, None, 1, 0.2, 0))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_with_hot_group(), "g string, i bigint, v double, w bigint, p double, e int").cache()


def test_quantiles_of_any_group(table):
    want = {"q05": (F.col("v"), 0.05), "q50": (F.col("v"), 0.5), "q95": (F.col("v"), 0.95), "neg": (-F.col("v"), 0.3)}
    held = {r.g: r for r in O.quantiles(table, ["g"], want, {"n": F.count("*")}, bounded=True).collect()}
    dealt = {r.g: r for r in O.quantiles(table, ["g"], want, {"n": F.count("*")}).collect()}
    groups = defaultdict(list)
    for r in table.collect():
        groups[r.g] += [] if r.v is None else [r.v]
    assert held.keys() == dealt.keys() == groups.keys() and len(held) == 4
    for g, vs in groups.items():
        assert held[g].n == dealt[g].n
        for c, q, sign in (("q05", 0.05, 1), ("q50", 0.5, 1), ("q95", 0.95, 1), ("neg", 0.3, -1)):
            want_value = np.quantile(sign * np.array(vs), q) if vs else None
            for got in (held, dealt):
                assert got[g][c] == (None if want_value is None else pytest.approx(want_value, rel=1e-12))


def test_weighted_quantiles_count_copies(table):
    want = {"q": (F.col("v"), 0.37)}
    a = {r.g: r.q for r in O.quantiles(table, ["g"], want, copies="w").collect()}
    b = {r.g: r.q for r in O.quantiles(table, ["g"], want, copies="w", bounded=True).collect()}
    copies = defaultdict(list)
    for r in table.collect():
        if r.v is not None:
            copies[r.g] += [r.v] * r.w
    for g, vs in copies.items():
        assert a[g] == pytest.approx(np.quantile(vs, 0.37)) and b[g] == pytest.approx(np.quantile(vs, 0.37))


def test_ungrouped_quantiles(table):
    want = {"q": (F.col("v"), 0.5)}
    assert O.quantiles(table, [], want).first().q == pytest.approx(O.quantiles(table, [], want, bounded=True).first().q)


def test_top_rows_of_any_group(table):
    a = {(r.g, r.i) for r in K.select_top(table, ["g"], "p", ["i"], 0.1).collect()}
    groups = defaultdict(list)
    for r in table.collect():
        groups[r.g].append(r)
    brute = {(g, r.i) for g, rs in groups.items() for r in sorted(rs, key=lambda r: (-r.p, r.i))[: math.ceil(0.1 * len(rs))]}
    assert a == brute


@pytest.mark.parametrize("score", [None, float("nan")])
def test_selections_have_the_size_of_the_budget(spark, score):
    ids = [(1 << 53) + i for i in range(10)]
    df = spark.createDataFrame([("g", i, score if n >= 8 else float(n // 4)) for n, i in enumerate(ids)], "g string, i bigint, p double")
    got = [r.i for r in K.select_top(df, ["g"], "p", ["i"], 0.2).collect()]
    assert sorted(got) == ids[4:6]
    assert len(K.select_top(df, ["g"], "p", ["i"], 1.0).collect()) == 8
    flags = O.flag_top(df, ["g"], {"top": K.order_by("p", ["i"])}, {"a": K.budget(0.1), "b": K.budget(0.5)}).collect()
    assert [sum(r[c] for r in flags) for c in ("top_a", "top_b")] == [1, 5]


def test_running_totals_and_average_precision(table):
    got = {r.g: r.average_precision for r in M.average_precision(table, ["g"], "e", "p").collect()}
    groups = defaultdict(list)
    for r in table.collect():
        groups[r.g].append(r)
    for g, rs in groups.items():
        total, ap = sum(r.e for r in rs), 0.0
        for p in sorted({r.p for r in rs}, reverse=True):
            above = [r.e for r in rs if r.p >= p]
            ap += sum(r.e for r in rs if r.p == p) * sum(above) / len(above)
        assert got[g] == (pytest.approx(ap / total) if total else None)


def test_previous_in_order_crosses_slices(table):
    got = {(r.g, r.i): r.prev for r in O.previous_in_order(table, ["g"], "i", "p", 50, "prev").collect()}
    last = {}
    for r in sorted(table.collect(), key=lambda r: r.i):
        assert got[r.g, r.i] == last.get(r.g)
        last[r.g] = r.p


def test_keep_last_among_many_copies(spark):
    df = spark.range(10000).select(F.lit("k").alias("k"), "id", (F.col("id") * 2).alias("v"))
    r = Q.keep_last(df, ["k"], ["id"]).collect()
    assert len(r) == 1 and r[0].v == 19998


def brute_draws(rows, taken, p, fraction, by_month=False):
    """Hits of the top selection of each draw, sampled rows laid out in slot order."""
    weeks = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.t):
        weeks[r.week].append(r)
    out = {}
    for draw, picks in taken.items():
        sample = [(slot, r) for slot, w in sorted(picks) for r in weeks[w]]
        k = math.ceil(fraction * len(sample))
        order = sorted(sample, key=lambda s: (-s[1][p], s[0], s[1].t))[:k]
        out[draw] = (k, sum(r.e for _, r in order), sorted((slot, r.t) for slot, r in order))
    return out


@pytest.mark.parametrize("buckets", [1, 4, 256])
def test_reranked_draws_match_brute_force(spark, buckets):
    rows = [("s", t // 7, t, RNG.choice([0.0, 0.25, 0.25, 0.6, 1.0]), int(RNG.random() < 0.4)) for t in range(90)]
    df = spark.createDataFrame(rows, "site string, week bigint, t bigint, p double, e int")
    taken = B.draw_blocks(df, ["site"], "week", 12, 3).cache()
    cut = B.resampled_cut(df, ["site"], ["site"], taken, "week", "p", "e", ["t"], [0.05, 0.1, 0.35], buckets)
    picks = defaultdict(list)
    for r in taken.collect():
        picks[r.draw].append((r.slot, r.week))
    inst = B.sampled_rows(df, ["site"], taken, "week").join(cut.select("site", "draw", "fraction", "cut"), ["site", "draw"])
    chosen = defaultdict(list)
    for r in inst.where(B.draw_order("p", "slot", ["t"]) <= F.col("cut")).select("draw", "fraction", "slot", "t").collect():
        chosen[r.draw, r.fraction].append((r.slot, r.t))
    got = {(r.draw, r.fraction): (r.k, r.hits) for r in cut.collect()}
    for f in (0.05, 0.1, 0.35):
        for draw, (k, hits, members) in brute_draws(df.collect(), picks, "p", f).items():
            assert got[draw, f] == (k, hits)
            assert sorted(chosen[draw, f]) == members


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([("s", b) for b in range(30)], "site string, b int")
    a = B.draw_blocks(df, ["site"], "b", 5, 9).collect()
    b = B.draw_blocks(df.repartition(7), ["site"], "b", 5, 9).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 150


@pytest.mark.parametrize("cells,size", [(4, 1), (16, 7), (1024, 3)])
def test_narrowed_ranks_equal_a_sort(spark, monkeypatch, cells, size):
    """Small cells and a small sort force several rounds: ties, far outliers, strings with one prefix, ids beyond 2**53."""
    monkeypatch.setattr(O, "CELLS", cells)
    monkeypatch.setattr(O, "SORTED", size)
    rng = random.Random(cells)
    score = lambda: rng.choice([0.5, 0.5, 0.25, rng.random(), -rng.random(), rng.random() * 1e-9, 1e300, -1e300, float("inf"), 1e15 + rng.randint(0, 3), None, float("nan")])
    data = [(rng.choice(["a", "b", None]), score(), score(), f"prefix-{rng.randint(0, 3)}", (1 << 53) + i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, p double, q double, s string, i bigint")
    flags = O.flag_top(df, ["g"], {"x": K.order_by("p", ["s", "i"]), "y": K.order_by("q", ["s", "i"])}, {"a": K.budget(0.03), "b": K.budget(0.5)}).collect()
    for name, column in (("x", "p"), ("y", "q")):
        for part, fraction in (("a", 0.03), ("b", 0.5)):
            for g in ("a", "b", None):
                own = [r for r in flags if r.g == g]
                able = sorted((r for r in own if r[column] is not None and r[column] == r[column]), key=lambda r: (-r[column], r.s, r.i))
                assert {r.i for r in own if r[f"{name}_{part}"]} == {r.i for r in able[: math.ceil(fraction * len(own))]}
    plain = df.where("NOT isnan(p) AND abs(p) < 1e301")
    got = {r.g: (r.l, r.m) for r in O.quantiles(plain, ["g"], {"l": (F.col("p"), 0.1), "m": (F.col("p"), 0.77)}).collect()}
    held = {r.g: (r.l, r.m) for r in O.quantiles(plain, ["g"], {"l": (F.col("p"), 0.1), "m": (F.col("p"), 0.77)}, bounded=True).collect()}
    assert got.keys() == held.keys() and all(got[g] == pytest.approx(held[g], rel=1e-12) for g in got)


def test_bounded_groups_give_the_same_selections(table):
    orders = {"x": K.order_by("p", ["i"]), "y": K.order_by("v", ["i"])}
    sizes = {"a": K.budget(0.05), "b": K.budget(0.4)}
    df = table.withColumn("n", F.col("w") * 10)
    pick = lambda flags: sorted((r.i, r.n, r.x_a, r.x_b, r.y_a, r.y_b) for r in flags.collect())
    assert pick(O.flag_top(df, ["g"], orders, sizes)) == pick(O.flag_top(df, ["g"], orders, sizes, bounded=True))
    near = lambda df: {r.g: None if r.average_precision is None else round(r.average_precision, 12) for r in df.collect()}
    assert near(M.average_precision(table, ["g"], "e", "p")) == near(M.average_precision(table, ["g"], "e", "p", bounded=True))

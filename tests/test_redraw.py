"""Ranks in all draws, found from counts, against draws that are written out row by row."""

import math
import random
from collections import defaultdict
from statistics import median

import pytest

from hourgrain.operators import redraw as R, resampling as B

DRAWS, SEED = 150, 17


def written_out(rows, draws):
    """{(site, draw): [(slot, row)]} from the draws that Spark makes."""
    weeks = defaultdict(list)
    for r in rows:
        weeks[r.site, r.week].append(r)
    out = defaultdict(list)
    for d in draws:
        out[d.site, d.draw] += [(d.slot, r) for r in weeks[d.site, d.week]]
    return out


@pytest.mark.parametrize("cells,alone", [(4, 1), (16, 20), (1024, 4096)])
def test_ranks_of_all_draws_match_written_out_draws(spark, monkeypatch, cells, alone):
    for name, value in (("CELLS", cells), ("UNIT_CELLS", cells), ("ALONE", alone)):
        monkeypatch.setattr(R, name, value)
    rng = random.Random(cells)
    score = lambda: rng.choice([0.25, 0.25, rng.random(), rng.random() * 1e-9, -0.0, None, float("nan")])
    value = lambda: rng.choice([1.0, 1e6, rng.random(), -rng.random() * 1e5, None])
    data = [(rng.choice(["a", "b", "b", None]), t // 9, t, score(), int(rng.random() < 0.4), value(), rng.choice(["high", "low", None])) for t in range(400)]
    data.append(("lone", 1, 1000, None, 1, None, None))
    df = spark.createDataFrame(data, "site string, week bigint, t bigint, p double, e int, v double, grp string")
    draws = written_out(df.collect(), B.draw_blocks(df, ["site"], "week", DRAWS, SEED).collect())
    rows = R.numbered(df, ["site"], "week")
    got = {(r.site, r.draw, r.fraction): (r.k, r.hits) for r in R.selection_hits(rows, ["site"], "p", "e", ["t"], [0.05, 0.3, 1.0], DRAWS, SEED).collect()}
    able = lambda r: r.p is not None and r.p == r.p
    assert len(got) == 3 * len(draws)
    for (site, draw), sample in draws.items():
        order = sorted((s for s in sample if able(s[1])), key=lambda s: (-s[1].p, s[0], s[1].t))
        for f in (0.05, 0.3, 1.0):
            k = math.ceil(f * len(sample))
            assert got[site, draw, f] == (k, sum(r.e for _, r in order[:k])), (site, draw, f)
    found = {(r.site, r.grp, r.draw): r.median for r in R.medians(rows.where("grp IS NOT NULL"), ["site", "grp"], "v", DRAWS, SEED).collect()}
    want = defaultdict(list)
    for (site, draw), sample in draws.items():
        for _, r in sample:
            if r.grp and r.v is not None:
                want[site, r.grp, draw].append(r.v)
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(median(v), rel=1e-12) for k, v in want.items())
    ends = {r.site: r for r in B.median_difference_interval(df, ["site"], "week", "grp", "v", SEED, DRAWS).collect()}
    assert ends.keys() == {"a", "b", "lone", None} and ends["lone"].difference_valid_draws == 0 and ends["lone"].difference_lo95 is None


def test_shared_arrays_are_the_draws_of_spark(spark):
    df = spark.createDataFrame([("s", b * 3) for b in range(11)], "site string, b int")
    got = R.picks(5, 20, 11)
    assert all(got[r.draw, r.slot] * 3 == r.b for r in B.draw_blocks(df, ["site"], "b", 20, 5).collect())
    assert (R.times(5, 20, 11).sum(axis=0) == 11).all()


def test_empty_rows_have_no_ranks(spark):
    rows = R.numbered(spark.createDataFrame([], "site string, week bigint, t bigint, p double, e int"), ["site"], "week")
    assert R.selection_hits(rows, ["site"], "p", "e", ["t"], [0.1], 5, 1).count() == 0


@pytest.mark.parametrize("split,alone,part,fan,at_once", [(4, 1, 40, 2, 7), (64, 512, 100_000, 32, 1024)])
def test_selections_of_all_draws_match_written_out_draws(spark, monkeypatch, split, alone, part, fan, at_once):
    for name, x in (("SPLIT", split), ("VALUE_CELLS", split), ("SORTED", alone), ("PART_ROWS", part), ("FAN", fan), ("WEIGHED_AT_ONCE", at_once)):
        monkeypatch.setattr(R, name, x)
    rng = random.Random(split)
    score = lambda: rng.choice([0.25, 0.25, 0.75, rng.random(), -0.0, None, float("nan")])
    value = lambda: rng.choice([1.0, 1e6, rng.random(), -rng.random() * 1e5, None, float("nan")])
    data = [(rng.choice(["a", "b", "b", None]), t // 9, t // 20, t, score(), score(), rng.choice([0, 0, 1, None]), value()) for t in range(300)]
    data.append(("lone", 1, 1, 1000, None, None, 1, None))
    df = spark.createDataFrame(data, "site string, week bigint, ym bigint, t bigint, p0 double, p1 double, e int, v double").repartition(5)
    draws = written_out(df.collect(), B.draw_blocks(df, ["site"], "week", DRAWS, SEED).collect())
    picked = {"a": ("p0", 0.1), "b": ("p1", 0.3), "c": ("p0", 1.0)}
    sets = {"a": ("a", None), "b": ("b", None), "c": ("c", None), "a_not_b": ("a", "b"), "b_not_a": ("b", "a")}
    for within in ([], ["ym"]):
        got = {(r.site, r.draw): r for r in R.selection_medians(df, ["site"], within, "week", "e", "v", picked, sets, ["t"], DRAWS, SEED).collect()}
        assert got.keys() == draws.keys()
        for key, sample in draws.items():
            parts = defaultdict(list)
            for s in sample:
                parts[s[1].ym if within else 0].append(s)
            chosen, budget = {}, {}
            for name, (p, f) in picked.items():
                budget[name], chosen[name] = 0, set()
                for rows in parts.values():
                    k = math.ceil(f * len(rows))
                    order = sorted((s for s in rows if s[1][p] is not None and s[1][p] == s[1][p]), key=lambda s: (-s[1][p], s[0], s[1].t))
                    budget[name] += k
                    chosen[name] |= {(slot, r.t) for slot, r in order[:k]}
            known, r = {(slot, x.t): x for slot, x in sample}, got[key]
            for name in picked:
                assert (r[f"k_{name}"], r[f"taken_{name}"] or 0, r[f"hits_{name}"] or 0) == (budget[name], len(chosen[name]), sum(known[s].e or 0 for s in chosen[name]))
            for name, (one, other) in sets.items():
                values = [known[s].v for s in chosen[one] - (chosen[other] if other else set())]
                values = [x for x in values if x is not None and x == x]
                assert (r[f"median_{name}"] is None) == (not values)
                assert not values or r[f"median_{name}"] == pytest.approx(median(values), rel=1e-12)


def test_empty_rows_have_no_selections(spark):
    df = spark.createDataFrame([], "site string, week bigint, t bigint, p double, e int, v double")
    assert R.selection_medians(df, ["site"], [], "week", "e", "v", {"a": ("p", 0.1)}, {"a": ("a", None)}, ["t"], 5, 1).count() == 0

"""Tree ensembles of many cases: one model for each group of ``keys`` (a site, a lead, a predictor set), all cases in one job.

A case is a series that the calendar bounds (8,784 hours or 1,464 blocks of a site in a year), so one task fits it; Spark deals the cases.
Predictors become bins by the quantiles of the case's training rows. Trees grow leaf by leaf on sums per (predictor, bin): the split
of largest gain anywhere in the tree comes first, and a child's sums are its parent's less its sibling's. Boosting adds shrunken
trees to the training rows' log-odds or mean; with validation rows a case stops after ``patience`` rounds without a smaller
loss and, if ``refit`` marks rows, is fitted again on those for the best number of rounds. Forests weight each row by a Poisson
number of the tree's own generator, seeded by (seed, tree), over rows sorted by ``ids``: a recomputed task gives the same trees.

Missing predictors are bins of their own below all others. Cases without training rows, or with one class, predict the training mean
(NULL without training rows).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# Model settings.
REGRESSION = {"rounds": 160, "rate": 0.03, "leaves": 15, "least": 40, "l2": 1.0}
CLASSIFICATION = {"rounds": 300, "rate": 0.03, "leaves": 15, "least": 20, "l2": 1.0}
SHALLOW = {"rounds": 300, "rate": 0.03, "leaves": 8, "depth": 3, "least": 1, "l2": 1.0}
FOREST = {"trees": 300, "least": 10}
PATIENCE = 25
BINS = 255


def bin_codes(x: np.ndarray, train: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, int]:
    """Bins of every value, numbered through all predictors, and the bins of a predictor; 0 is missing."""
    codes = np.zeros(x.shape, dtype=np.int64)
    for j in range(x.shape[1]):
        known = np.unique(x[train & np.isfinite(x[:, j]), j])
        edges = known[:-1] / 2 + known[1:] / 2 if len(known) <= bins else np.unique(np.quantile(known, np.arange(1, bins) / bins))
        codes[:, j] = np.where(np.isfinite(x[:, j]), 1 + np.searchsorted(edges, x[:, j], side="left"), 0) + j * (bins + 1)
    return codes, bins + 1


def sums(codes: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """(3, predictors, bins): gradients, weights and row counts of ``rows``."""
    flat, p = codes[rows].ravel(), codes.shape[1]
    return np.stack([np.bincount(flat, np.repeat(v[rows], p), p * width) for v in (g, h, n)]).reshape(3, p, width)


def best_split(own: np.ndarray, least: float, l2: float, allowed: np.ndarray | None = None) -> tuple[float, int, int]:
    """(gain, predictor, last bin of the left side) of the best split; a gain of 0 or less is none."""
    left = np.cumsum(own, axis=2)
    whole = left[:, :1, -1:]
    right = whole - left
    value = lambda s: s[0] ** 2 / (s[1] + l2 + 1e-300)
    gain = value(left) + value(right) - value(whole)
    gain[(left[2] < least) | (right[2] < least) | (left[1] < 1e-3) | (right[1] < 1e-3)] = -np.inf
    if allowed is not None:
        gain[~allowed] = -np.inf
    j, b = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[j, b]), int(j), int(b)


class Tree:
    """Nodes (predictor, last bin of the left side, left, right), leaves with predictor -1 and a value."""

    def __init__(self):
        self.nodes: list[list] = [[-1, 0, 0, 0, 0.0]]

    def predict(self, codes: np.ndarray, width: int) -> np.ndarray:
        nodes = np.array([n[:4] for n in self.nodes], dtype=np.int64)
        at = np.zeros(len(codes), dtype=np.int64)
        while True:
            inner = np.flatnonzero(nodes[at, 0] >= 0)
            if not len(inner):
                return np.array([n[4] for n in self.nodes])[at]
            j, b, left, right = nodes[at[inner]].T
            at[inner] = np.where(codes[inner, j] - j * width <= b, left, right)


def grow(codes: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, width: int, least: float, l2: float, value: Callable[[np.ndarray], float],
         leaves: int | None = None, depth: int | None = None, choose: Callable[[], np.ndarray] | None = None) -> Tree:
    """A tree over ``rows``, the best split of all leaves first."""
    tree = Tree()

    def leaf(node: int, rows: np.ndarray, own: np.ndarray, level: int) -> tuple:
        tree.nodes[node][4] = value(own[:, 0].sum(axis=1))
        split = best_split(own, least, l2, choose() if choose else None) if depth is None or level < depth else (0.0, 0, 0)
        return split[0], node, rows, own, level, split

    open_leaves = [leaf(0, rows, sums(codes, rows, g, h, n, width), 0)]
    done = 1
    while open_leaves and (leaves is None or done < leaves):
        k = max(range(len(open_leaves)), key=lambda i: open_leaves[i][0])
        gain, node, own_rows, own, level, (_, j, b) = open_leaves.pop(k)
        if gain <= 1e-12:
            break
        left = codes[own_rows, j] - j * width <= b
        sides = own_rows[left], own_rows[~left]
        small = int(len(sides[1]) < len(sides[0]))
        parts: list = [None, None]
        parts[small] = sums(codes, sides[small], g, h, n, width)
        parts[1 - small] = own - parts[small]
        children = [len(tree.nodes), len(tree.nodes) + 1]
        tree.nodes += [[-1, 0, 0, 0, 0.0], [-1, 0, 0, 0, 0.0]]
        tree.nodes[node][:4] = [j, b, *children]
        open_leaves += [leaf(c, r, s, level + 1) for c, r, s in zip(children, sides, parts)]
        done += 1
    return tree


def boosted(x: np.ndarray, y: np.ndarray, train: np.ndarray, validation: np.ndarray | None, logistic: bool, rounds: int, rate: float, leaves: int, least: int, l2: float,
            depth: int | None = None, patience: int = PATIENCE) -> tuple[np.ndarray, int]:
    """(prediction of every row, number of rounds): boosting on ``train``, stopped on ``validation`` if it has rows."""
    mean = float(y[train].mean()) if train.any() else np.nan
    if not train.any() or logistic and mean in (0.0, 1.0):
        return np.full(len(y), mean), 0
    codes, width = bin_codes(x, train)
    rows, one = np.flatnonzero(train), np.ones(len(y))
    score = np.full(len(y), np.log(mean / (1 - mean)) if logistic else mean)
    stop = validation is not None and bool(validation.any())
    best, lowest, kept = 0, np.inf, score.copy()
    for i in range(1, rounds + 1):
        if logistic:
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
        else:
            g, h = y - score, one
        tree = grow(codes, rows, g, h, one, width, least, l2, lambda s: rate * s[0] / (s[1] + l2), leaves, depth)
        score = score + tree.predict(codes, width)
        if stop:
            s, t = score[validation], y[validation]
            loss = float(np.mean(np.logaddexp(0, s) - t * s if logistic else (t - s) ** 2))
            if loss < lowest:
                best, lowest, kept = i, loss, score.copy()
            elif i - best >= patience:
                break
        else:
            best, kept = i, score
        if len(tree.nodes) == 1:  # nothing left to split
            break
    return (1 / (1 + np.exp(-kept)) if logistic else kept), best


def forest(x: np.ndarray, y: np.ndarray, train: np.ndarray, trees: int, least: int, seed: int) -> np.ndarray:
    """Mean over trees of the share of ones in a row's leaf; each split considers a random root of the predictors, depth is free."""
    if not train.any() or y[train].min() == y[train].max():
        return np.full(len(y), float(y[train].mean()) if train.any() else np.nan)
    codes, width = bin_codes(x, train)
    p, total = x.shape[1], np.zeros(len(y))
    some = max(1, int(np.sqrt(p)))
    for i in range(trees):
        rng = np.random.default_rng([seed, i])
        w = rng.poisson(1.0, len(y)).astype(float) * train
        rows = np.flatnonzero(w)

        def choose() -> np.ndarray:
            allowed = np.zeros(p, dtype=bool)
            allowed[rng.permutation(p)[:some]] = True
            return allowed

        share = float(w @ y / w.sum()) if len(rows) else float(y[train].mean())
        # centred labels: the gain is then the fall of the weighted Gini index
        tree = grow(codes, rows, w * (y - share), w, w, width, least, 0.0, lambda s: share + s[0] / max(s[1], 1e-300), choose=choose)
        total += tree.predict(codes, width)
    return total / trees


def fit_cases(rows: DataFrame, keys: Sequence[str], ids: Sequence[str], features: str, label: str, family: str, train: str = "fit", validation: str | None = None,
              refit: str | None = None, score: str = "test", out: str = "p", seed: int = 270927, patience: int = PATIENCE, **settings) -> DataFrame:
    """(keys, ids, label, out, best_iteration) of the rows that ``score`` marks. ``family``: regression, boosted, boosted_shallow or forest.

    ``features`` is an array of doubles; the other names are boolean columns. ``ids`` are unique within a case.
    """
    keys, ids = list(keys), list(ids)
    given = {**{"regression": REGRESSION, "boosted": CLASSIFICATION, "boosted_shallow": SHALLOW, "forest": FOREST}[family], **settings}
    flags = {name: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(False) for name, c in (("__train", train), ("__validation", validation), ("__refit", refit), ("__score", score))}
    d = rows.select(*keys, *ids, F.col(features).alias("__x"), F.col(label).cast("double").alias(label), *[c.alias(n) for n, c in flags.items()])
    known = (F.col("__train") | F.col("__validation") | F.col("__refit")) & F.col(label).isNotNull()
    d = d.where(known | F.col("__score"))
    kinds = {f.name: f for f in d.schema.fields}
    schema = T.StructType([*[kinds[c] for c in [*keys, *ids, label]], T.StructField(out, T.DoubleType()), T.StructField("best_iteration", T.LongType())])

    marks = list(flags)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ids, kind="stable")
        x = np.array(pdf["__x"].tolist(), dtype=float).reshape(len(pdf), -1)
        y = pdf[label].to_numpy(float)
        use = {n: pdf[n].to_numpy(bool) & (np.isfinite(y) if n != "__score" else True) for n in marks}
        if family == "forest":
            p, best = forest(x, np.nan_to_num(y), use["__train"], seed=seed, **given), given["trees"]
        else:
            logistic = family != "regression"
            p, best = boosted(x, np.nan_to_num(y), use["__train"], use["__validation"], logistic, patience=patience, **given)
            if use["__refit"].any():
                p, _ = boosted(x, np.nan_to_num(y), use["__refit"], None, logistic, **{**given, "rounds": best})
        result = pdf.loc[:, [*keys, *ids, label]].assign(**{out: p, "best_iteration": best})
        return result[use["__score"]]

    return d.groupBy(*keys).applyInPandas(run, schema)

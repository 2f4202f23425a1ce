"""Near-duplicate vectors by cosine: int8 tile products with error bounds, then full precision where it can matter.

A unit vector x is stored as ``s * q + e`` with int8 ``q``; the norm of its own rounding error ``e`` is known exactly. For two
vectors, ``|cos - s_x s_y (q_x . q_y)| <= (1 + |e_x|)(1 + |e_y|) - 1`` (from ``cos = s_x q_x . s_y q_y + s_x q_x . e_y + e_x . y``
with ``|s_x q_x| <= 1 + |e_x|``). The integer products of a tile are exact in single precision; only pairs whose upper bound
reaches the threshold are computed again in double precision, and only those results decide.

Equal vectors are one node with a count, so a large group of copies costs no pairs. Distinct vectors are dealt into
blocks of about ``BLOCK`` and every pair of blocks is one tile. A tile returns, for each of its vectors with links, the number
of linked vectors and one edge of a spanning forest of its links: rows as its vectors, never as its pairs.

Defined results: null, empty, zero vectors and vectors with null, NaN or infinite components link with nothing and are their
own component; vectors of different length do not link; rows that share an id are separate rows that are counted one by
one and reach the same component; a null id links and is counted but never names a component; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrain.llm.common import components, cut_lineage

#: Distinct vectors in a block, rows of a tile product computed at a time, pairs recomputed at a time.
BLOCK, STRIPE, PAIRS = 4096, 1024, 1 << 16
#: Room for the rounding of the bounds themselves, far above double precision's and far below the bounds.
SLACK = 1e-6


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer values (kept as float32), scales and error norms of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q.astype(np.float32), scale, error


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer dot products; slices of 1,024 components keep every single-precision sum below 2**24."""
    out = a[:, :1024] @ b[:, :1024].T
    if a.shape[1] > 1024:
        out = out.astype(np.float64)
        for at in range(1024, a.shape[1], 1024):
            out += a[:, at : at + 1024] @ b[:, at : at + 1024].T
    return out


def linked_pairs(x: np.ndarray, y: np.ndarray, least: float, same: bool):
    """Index pairs (i, j) with cosine >= least, in stripes; ``same``: x is y and only i < j counts."""
    qx, sx, ex = quantised(x)
    qy, sy, ey = (qx, sx, ex) if same else quantised(y)
    for at in range(0, len(x), STRIPE):
        to = min(at + STRIPE, len(x))
        upper = exact_products(qx[at:to], qy) * (sx[at:to, None] * sy[None, :]) + ((1 + ex[at:to, None]) * (1 + ey[None, :]) - 1)
        maybe = upper >= least - SLACK
        if same:
            maybe &= np.arange(at, to)[:, None] < np.arange(len(y))[None, :]
        i, j = np.nonzero(maybe)
        i += at
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            sure = np.einsum("nd,nd->n", x[a], y[b]) >= least
            yield a[sure], b[sure]


def tile(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, vectors: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with links, their linked vectors in this tile, and the root of each in a forest that spans the links.

    ``same``: the tile is one block with itself; otherwise only pairs of the two sides count, none if a side is empty."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # first, so that squares stay finite
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    other = left if same else right
    found = np.zeros(len(ids), dtype=np.int64)
    root = np.arange(len(ids))
    for a, b in linked_pairs(unit[left], unit[other], least, same):
        a, b = left[a], other[b]
        found += np.bincount(a, copies[b], len(ids)).astype(np.int64) + np.bincount(b, copies[a], len(ids)).astype(np.int64)
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    has = np.flatnonzero(found)
    return ids[has], found[has], ids[root[has]]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other vectors with cosine >= threshold), component_id, kept."""
    rows = cut_lineage(vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vector_col].cast("array<double>").alias("v")))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    nodes = cut_lineage(
        rows.where(usable).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        .select("v", F.coalesce("rep", -F.abs(F.xxhash64("v")) - 2).alias("node"), "rep", "copies")
    )  # vectors whose ids are all null still need a node of their own: a negative one
    blocks = max(1, -(-nodes.count() // block))
    of = F.pmod(F.xxhash64("node", "v"), F.lit(blocks)).cast("int")
    dealt = nodes.select("node", "copies", "v", F.size("v").alias("d"), of.alias("own")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("with")
    ).select("node", "copies", "v", "d", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), (F.col("own") > F.col("with")).cast("int").alias("side"))

    def run(group: pa.Table) -> pa.Table:
        dim = group.column("d")[0].as_py()
        flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        node, links, root = tile(*(group.column(c).to_numpy() for c in ("node", "copies", "side")), flat, threshold, group.column("a")[0] == group.column("b")[0])
        return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.int64())})

    tiles = cut_lineage(dealt.groupBy("d", "a", "b").applyInArrow(run, "node bigint, links bigint, root bigint"))
    linked = components(tiles.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # a component's smallest node may be one without an id: name it by the smallest id among its nodes
    named = nodes.join(linked, "node", "left").select("v", "node", "rep", "copies", F.coalesce("component", "node").alias("c"))
    names = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    counts = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    result = cut_lineage(named.join(names, "c").join(counts, "node", "left").select(F.col("v").alias("v_"), "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = rows.join(result, (rows["v"] == result["v_"]) & usable, "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )

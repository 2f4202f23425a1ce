"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints and MinHash bands propose pairs, the shingle sets decide.

A text is the set of its runs of ``shingle`` words (lower-cased A-Z, ASCII white space), by 64-bit hashes. Texts with one set are one
node, however many there are. A set has ``BANDS * ROWS`` MinHash values; nodes that agree on all values of a band share a
bucket. Every two nodes that share one are compared by their whole sets, or known to be in one component already; a similarity of
``similarity`` or more is a link. A pair of similarity s shares no bucket with probability ``(1 - s**ROWS)**BANDS``: 2e-4 at 0.8, 4e-8
at 0.9; nothing else is lost.

The sets' SimHash fingerprints propose pairs of their own (``simhash.links``): nodes of one fingerprint meet the smallest document's, fingerprints at most
two bits apart the smallest document's of each shared variant. Few pairs near 0.8 are so close, hence the bands beside them.

In buckets of at most ``SMALL`` nodes all pairs are compared at once. In larger ones all nodes first meet the bucket's first by an
order that differs from band to band, which joins a group of copies by as many comparisons as it has nodes. What is then not in the
component of its bucket's first (the family of texts just below the threshold, say) is compared with all nodes of the bucket, in tiles of
``BLOCK`` by ``BLOCK`` sets spread over the tasks; a pair is compared in its first common band alone, and a tile returns a spanning
forest of its links: rows as its nodes, never as its pairs.

Defined results: a text with fewer words than ``shingle`` is one shingle, null and wordless texts have the empty set, and link
to each other alone; rows that share an id are one document; a null id gets the component of the documents with ids that have its
set, null if there is none; an empty table gives an empty result; other columns are not read. Texts are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrain.llm import simhash
from hourgrain.llm.common import components, cut_lineage, forget, hinted, row_batches, stored
from hourgrain.llm.kmers import grams, mixed

BANDS, ROWS, SMALL, BLOCK = 16, 4, 16, 256
BATCH_BYTES = 4 << 20
SEEDS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], dtype=np.uint64)
    hash64 = xxhash.xxh64_intdigest
    return np.unique(grams(np.array([hash64(w) for w in words], dtype=np.uint64), shingle))


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys for every set; the empty one has the values of a fixed element."""
    sets = [own if len(own) else np.zeros(1, dtype=np.uint64) for own in sets]
    h, sizes = np.concatenate(sets), np.array([len(own) for own in sets])
    first = np.cumsum(sizes) - sizes
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for i, seed in enumerate(SEEDS):
        least = np.minimum.reduceat(mixed(h + seed), first)
        out[:, i // ROWS] = mixed(out[:, i // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least)
    return out


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, node, bands, fp): one row per row of ``docs`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in row_batches(batches, "text", BATCH_BYTES):
            sets = [shingles(text, shingle) for text in batch.column("text").to_pylist()]
            keys = [list(map(int, row)) for row in bands(sets).view(np.int64)] if sets else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(digest, sets), pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(map(simhash.majority, sets), pa.int64())], ["id", "node", "bands", "fp"])

    return docs.mapInArrow(run, "id bigint, node binary, bands array<bigint>, fp bigint")


def buckets(nodes: DataFrame) -> DataFrame:
    """(band, key, node, n, first): the nodes (node, bands) of buckets with two nodes or more."""
    placed = nodes.select("node", F.posexplode("bands").alias("band", "key")).withColumn("rank", F.xxhash64("band", "node"))
    sizes = placed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min_by("node", F.struct("rank", "node")).alias("first")).where("n > 1")
    return cut_lineage(placed.join(sizes, ["band", "key"]).select("band", "key", "node", "n", "first"))


def candidates(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes that are compared first: all of small buckets, all with the first of large ones."""
    star = met.where((F.col("n") > SMALL) & (F.col("node") != F.col("first"))).select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))
    few = met.where(F.col("n") <= SMALL).groupBy("band", "key").agg(F.collect_list("node").alias("own"))
    pairs = few.select("own", F.explode("own").alias("a")).select("a", F.explode("own").alias("b")).where("a < b")
    return star.union(pairs).distinct()


def close_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, rep, fp) that SimHash proposes."""
    prints = nodes.select(F.col("rep").alias("id"), "fp")
    same = nodes.join(nodes.groupBy("fp").agg(F.min("rep").alias("a")), "fp").select("a", F.col("rep").alias("b"))
    of = lambda c: nodes.select(F.col("rep").alias(c), F.col("node").alias(f"node_{c}"))
    met = simhash.links(prints, 1).union(same).join(of("a"), "a").join(of("b"), "b").where("node_a != node_b")
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, own, rep): the shingles of the nodes ``wanted`` (node, rep), read again from the texts of their documents."""
    reps = wanted.select(F.col("rep").alias("id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, "text", BATCH_BYTES):
            sets = [shingles(text, shingle) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, sets), pa.binary()), pa.array([own.view(np.int64) for own in sets], pa.list_(pa.int64()))], ["node", "own"])

    texts = docs.join(hinted(reps, reps.count()), "id", "left_semi").select("text")
    sets = stored(texts.mapInArrow(run, "node binary, own array<bigint>").groupBy("node").agg(F.first("own").alias("own")), "near-sets")
    return sets.join(wanted, "node")


def tile_links(left: list[np.ndarray], right: list[np.ndarray], left_bands: np.ndarray, right_bands: np.ndarray, band: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Index pairs of similar sets, left out if an earlier band has them in one bucket."""
    sizes = np.array([len(x) for x in right])
    values = np.concatenate(right)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], np.repeat(np.arange(len(right)), sizes)[order]
    for i, own in enumerate(left):
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        counts = high - low
        at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = np.bincount(owners[at], minlength=len(right))
        close = both >= similarity * (len(own) + sizes - both)
        if band:
            close &= ~(left_bands[i, :band] == right_bands[:, :band]).any(axis=1)
        yield from ((i, int(j)) for j in np.flatnonzero(close))


def large_bucket_links(met: DataFrame, sides: DataFrame, nodes: DataFrame, linked: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between smallest documents of nodes that share a large bucket and are not in the component of its first one."""
    of = nodes.select("node", "rep", "bands").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("node", "rep", "bands", F.coalesce("component", "rep").alias("component"))
    firsts = of.select(F.col("node").alias("first"), F.col("component").alias("main"))
    large = cut_lineage(met.where(F.col("n") > SMALL).join(of, "node").join(firsts, "first").select("band", "key", "node", "rep", "bands", "n", (F.col("component") != F.col("main")).alias("apart")))
    open_ones = large.where("apart").select("band", "key").distinct()
    large = large.join(open_ones, ["band", "key"], "left_semi").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    large = large.withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int")).join(sides.select("node", "own"), "node")
    other = lambda df: df.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["band", "key", "rep", "bands", "own"]
    ones = other(large.where("apart")).select(*columns, F.col("block").alias("i"), F.col("with").alias("j"), F.lit(0).alias("side"))
    all_ = other(large).select(*columns, F.col("with").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        reps, band = group.column("rep").to_numpy(), group.column("band")[0].as_py()
        bands_ = group.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(side), -1)
        own = [np.asarray(x, dtype=np.int64) for x in group.column("own").to_pylist()]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        if len(left) and len(right):
            for i, j in tile_links([own[k] for k in left], [own[k] for k in right], bands_[left], bands_[right], band, similarity):
                a, b = sorted((top(int(reps[left[i]])), top(int(reps[right[j]]))))
                root[b] = a
        found = [(x, top(x)) for x in list(root) if top(x) != x]
        return pa.table({"a": pa.array([y for _, y in found], pa.int64()), "b": pa.array([x for x, _ in found], pa.int64())})

    return ones.union(all_).groupBy("band", "key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between the smallest documents of nodes (node, rep, bands, fp) that give the components of all similar pairs."""
    met = buckets(nodes)
    pairs = cut_lineage(candidates(met).union(close_prints(nodes)).distinct())
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut_lineage(ends.join(nodes.select("node", "rep"), "node"))
    sides = whole_sets(docs, wanted, shingle)
    of = lambda c: sides.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}"), F.col("rep").alias(f"rep_{c}"))
    both = F.size(F.array_intersect("own_a", "own_b"))
    close = both >= similarity * (F.size("own_a") + F.size("own_b") - both)
    first = cut_lineage(pairs.join(of("a"), "a").join(of("b"), "b").where(close).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    return first.union(large_bucket_links(met, sides, nodes, components(first), similarity))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, component_id (smallest id reachable by links)."""
    texts = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    rows = stored(sketches(texts, shingle), "near-sketches")
    nodes = stored(rows.where("id IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "near-nodes")
    linked = components(links(texts, nodes, shingle, similarity))  # checkpointed there
    named = nodes.select("node", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component_id"))
    return rows.select("id", "node").join(cut_lineage(named), "node", "left").select(F.col("id").alias(id_col), "component_id")

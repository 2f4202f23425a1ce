"""Helpers shared by the operators: table access, size-checked broadcasts and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrain.session import configure, cut_lineage, scratch_path

#: Rows beyond which a table is not broadcast but joined by shuffling both sides.
BROADCAST_ROWS = 2_000_000
#: Bytes of a batch of rows on its way to Python.
ARROW_BYTES = 8 << 20


#: What operators remember in a worker between tasks; ``forget`` empties it.
MEMORIES: list[dict] = []


def forget() -> None:
    """Drop what other operators have remembered in this worker, and return its free memory, before a stage that needs it."""
    for memory in MEMORIES:
        memory.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; from then on Spark drops a query's shuffle files when the query has ended, since later ones read what is stored,
    and hands rows to Python in batches of a few megabytes, however long their texts are."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def hinted(small: DataFrame, rows: int) -> DataFrame:
    """``small`` with a broadcast hint if its counted rows allow it; the join's result is the same either way."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: a cut of the lineage that columns can be pruned from."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most_bytes`` of ``column`` each, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def components(links: DataFrame) -> DataFrame:
    """Connected components of the links ``(a, b)``: one row ``(node, component)`` for each node that has a link to another.

    ``component`` is the smallest node. Every round hooks each root on its smallest neighbour, shortens the hooks to
    their roots by pointer jumping, and contracts the links. A component with two roots or more loses at least half of
    them in a round, so the rounds grow with the logarithm of the longest chain. All state stays in checkpointed tables.
    """
    edges = cut_lineage(
        links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    labels = None
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        roots = cut_lineage(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")))
        while True:
            upper = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = cut_lineage(roots.join(upper, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            roots = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            upper = roots.select(F.col("node").alias("component"), F.col("root"))
            labels = cut_lineage(labels.join(upper, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        moved = edges.join(of("a"), "a").join(of("b"), "b").where("root_a != root_b")
        edges = cut_lineage(moved.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels

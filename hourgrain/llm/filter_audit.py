"""How filters interact: what every order of the filters keeps, removes and repeats, from one walk over their subsets.

Each document fails some of the filters; documents of one part with the same failures and labels are one cell, counted by Spark.
``survivors`` then visits all subsets of the filters in Gray-code order. A step toggles one filter: every cell that fails
it changes its counter of active failures, and where the counter leaves or reaches zero the running survivors change. The
survivors of the 32 subsets are stored; every step of every order is the difference of two of them.

``FILTERS`` (words: runs of other than ASCII white space): A under 50 words; B fewer than 65 distinct words in a hundred; C more than
5 capitals A-Z in a hundred characters; D any of ``#$%&*|``; E text equal to that of a smaller id anywhere in the table.

Defined results: a null text counts as empty, a null part as an empty string; rows without id never fail E and are no reason to;
rows that share an id are counted row by row and don't make each other fail E; labels of an id are read by their maximum, missing
or null ones count as 0; an empty table gives an empty result; other columns are not read. Texts are judged whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrain.llm.common import cut_lineage, hinted, row_batches, stored

FILTERS = "ABCDE"
BATCH_BYTES = 8 << 20
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"


def failures(raw: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    chars = len(raw) if raw.isascii() else len(raw.decode())
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * chars) << 2 | (len(raw.translate(None, SIGNS)) < len(raw)) << 3


def judged(docs: DataFrame) -> DataFrame:
    """(id, part, mask, digest) of rows (id, part, text): failures of A to D and the text's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, "text", BATCH_BYTES):
            texts = [x or b"" for x in batch.column("text").to_pylist()]
            masks, digests = [failures(x) for x in texts], [hashlib.sha256(x).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])

    return docs.mapInArrow(run, "id bigint, part string, mask int, digest binary")


def survivors(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of the filters; ``cells`` has a row of counts for every mask, so has the result for every subset."""
    n = len(cells)
    masks = np.arange(n)
    failing = np.zeros(n, dtype=np.int64)  # active filters that a cell fails
    running = cells.sum(axis=0)
    out = np.zeros_like(cells)
    out[0] = running
    subset = 0
    for step in range(1, n):
        toggled = step & -step  # the Gray codes of step - 1 and step differ in this bit
        subset ^= toggled
        hit = (masks & toggled) != 0
        if subset & toggled:
            running = running - cells[hit & (failing == 0)].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            running = running + cells[hit & (failing == 0)].sum(axis=0)
        out[subset] = running
    return out


def steps(cells: np.ndarray, filters: str = FILTERS) -> list[tuple]:
    """Rows (filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part.

    ``cells``: for every mask the documents, those of good quality and the toxic ones."""
    left = survivors(cells)
    masks = np.arange(len(cells))
    rows, shapley = [], dict.fromkeys(filters, 0)
    for order in permutations(filters):
        subset = 0
        for step, name in enumerate(order, start=1):
            bit = 1 << filters.index(name)
            lost = left[subset] - left[subset | bit]
            subset |= bit
            failing = int(cells[(masks & bit) != 0, 0].sum())
            rows.append(["".join(order), step, int(left[subset][0]), int(lost[0]), failing - int(lost[0]), int(cells[bit, 0]), int(lost[1]), int(lost[2]), name])
            shapley[name] += int(lost[0])
    return [(*row[:-1], shapley[row[-1]]) for row in rows]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step."""
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), docs[text_col].cast("string").cast("binary").alias("text"))
    rows = stored(judged(rows), "audit-judged")
    repeated = cut_lineage(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    known = cut_lineage(labels.select(labels[id_col].cast("bigint").alias("id"), labels["quality"].alias("q"), labels["toxic"].alias("t")).where("id IS NOT NULL").groupBy("id").agg(F.max(F.col("q") == 1).alias("good"), F.max(F.col("t") == 1).alias("toxic")))
    known = known.where("good OR toxic")
    joined = rows.join(hinted(repeated, repeated.count()), "digest", "left").join(hinted(known, known.count()), "id", "left")
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    cells = joined.groupBy("part", (F.col("mask") + later * 16).alias("mask")).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                cells = np.zeros((1 << len(FILTERS), 3), dtype=np.int64)
                for cell in own:
                    cells[cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                found = list(zip(*steps(cells)))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(found[0]), pa.string()), *(pa.array(x) for x in found)], names)

    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return parts.mapInArrow(run, "part string, filter_order string, step bigint, " + ", ".join(f"{c} bigint" for c in names[3:])).withColumn("step", F.col("step").cast("int"))

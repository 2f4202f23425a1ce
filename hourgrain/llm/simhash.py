"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 * half`` bits have a value in common among those within ``half`` bits of
each. So every distinct fingerprint emits its ball of radius ``half``, the variants are shuffled, and whatever meets on
one variant is verified. A variant meets at most as many distinct fingerprints as its own ball has, which bounds every group
(65 for ``half=1``); within a group all links run to the fingerprint of the smallest document, since all of them are within
``2 * half`` bits of each other, so the links of a group are as many as its members and lose no connection.
Documents with one fingerprint are one node from the start, however many there are.

Defined results: a null or wordless text has fingerprint zero and links like any other; rows that share an id are one
document; a null id gets its fingerprint and the component of the documents with ids that share it, null if there is none;
an empty table gives an empty result; other columns are not read. Texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrain.llm.common import components, cut_lineage

SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority bits of the shingles' XXH64, repeats counted; as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hash64 = xxhash.xxh64_intdigest
    return majority(np.array([hash64(g, SEED) for g in grams], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of ``hashes``, as a signed 64-bit integer; zero for none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    major = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(major.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of ``docs``."""

    @F.pandas_udf("long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(x, shingle) for x in batch], dtype="int64")

    return docs.select(docs[id_col].cast("bigint").alias("id"), prints(docs[text_col].cast("string")).alias("fp"))


def ball(half: int) -> list[int]:
    """All masks with at most ``half`` bits set, as signed 64-bit integers."""
    masks = [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, half: int) -> DataFrame:
    """Links (a, b) between the smallest documents of distinct fingerprints at most ``2 * half`` bits apart."""
    nodes = prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"))
    masks = F.array(*(F.lit(m) for m in ball(half)))
    variants = nodes.select("fp", "rep", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    first = F.min(F.struct("rep", "fp")).over(Window.partitionBy("variant"))
    met = variants.withColumn("first", first).where("first.fp != fp").select(F.col("first.rep").alias("a"), F.col("rep").alias("b"), F.col("first.fp").alias("fa"), F.col("fp").alias("fb")).distinct()
    return met.where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= 2 * half).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, half: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable by links)."""
    prints = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    linked = components(links(prints, half))
    reps = prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"))
    named = cut_lineage(
        reps.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = prints.join(named, prints["fp"] == named["fp_"], "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

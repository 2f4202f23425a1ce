"""Training-text pipeline over ``documents``: named stages, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept. Rows that share a doc_id are one document to the quality, near-duplicate
and decontamination stages: they stay or go together. A null doc_id counts as a document of its own name: the quality and
decontamination stages judge all rows without id together, the near-duplicate stage drops them if a document with an id has their
fingerprint. Further columns of ``documents``, whatever their names, are carried along. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrain.llm import bpe, decontaminate, near, quality, suffix
from hourgrain.llm.common import cut_lineage, hinted, stored, table
from hourgrain.llm.queries import trusted


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not among the one column of ``gone``, which is broadcast if its counted rows allow it."""
    gone = cut_lineage(gone.toDF("gone_id").distinct())
    return docs.join(hinted(gone, gone.count()), docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = quality.classify(docs, trusted(spark, sf_dir))
    return without(docs, judged.where("NOT accepted").select("doc_id"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a five-word Jaccard similarity of 0.8 or more, among pairs that SimHash fingerprints or MinHash bands
    propose, the one with the smallest id stays."""
    grouped = near.near_duplicates(docs)
    return without(docs, grouped.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under 100-byte strings that occur earlier go; a text that loses everything stays as an empty text."""
    names = docs.columns
    plain = docs.toDF(*(f"column_{i}" for i in range(len(names))))
    id_col, text_col = (f"column_{names.index(c)}" for c in ("doc_id", "text"))
    kept = suffix.remove_earlier(plain, id_col=id_col, text_col=text_col, carry=[c for c in plain.columns if c not in (id_col, text_col)])
    own = {text_col: F.col("kept_text")}
    if "n_chars" in names:
        own[f"column_{names.index('n_chars')}"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*(own.get(c, F.col(c)).alias(name) for c, name in zip(plain.columns, names)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a template window with a benchmark item go."""
    return without(docs, decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with the digests of the ids and of the decoded text."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("decoded")


STAGES = [("quality", quality_filter), ("simhash", near_dedup), ("suffix", repeat_removal), ("decontamination", decontamination), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every stage but the last is written below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

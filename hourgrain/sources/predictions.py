"""Union of the prediction tables of several model families, with the checks that guard scoring."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_families(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def prediction_checks(
    preds: DataFrame, expected: DataFrame, group: Sequence[str], row: Sequence[str], p: str, event: str
) -> DataFrame:
    """One row per model group: duplicates, rows missing from or foreign to the evaluation set,
    changed labels and probabilities outside [0, 1].

    The evaluation set is joined once to the united table, not once per group: a group's missing
    rows are the expected count minus its distinct matched rows.
    """
    want = expected.select(*row, F.col(event).alias("__label"), F.lit(True).alias("__known"))
    total = expected.count()
    per_row = preds.groupBy(*group, *row).agg(
        F.count("*").alias("__copies"), F.max(p).alias("__hi"), F.min(p).alias("__lo"),
        F.max(event).alias("__event"), F.count(p).alias("__finite"),
    )
    j = per_row.join(want, list(row), "left")
    out = j.groupBy(*group).agg(
        F.sum("__copies").alias("n_rows"),
        F.sum(F.col("__copies") - 1).alias("n_duplicates"),
        F.count_if(F.col("__known")).alias("__matched"),
        F.count_if(F.col("__known").isNull()).alias("n_foreign"),
        F.count_if(F.coalesce(F.col("__label") != F.col("__event"), F.lit(False))).alias("n_changed_labels"),
        F.count_if((F.col("__lo") < 0) | (F.col("__hi") > 1) | (F.col("__finite") < F.col("__copies"))).alias("n_bad_probability"),
    )
    return out.withColumn("n_missing", F.lit(total).cast("bigint") - F.col("__matched")).drop("__matched")


def group_count(preds: DataFrame, group: Sequence[str], expected: int) -> DataFrame:
    return preds.select(*group).distinct().agg(F.count("*").alias("n_groups")).withColumn(
        "complete", F.col("n_groups") == F.lit(expected)
    )

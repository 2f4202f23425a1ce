"""Registered queries: coverage of the inventory, and agreement with their SQL on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
INVENTORY = {"src": 11, "col": 11, "dq": 12, "spc": 18, "aln": 10, "coh": 14, "blk": 5, "agg": 6, "rnk": 5, "mdl": 17, "evl": 9, "bst": 8, "pip": 14}
SAMPLE = [
    "col02_utc_floor", "src04_target_two_layouts", "dq01_keep_last_by_time", "dq12_representation_contract", "spc05_regrid", "aln04_six_hour_blocks",
    "coh06_block_partitions", "blk02_labels", "rnk03_within_month", "evl04_average_precision", "bst03_epoch_weeks", "mdl03_ridge",
]


def test_every_inventory_id_has_a_query():
    names = entry.queries()
    for prefix, n in INVENTORY.items():
        have = {int(m.group(1)) for m in (re.match(rf"{prefix}(\d+)_", q) for q in names) if m}
        assert have == set(range(1, n + 1)) - ({8} if prefix == "src" else set()), prefix  # SRC8 only lists files: no table to query


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = connect(SF).execute(entry.oracle_sql()[name]).df()
    assert compare(got, want).startswith("ok")

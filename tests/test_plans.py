"""Physical-plan checks: no nested-loop or cartesian joins, no row-at-a-time
Python, and the qualified filters reach the parquet scan."""

from __future__ import annotations

import os
import re
import tempfile

import pytest

import __spark_entry__ as entry
from boxlens.plans import REPORTS
from boxlens.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    """The formatted physical plan (untruncated filter lists)."""
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted"
    )


@pytest.mark.parametrize("name", sorted(entry.PARAMS))
def test_no_bad_operators(spark, name):
    text = plan_text(entry.queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in text
    assert "CartesianProduct" not in text
    assert "BatchEvalPython" not in text  # only Arrow-batched UDFs are allowed


@pytest.fixture(scope="module")
def materialised(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="boxlens-plan-"), "tables")
    Tables.from_tpch(spark, SF).write(root)
    return Tables.from_parquet(spark, root)


def test_filters_pushed_to_scan(spark, materialised):
    p = entry.PARAMS["q09"]
    text = plan_text(REPORTS["q09"](materialised, p))
    assert "PushedFilters" in text
    assert "PartitionFilters: [isnotnull(week" in text and "StartsWith(week#" in text
    assert "In(dc" in text
    assert "Not(EqualTo(customer_id,-1))" in text


def test_column_pruning(spark, materialised):
    text = plan_text(REPORTS["q14"](materialised, entry.PARAMS["q14"]))
    schemas = [line for line in text.splitlines() if line.strip().startswith("ReadSchema")]
    assert schemas and all("shift" not in s and "courier" not in s and "sku_name" not in s for s in schemas)


def test_retention_reads_a_bitmap_per_customer(spark, materialised):
    """Q07 and Q15 read the boxes once and keep a customer's weeks as one long:
    no join of start weeks with box rows or (customer, week) pairs."""
    for name in ("q07", "q15"):
        text = plan_text(REPORTS[name](materialised, entry.PARAMS[name]))
        assert "bit_or" in text and "week_no" not in text
        scans = [blk for blk in text.split("\n\n") if "Scan parquet" in blk and "/boxes" in blk]
        assert len(scans) == 1, name


def test_error_year_prunes_partitions(spark, materialised):
    text = plan_text(REPORTS["q14"](materialised, entry.PARAMS["q14"]))
    assert "PartitionFilters: [isnotnull(error_year" in text and "(error_year#" in text


def test_materialised_tables_round_trip(spark, materialised):
    fresh = Tables.from_tpch(spark, SF)
    for name in ("boxes", "errors", "picks", "date_dim"):
        a, b = getattr(fresh, name), getattr(materialised, name)
        assert a.columns == b.columns
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_q12_prunes_picks_to_the_year(spark, materialised):
    """The start-week window reaches the picks scan through the join keys:
    only the analysis year's week directories of the largest table are read."""
    text = plan_text(REPORTS["q12"](materialised, entry.PARAMS["q12"]))
    picks_scans = [blk for blk in text.split("\n\n") if "Scan parquet" in blk and "/picks" in blk]
    assert picks_scans
    assert all(re.search(r"PartitionFilters: \[.*\(week#\d+ >= 1995-W01\)", blk) for blk in picks_scans)

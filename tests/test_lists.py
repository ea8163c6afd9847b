"""Distinct lists and pivots over labels found in the data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from boxlens.functions.weeks import quarter
from boxlens.operators.lists import distinct_list, labels_of, pivot_sums


def test_distinct_list_sorts_joins_and_skips_nulls(spark):
    rows = [("a", "H2"), ("a", "H1"), ("a", "H2"), ("a", None), ("b", None), ("c", "\u00e9"), ("c", "z"), ("c", ""), (None, "x")]
    rows += [("hot", f"L{i % 30:02d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v string").repartition(7)
    got = {r.g: r.v for r in df.groupBy("g").agg(distinct_list("v").alias("v")).collect()}
    assert got == {"a": "H1,H2", "b": "", "c": ",z,\u00e9", None: "x", "hot": ",".join(f"L{i:02d}" for i in range(30))}
    numbers = spark.createDataFrame([(1, 10), (1, 9)], "g int, v int")
    assert numbers.groupBy("g").agg(distinct_list(F.col("v"), "|").alias("v")).first().v == "10|9"  # as text


def test_quarters(spark):
    weeks = ["2023-W01", "2023-W13", "2023-W14", "2023-W39", "2023-W40", "2023-W52", "2020-W53", None, "bad"]
    df = spark.createDataFrame([(w,) for w in weeks], "w string")
    assert [r[0] for r in df.select(quarter("w")).collect()] == ["Q1", "Q1", "Q2", "Q3", "Q4", "Q4", "Q4", None, None]


def test_pivot_over_open_labels(spark):
    rows = [("d1", "Team A", 1), ("d1", "Team A", 2), ("d1", "b`c", 5), ("d2", None, 7), (None, "z", 9)]
    df = spark.createDataFrame(rows, "dc string, team string, v int")
    assert labels_of(df, "team") == ["Team A", "b`c", "z"]
    got = {r[0]: tuple(r)[1:] for r in pivot_sums(df, ["dc"], "team", F.col("v")).collect()}
    assert got == {"d1": (3, 5, 0), "d2": (0, 0, 0), None: (0, 0, 9)}
    assert pivot_sums(df.where("team is null"), ["dc"], "team", F.col("v")).columns == ["dc"]
    with pytest.raises(ValueError):
        pivot_sums(df, ["dc"], "team", F.col("v"), most=2)

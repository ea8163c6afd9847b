"""Several exact distinct counts per group in one pass."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from boxlens.operators.cohorts import half_box_counts
from boxlens.operators.distinct import distinct_counts
from boxlens.params import AnalysisParams

SCHEMA = "k string, j int, item string, box string, team string, v int"
COUNTS = {
    "items_a": ("item", "A"), "items_b": ("item", "B"), "items": ("item", None),
    "boxes": ("box", None), "boxes_a": ("box", "A"),
}


def _asked():
    return {n: (c, None if t is None else F.col("team") == t) for n, (c, t) in COUNTS.items()}


def _brute(rows, keys):
    """Sets of values held group by group."""
    out = {}
    for row in rows:
        r = dict(zip(("k", "j", "item", "box", "team", "v"), row))
        sets, total = out.setdefault(tuple(r[k] for k in keys), ({n: set() for n in COUNTS}, []))
        for n, (c, team) in COUNTS.items():
            if r[c] is not None and (team is None or r["team"] == team):
                sets[n].add(r[c])
        if r["v"] is not None:
            total.append(r["v"])
    return {g: (*(len(s[n]) for n in COUNTS), sum(t) if t else None) for g, (s, t) in out.items()}


def _rows(seed, n, hot=0.33):
    r = random.Random(seed)
    pick = lambda *v: r.choice(v)
    return [(
        "hot" if r.random() < hot else pick("a", "b", "c", None), pick(1, 2, None),
        pick(None, *[f"i{x}" for x in range(40)]), pick(None, *[f"b{x}" for x in range(9)]),
        pick("A", "B", "C", None), pick(None, 1, 5, -3),
    ) for _ in range(n)]


@pytest.mark.parametrize("keys", [["k"], ["k", "j"], []])
def test_equals_sets_with_nulls_and_repeats(spark, keys):
    rows = _rows(len(keys), 900)
    rows += rows[:100] + [("lone", 7, None, None, None, None), ("unboxed", 7, "i1", None, "A", 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = distinct_counts(df, keys, _asked(), {"total": F.col("v")})
    assert got.columns == [*keys, *COUNTS, "total"]
    assert {tuple(r)[:len(keys)]: tuple(r)[len(keys):] for r in got.collect()} == _brute(rows, keys)


def test_empty_input_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert distinct_counts(empty, ["k"], _asked()).collect() == []
    assert tuple(distinct_counts(empty, [], _asked(), {"total": F.col("v")}).first()) == (0, 0, 0, 0, 0, None)
    named = spark.createDataFrame([("x", "p", 1), ("x", "q", 2), ("x", "q", 3)], "__k0 string, __v string, __d0 int")
    got = distinct_counts(named, ["__k0"], {"__v": ("__v", None), "n": ("__d0", F.col("__d0") > 1)}, {"s": F.col("__d0")})
    assert [tuple(r) for r in got.collect()] == [("x", 2, 2, 6)]
    with pytest.raises(ValueError):
        distinct_counts(named, ["__k0"], {})


def test_plan_copies_no_rows_and_shares_the_last_exchange(spark):
    df = spark.createDataFrame(_rows(5, 50), SCHEMA)
    plan = distinct_counts(df, ["k"], _asked())._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 3  # (k, item), (k, box), k


def test_half_counts_leave_out_null_boxes_and_weeks(spark):
    p = AnalysisParams(year="2023")
    rows = [("c", "b1", "2023-W01"), ("c", "b1", "2023-W50"), ("c", "b1", "2023-W50"), ("c", "b2", "2023-W51"),
            ("c", None, "2023-W02"), ("d", None, "2023-W02"), (None, "b3", "2023-W02")]
    df = spark.createDataFrame(rows, "customer_id string, box_id string, week string")
    got = {r.customer_id: (r.h1_count, r.h2_count) for r in half_box_counts(df, p).collect()}
    assert got == {"c": (1, 2), None: (1, 0)}

"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; root: smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones,
    under the smallest neighbour, so that trees flatten in a logarithmic number
    of rounds. A node's neighbourhood is aggregated to its minimum before it is
    joined back; no list of neighbours is built. Each round's edges are a
    written table. Loops and null ends are ignored; an empty table gives none.
    """
    e = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-0")
    for k in range(MAX_ROUNDS):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("m", "u").alias("m"))
        # large star: neighbours above a node move under its minimum
        large = e.join(low, e["v"] == low["x"]).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its lower neighbours move under its minimum
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        new = written(small, f"cc-{k + 1}")
        roots = new.select(F.col("v").alias("u")).distinct()
        if new.join(roots, "u", "left_semi").isEmpty() and _single_parent(new):
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
        e = new
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _single_parent(e: DataFrame) -> bool:
    return e.groupBy("u").count().where("count > 1").isEmpty()

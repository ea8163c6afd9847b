"""Approximate nearest neighbours: a forest of random-projection trees.

The trees' hyperplanes are fitted on a bounded sample of the vectors; every
vector is then sent down every tree. A query searches all trees through one
shared priority queue: the open node whose cell is nearest (by the squared
margins of the cuts on which the query lies on the other side) comes next,
whichever tree it belongs to, until the leaves reached hold as many vectors as
``SEARCH_SHARE`` of all, counted over all trees, at every size of the table.
(Vectors without structure need such a share for a recall of 0.9, small tables
more than large ones; clustered ones do with less, so it is a parameter.) All vectors of those leaves are compared, leaf by
leaf where they lie: a (tree, leaf, salt) group meets the queries that probe it,
and only each query's best few leave it, to be reranked by exact cosines of the
original vectors in double precision.

Equal vectors are searched once: they share their neighbours, and only the
smallest ids of a vector can be among anyone's nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import written

SAMPLE = 20_000
TREES = 24
LEAF = 25  # sampled vectors a leaf holds at most
SEARCH_SHARE = 0.9
GROUP_ROWS = 20_000  # vectors of a leaf compared in one group
SEED = 11


@dataclass
class Tree:
    normal: np.ndarray  # (nodes, dim)
    offset: np.ndarray
    child: np.ndarray  # (nodes, 2); negative: leaf -1 - id
    held: np.ndarray  # sampled vectors of each leaf


def grow(x: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Tree:
    """A tree whose nodes cut between two random points, at the median."""
    normal, offset, child, held = [], [], [], []

    def place(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            a, b = x[rng.choice(rows, 2, replace=False)]
            n = a - b
            size = float(np.linalg.norm(n))
            if size > 0:
                n = n / size
                side = x[rows] @ n
                cut = float(np.median(side))
                right = side > cut
                if right.any() and not right.all():
                    me = len(normal)
                    normal.append(n), offset.append(cut), child.append([0, 0])
                    child[me][0] = place(rows[~right])
                    child[me][1] = place(rows[right])
                    return me
        held.append(len(rows))
        return -len(held)

    root = place(np.arange(len(x)))
    if root < 0:  # a single leaf still gets a node, with both sides the same
        normal.append(np.zeros(x.shape[1])), offset.append(0.0), child.append([root, root])
    return Tree(np.array(normal), np.array(offset), np.array(child), np.array(held))


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    while len(live):
        node = at[live]
        right = np.einsum("ij,ij->i", x[live], tree.normal[node]) > tree.offset[node]
        at[live] = tree.child[node, right.astype(int)]
        live = live[at[live] >= 0]
    return -1 - at


def search(forest: list[Tree], q: np.ndarray, want: float) -> list[tuple[int, int]]:
    """``(tree, leaf)`` to probe for one query, best first, over all trees."""
    sides = [t.normal @ q - t.offset for t in forest]
    queue = [(0.0, k, 0) for k in range(len(forest))]
    out: list[tuple[int, int]] = []
    seen = 0
    while queue and seen < want:
        margin, k, node = heapq.heappop(queue)
        tree = forest[k]
        while node >= 0:
            side = sides[k][node]
            near, far = (1, 0) if side > 0 else (0, 1)
            if tree.child[node, 0] != tree.child[node, 1]:
                heapq.heappush(queue, (margin + side * side, k, int(tree.child[node, far])))
            node = int(tree.child[node, near])
        out.append((k, -1 - node))
        seen += int(tree.held[-1 - node])
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # first, so that squares cannot overflow
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _floats(x: np.ndarray) -> pa.Array:
    """Unit vectors as float lists: enough for a shortlist, half the shuffle."""
    return pa.ListArray.from_arrays(
        pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.astype(np.float32).ravel()))


def _place_all(batches: Iterator[pa.RecordBatch], forest: list[Tree], salts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _unit(_matrix(batch.column(1)))
        sent = _floats(x)
        vid = batch.column(0).to_numpy(zero_copy_only=False)
        salt = (vid * 0x9E3779B1 >> 7) % salts
        for k, tree in enumerate(forest):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), k), pa.int32()), pa.array(leaves_of(tree, x).astype(np.int32)),
                 pa.array(salt.astype(np.int32)), batch.column(0), sent],
                names=["tree", "leaf", "salt", "vec", "v"])


def _probe_all(batches: Iterator[pa.RecordBatch], forest: list[Tree], salts: int, want: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _unit(_matrix(batch.column(1)))
        sent = _floats(x)
        for lo in range(0, len(x), 256):
            trees, leaves, rows = [], [], []
            for i in range(lo, min(lo + 256, len(x))):
                for k, leaf in search(forest, x[i], want):
                    trees.append(k), leaves.append(leaf), rows.append(i)
            at = np.repeat(np.array(rows), salts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(trees, salts), pa.int32()), pa.array(np.repeat(leaves, salts), pa.int32()),
                 pa.array(np.tile(np.arange(salts), len(rows)), pa.int32()),
                 batch.column(0).take(pa.array(at)), sent.take(pa.array(at))],
                names=["tree", "leaf", "salt", "query", "q"])


def _rerank(rows: pd.DataFrame, probes: pd.DataFrame, keep: int) -> pd.DataFrame:
    if not len(rows) or not len(probes):
        return pd.DataFrame({"query": pd.Series(dtype="int64"), "vec": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    rows = rows.sort_values("vec")
    x, ids = _unit(np.stack(rows["v"].to_numpy()).astype(np.float64)), rows["vec"].to_numpy()
    out = []
    for lo in range(0, len(probes), 512):
        part = probes.iloc[lo:lo + 512]
        q = _unit(np.stack(part["q"].to_numpy()).astype(np.float64))
        scores = q @ x.T
        n = min(keep, len(ids))
        # the n-th best score and whatever ties with it, so that ties go by id
        edge = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
        at, col = np.nonzero(scores >= edge[:, None] - 1e-6)
        out.append(pd.DataFrame({"query": part["query"].to_numpy()[at], "vec": ids[col], "score": scores[at, col]}))
    return pd.concat(out).sort_values(["query", "score", "vec"], ascending=[True, False, True], kind="stable").groupby("query", sort=False).head(keep)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding",
            trees: int = TREES, share: float = SEARCH_SHARE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each query.

    ``queries (id_col)`` names rows of ``vectors``; a query never finds its own
    id. Score: cosine of the original vectors in double precision, ties to the
    smaller id. Vectors that are null, empty, zero, of another length than the
    most frequent one, or that hold null or non-finite components take no
    part. Rows that repeat an id and vector count once; an id with several
    vectors is a candidate with each (the best counts). Other columns are
    ignored; no vectors give no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        "id is not null and v is not null and size(v) > 0 and "
        "forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(v, c -> c <> 0)")
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == lengths["dim"])
    wanted = queries.select(F.col(id_col).cast("long").alias("qid")).distinct()

    # one row per distinct vector: its k + 1 smallest ids, found without a list of all
    firsts = (rows.selectExpr("id", "v", "row_number() over (partition by v order by id) as r").where(F.col("r") <= k + 1)
              .groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    distinct = written(firsts.select(F.col("ids")[0].alias("vec"), "v", "ids"), "ann-vectors")
    asked = written(
        rows.join(wanted, F.col("id") == F.col("qid"), "left_semi").select("id", "v")
        .join(distinct.select(F.col("vec").alias("query"), F.col("v").alias("dv")), F.col("v") == F.col("dv"))
        .select("id", "query").distinct(), "ann-asked")

    n = distinct.count()
    sample = distinct.select("v").orderBy(F.xxhash64("vec", F.lit(SEED)), "vec").limit(SAMPLE).toArrow()
    x = _unit(_matrix(sample.column(0).combine_chunks()))
    rng = np.random.default_rng(SEED)
    forest = [grow(x, rng) for _ in range(trees)]
    want = min(share, trees) * len(x)
    salts = max(1, ceil(n / len(x) * LEAF / GROUP_ROWS))
    sent = spark.sparkContext.broadcast(forest)

    placed = distinct.select("vec", "v").mapInArrow(
        lambda it: _place_all(it, sent.value, salts), "tree int, leaf int, salt int, vec bigint, v array<float>")
    probes = (distinct.join(asked.select(F.col("query").alias("vec")).distinct(), "vec", "left_semi").select("vec", "v")
              .repartition(max(spark.sparkContext.defaultParallelism, 8))
              .mapInArrow(lambda it: _probe_all(it, sent.value, salts, want), "tree int, leaf int, salt int, query bigint, q array<float>"))
    best = (placed.groupBy("tree", "leaf", "salt").cogroup(probes.groupBy("tree", "leaf", "salt"))
            .applyInPandas(lambda a, b: _rerank(a, b, k + 6), "query bigint, vec bigint, score double"))
    found = written(
        best.groupBy("query", "vec").agg(F.max("score").alias("score"))
        .selectExpr("*", "row_number() over (partition by query order by score desc, vec) as r").where(F.col("r") <= k + 6)
        .select("query", "vec"), "ann-found")

    # exact scores in one fixed order of summation, and the ids behind each vector
    f = found.join(distinct.select("vec", "v", "ids"), "vec").join(distinct.select(F.col("vec").alias("query"), F.col("v").alias("q")), "query")
    dot = "aggregate(zip_with(v, q, (a, b) -> a * b), 0D, (s, e) -> s + e)"
    size = "sqrt(aggregate({0}, 0D, (s, e) -> s + e * e))"
    scored = f.selectExpr("query", "ids", f"{dot} / ({size.format('v')} * {size.format('q')}) as score")
    return (scored.join(asked.select(F.col("id").alias("query_id"), "query"), "query")
            .select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .selectExpr("query_id", "cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank",
                        "vec_id", "score").where(F.col("rank") <= k))

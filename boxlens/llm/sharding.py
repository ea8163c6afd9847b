"""Byte-balanced sharding by histogram sort.

Rows are ordered by a 64-bit key: 40 bits hashed from the text, 24 from the
``doc_id``, so equal texts lie together and yet a text that a third of all rows
share can be divided. Splitters between shards are found as in histogram sort:
a round counts the exact bytes below candidate boundaries over all partitions
(a grouped sum, pre-aggregated per task) and the next round probes only inside
the interval that holds a splitter, until every splitter meets the tolerance.
Then rows are exchanged once, by (shard, leading key bits), and numbered.

A group of equal texts stays in one shard unless it is heavier than
``GROUP_SHARE`` of a shard; a heavier one may be divided between rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import written

LEVELS = (52, 40, 24, 12, 0)  # key bits left below each round's probes
TEXT_LEVEL = 24
GROUP_SHARE = 0.01
BIAS = 1 << 63


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, key)``: size is the text's UTF-8 bytes plus
    one (null text: one), key the unsigned sort key, as a signed long in order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of_text = F.xxhash64(text).bitwiseAND(F.lit(-1 << TEXT_LEVEL))
    of_id = F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)).bitwiseAND(F.lit((1 << TEXT_LEVEL) - 1))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        of_text.bitwiseOR(of_id).alias("key"))


def _bin(key, shift: int):
    return key.bitwiseAND(F.lit(-1 << shift))


def find_splitters(rows: DataFrame, shards: int, share: float = GROUP_SHARE) -> list[int]:
    """The keys at which shards 1, 2, .. begin (as signed longs, in order).

    A round's histogram has at most 4,096 bins for each of the ``shards - 1``
    open splitters and is all that reaches the driver.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    last = (1 << 63) - 1
    if not total or shards < 2:
        return [last] * (shards - 1)
    targets = [total * k / shards for k in range(1, shards)]
    found: dict[int, int] = {}
    # open interval of each splitter: (key it begins at, bytes below it)
    spans: dict[int, tuple[int, int] | None] = dict.fromkeys(range(shards - 1))
    width = 64
    for shift in LEVELS:
        inside = sorted({s[0] for s in spans.values() if s})
        part = rows
        if width < 64:
            part = rows.where(_bin(F.col("key"), width).isin(inside))
        bins = [(r[0], r[1]) for r in part.groupBy(_bin(F.col("key"), shift).alias("b"))
                .agg(F.sum("size").alias("s")).orderBy("b").collect()]
        for k, span in list(spans.items()):
            low, below = span or (-BIAS, 0)
            mine = [b for b in bins if width == 64 or (b[0] & (-1 << width)) == low]
            for at, size in mine:
                if below + size < targets[k]:
                    below += size
                    continue
                # the bin that holds the target; groups and rows go by their middle
                whole = shift == 0 or (shift == TEXT_LEVEL and size <= share * total / shards)
                if whole or below + size == targets[k]:
                    found[k] = at if below + size / 2 >= targets[k] and below + size != targets[k] else at + (1 << shift)
                    del spans[k]
                else:
                    spans[k] = (at, below)
                break
        if not spans:
            break
        width = shift
    return [min(found[k], last) for k in range(shards - 1)]


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of all rows.

    ``law`` is ``bytes``: shards are near equal in bytes. ``slot`` numbers the
    rows of a shard from 0 without gaps, in key order. Null and empty texts
    have size 1; rows that repeat everything get a slot each; a null ``doc_id``
    is a value like others. Other columns are ignored. An empty table gives
    none.
    """
    rows = written(sized(docs), "shard-rows")
    splitters = find_splitters(rows, shards)
    shard = sum((F.when(F.col("key") >= F.lit(s), 1).otherwise(0) for s in splitters), F.lit(0))
    if any(s == (1 << 63) - 1 for s in splitters):  # no row lies at or above such a splitter
        shard = sum((F.when(F.col("key") >= F.lit(s), 1).otherwise(0) for s in splitters if s < (1 << 63) - 1), F.lit(0))
    rows = rows.withColumn("shard", shard.cast("int"))
    # runs of leading key bits, about 32,000 rows each, so that no task sorts a whole shard
    n = rows.count()
    bits = 6
    while n >> bits > 32_768 and bits < 40:
        bits += 1
    rows = rows.withColumn("run", F.shiftright(F.col("key"), 64 - bits))
    # a heavy text fills a run alone: its rows are parted by the doc_id bits too
    runs = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("c"))
    heavy = [(r["shard"], r["run"]) for r in runs.where(F.col("c") > 4 * max(32_768, n >> bits)).collect()]
    part = F.lit(0).cast("long")
    if heavy:
        is_heavy = F.struct("shard", "run").isin([F.struct(F.lit(s), F.lit(r).cast("long")) for s, r in heavy])
        part = F.when(is_heavy, F.shiftright(F.col("key"), 12)).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("shard", "run", "part").agg(F.count(F.lit(1)).alias("c"))
    starts = counts.selectExpr(
        "shard as s", "run as r", "part as p",
        "coalesce(sum(c) over (partition by shard order by run, part rows between unbounded preceding and 1 preceding), 0) as start")
    numbered = rows.selectExpr(
        "*", "row_number() over (partition by shard, run, part order by key, doc_id, text_crc32, size) as k")
    return (numbered.join(starts, (F.col("shard") == F.col("s")) & (F.col("run") == F.col("r")) & (F.col("part") == F.col("p")))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("k") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))

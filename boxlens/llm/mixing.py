"""Temperature mixing of sources, in DataFrame functions only.

A source's weight is its token share raised to an exponent and normalised. The
exponent is bisected (several probes a round, one small aggregation each) until
the weights meet a target entropy or until no source is repeated more often than
a limit allows. The weights then become exact token budgets: each source is
read in a fixed random permutation, full epochs first, then the permutation's
beginning up to the budget. The mixture is emitted as ``mix_blocks`` blocks, and
each block takes its budgeted share of every source, so that every block has
the target weights but for a hash block's tokens.

The permutation orders a source by a hash of ``doc_id``. Places in it are sums
over ``2 ** (BITS_1 + BITS_2)`` hash blocks a source, taken in two steps; the
place where a budget ends is found in them and one ranking inside the last,
small block. A source with a third of all rows is never sorted or summed in one
task.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import apart, written

SEED = 17
PROBES = 32
ROUNDS = 6
BITS_1, BITS_2 = 8, 12  # of the hash blocks
MIX_BLOCKS = 64
WORD = r"[^\x20\x09-\x0D]+"


def _tokens() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _group() -> Column:
    """The source as a never-null key (a null source is a source of its own)."""
    return F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("n"))


def _place() -> Column:
    return F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"))


def _hash_block(bits: int) -> Column:
    return F.shiftright("u", 64 - bits)


def _order(prefix: str = "") -> Column:
    """The order of a source's permutation; rows equal in it go together."""
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("u", "id", "tokens")])


def find_exponent(sources: DataFrame, budget: float | None, entropy: float | None, repeats: float | None) -> float:
    """The exponent in [0, 1] for sources ``(total)``; exactly one target is set.

    ``entropy`` is a share of the largest possible entropy, ln(number of
    sources): the exponent at which the weights reach it (0 or 1 if outside).
    ``repeats``: the smallest exponent at which no source is read more than so
    many times under ``budget`` tokens (None: as many as give each source one
    full reading); 1 if none does. Only sources with tokens count.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("set either entropy or repeats")
    live = sources.where("total > 0")
    n, largest = live.agg(F.count(F.lit(1)), F.max("total")).first()
    if n < 2:
        return 1.0
    lo, hi = 0.0, 1.0

    def met(row) -> bool:
        # both goals fall as the exponent grows
        if entropy is not None:
            return log(row["z"]) - row["plogp"] / row["z"] <= entropy * log(n)
        if budget is None:
            return row["most"] / row["least"] <= repeats
        return budget * row["most"] / row["z"] <= repeats

    for _ in range(ROUNDS):
        step = (hi - lo) / (PROBES - 1)
        probes = [lo + k * step for k in range(PROBES)]
        p = F.pow(F.col("total") / F.lit(float(largest)), F.col("a"))
        rows = (live.select("total", F.explode(F.array(*[F.lit(a) for a in probes])).alias("a")).withColumn("p", p)
                .groupBy("a").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("plogp"),
                                  F.max(F.col("p") / F.col("total")).alias("most"),
                                  F.min(F.col("p") / F.col("total")).alias("least"))
                .orderBy("a").collect())
        first = next((k for k, r in enumerate(rows) if met(r)), None)
        if first is None:
            return 1.0
        if first == 0:
            return rows[0]["a"]
        lo, hi = rows[first - 1]["a"], rows[first]["a"]
    return hi


def plan_mix(docs: DataFrame, *, entropy: float | None = None, repeats: float | None = None,
             budget: int | str = "total") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables of a mixture: ``rows``, ``sources`` and ``blocks``.

    ``budget``: tokens of the mixture; ``total`` for as many as there are, or
    ``cover`` for the least that reads every source once in full.
    ``rows (g, id, tokens, u)``; ``sources (g, total, weight, budget, full,
    cut)``: each row is read ``full`` times, and once more if its order is at
    most ``cut``; ``blocks (g, b1, below)``: tokens before each hash block.
    """
    rows = written(docs.select(_group().alias("g"), F.col("doc_id").cast("long").alias("id"),
                               _tokens().alias("tokens"), _place().alias("u"), F.col("source").cast("string").alias("source")),
                   "mix-rows")
    b1, b2 = _hash_block(BITS_1), _hash_block(BITS_1 + BITS_2)
    blocks = written(
        rows.groupBy("g", b1.alias("b1")).agg(F.sum("tokens").alias("t"))
        .selectExpr("g", "b1", "t", "sum(t) over (partition by g order by b1) - t as below"), "mix-blocks")
    sources = written(blocks.groupBy("g").agg(F.sum("t").alias("total")), "mix-totals")
    everything = sources.agg(F.sum("total")).first()[0] or 0
    cover = budget == "cover"
    goal = float(everything if budget in ("total", "cover") else budget)
    a = find_exponent(sources, None if cover else goal, entropy, repeats)
    largest = float(sources.agg(F.max("total")).first()[0] or 1) or 1.0
    p = F.when(F.col("total") > 0, F.pow(F.col("total") / F.lit(largest), F.lit(a))).otherwise(F.lit(0.0))
    sums = sources.agg(F.sum(p), F.max(F.when(F.col("total") > 0, F.col("total") / p))).first()
    z = sums[0] or 1.0
    if cover:
        goal = (sums[1] or 0.0) * z
    planned = F.floor(p / F.lit(z) * F.lit(goal)).cast("long")
    sources = sources.select("g", "total", (p / F.lit(z)).alias("weight"),
                             (F.greatest(planned, F.col("total")) if cover else planned).alias("budget"))
    sources = sources.withColumn("full", F.when(F.col("total") > 0, F.expr("budget div total")).otherwise(F.lit(1).cast("long")))
    sources = written(sources.withColumn("rest", F.col("budget") - F.col("full") * F.col("total")), "mix-sources")

    # where the last, partial epoch ends: block, block inside it, then rows
    ends = (blocks.join(sources, "g").where("rest > 0 and below < rest and rest <= below + t")
            .select("g", F.col("b1").alias("e1"), "rest", "below"))
    inner = rows.withColumn("b1", b1).withColumn("b2", b2)
    inner = inner.join(ends.withColumnRenamed("g", "eg"), (F.col("g") == F.col("eg")) & (F.col("b1") == F.col("e1")))
    second = (inner.groupBy("g", "b2", "rest", "below").agg(F.sum("tokens").alias("t"))
              .selectExpr("g", "b2 as e2", "rest", "t", "below + sum(t) over (partition by g order by b2) - t as low")
              .where("low < rest and rest <= low + t").select(F.col("g").alias("sg"), "e2", "low"))
    last = (inner.join(second, (F.col("g") == F.col("sg")) & (F.col("b2") == F.col("e2")))
            .withColumn("o", _order())
            # range frame: rows equal in the order share one place
            .selectExpr("g", "rest", "o", "low + sum(tokens) over (partition by g order by u, id, tokens) as upto",
                        "sum(tokens) over (partition by g, u, id, tokens) as own")
            .where("upto - own < rest").groupBy("g").agg(F.max("o").alias("cut")))
    sources = written(sources.join(last, "g", "left").select("g", "total", "weight", "budget", "full", "cut"), "mix-plan")
    return rows, sources, blocks


def _places(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(g, b2, low)``: the tokens of its source before each small hash block."""
    small = (rows.groupBy("g", _hash_block(BITS_1).alias("b1"), _hash_block(BITS_1 + BITS_2).alias("b2"))
             .agg(F.sum("tokens").alias("t"))
             .selectExpr("g", "b1", "b2", "sum(t) over (partition by g, b1 order by b2) - t as inside"))
    return small.join(blocks.select("g", "b1", "below"), ["g", "b1"]).selectExpr("g", "b2", "below + inside as low")


def _copies(prefix: str = "") -> Column:
    more = F.col("cut").isNotNull() & (_order(prefix) <= F.col("cut"))
    return F.col("full") + F.when(more, 1).otherwise(0)


def mixture(docs: DataFrame, *, entropy: float | None = None, repeats: float | None = None,
            budget: int | str = "total", mix_blocks: int = MIX_BLOCKS) -> DataFrame:
    """``(doc_id, source, tokens, weight, epoch, mix_block, order_key)``: a row for
    each time a row of ``docs (doc_id, text, source, ..)`` is read.

    Tokens are words; a null or empty text has none. A source without tokens
    has weight 0 and its rows are read once, in block 0. Rows equal in
    ``doc_id`` and tokens share one place in the permutation and are taken
    together. A null source is a source of its own; other columns are ignored;
    an empty table gives none. Blocks are read in the order of ``mix_block``,
    rows inside a block in that of ``order_key``.
    """
    rows, sources, blocks = plan_mix(docs, entropy=entropy, repeats=repeats, budget=budget)
    read = (rows.withColumn("b2", _hash_block(BITS_1 + BITS_2)).join(sources, "g").join(_places(rows, blocks), ["g", "b2"])
            .withColumn("copies", _copies()).where("copies > 0")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))))
    share = (F.col("epoch") * F.col("total") + F.col("low")) / F.greatest(F.col("budget"), F.lit(1))
    block = F.least(F.floor(share * mix_blocks), F.lit(mix_blocks - 1)).cast("int")
    return read.select(
        F.col("id").alias("doc_id"), "source", "tokens", "weight", F.col("epoch").cast("int").alias("epoch"),
        block.alias("mix_block"), F.xxhash64(F.lit(SEED + 1), "epoch", "u").alias("order_key"))


def mixed(docs: DataFrame, *, repeats: float, budget: int | str = "cover") -> DataFrame:
    """``docs``, each row as often as the mixture reads it, with its own columns,
    whatever their names."""
    _, sources, _ = plan_mix(docs, repeats=repeats, budget=budget)
    own = docs.columns
    g, place_id, tokens, u, of, full, cut, copies, again = apart(
        docs, "mix_g", "mix_id", "mix_tokens", "mix_u", "mix_of", "mix_full", "mix_cut", "mix_copies", "mix_again")
    tagged = docs.select(
        "*", _group().alias(g), F.col("doc_id").cast("long").alias(place_id), _tokens().alias(tokens), _place().alias(u))
    plan = sources.select(F.col("g").alias(of), F.col("full").alias(full), F.col("cut").alias(cut))
    order = F.struct(F.col(u).alias("u"), F.col(place_id).alias("id"), F.col(tokens).alias("tokens"))
    more = F.col(cut).isNotNull() & (order <= F.col(cut))
    return (tagged.join(plan, F.col(g) == F.col(of))
            .withColumn(copies, F.col(full) + F.when(more, 1).otherwise(0)).where(F.col(copies) > 0)
            .select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(again))
            .select(*own))

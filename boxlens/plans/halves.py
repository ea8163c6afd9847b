"""Half-year reports (Q02, Q05, Q09, Q16)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.functions.dc import normalise_dc
from boxlens.functions.weeks import half_year, quarter
from boxlens.operators.cohorts import half_box_counts, half_error_flags
from boxlens.operators.filters import qualified_boxes, qualified_errors
from boxlens.operators.lists import distinct_list
from boxlens.operators.sampling import matched_sample, sample_order, stratum_sizes
from boxlens.operators.selection import KEY, keys_at_ranks, with_order_key
from boxlens.params import AnalysisParams
from boxlens.session import freeze
from boxlens.sources.tables import Tables


# ---------------------------------------------------------------- Q02
def h1_h2_propensity(t: Tables, p: AnalysisParams, by_error_on: bool = False) -> DataFrame:
    """Q02: does an H1 error change the chance of reporting one in H2?
    Matched samples per box-count stratum, then per H1 flag: customers and
    customers with an H2 error. ``by_error_on`` (dormant variant D05) splits
    the rows by the label 'H1,H2' / 'H1' / 'H2' / 'None'."""
    counts = half_box_counts(qualified_boxes(t.boxes, p, year_prefix=True), p)
    flags = half_error_flags(qualified_errors(t.errors, p, capped=True), p)
    # one row per customer, read by the strata and by the pool
    base = freeze(counts.join(flags, "customer_id", "left"))
    # <= 26 x 26 strata: a proven broadcast bound.
    strata = stratum_sizes(base, ["h1_count", "h2_count"], p.max_half_boxes)
    pool = (
        base.join(F.broadcast(strata), ["h1_count", "h2_count"], "left")
        .select(
            "customer_id", "h1_count", "box_perm", "k",
            F.coalesce(F.col("h1_error"), F.lit(0)).alias("h1_error"),
            F.coalesce(F.col("h2_error"), F.lit(0)).alias("h2_error"),
        )
        .filter(F.col("k") > 0)  # k is per stratum here: empty samples need no rank
    )
    chosen = matched_sample(pool, ["box_perm", "h1_error"])
    keys = ["h1_error"]
    if by_error_on:
        h1, h2 = F.col("h1_error") == 1, F.col("h2_error") == 1
        chosen = chosen.withColumn(
            "error_on",
            F.when(h1 & h2, "H1,H2").when(h1, "H1").when(h2, "H2").otherwise("None"),
        )
        keys.append("error_on")
    per_stratum = chosen.groupBy("box_perm", *keys, "h1_count").agg(
        F.count(F.lit(1)).alias("customer_count"), F.sum("h2_error").alias("total_h2_errors")
    )
    return (
        per_stratum.groupBy(*keys)
        .agg(
            F.sum("customer_count").alias("customer_count"),
            F.sum("total_h2_errors").alias("h2_error_customers"),
        )
        .orderBy(*keys)
    )


# ---------------------------------------------------------------- Q05
def box_error_halves(t: Tables, p: AnalysisParams, part_of_year: Callable[[str], Column] | None = None) -> DataFrame:
    """Q05: customers by "halves with boxes" x "halves with errors" (e.g.
    'H1,H2' x 'H1'). Errors count only when customer and box both match; no
    error gives an empty string. ``part_of_year`` gives the label of a week
    column and may be any with a bounded number of labels, not only halves."""
    part = part_of_year or (lambda week: half_year(week, p.cut_week))
    boxes = qualified_boxes(t.boxes, p, year_prefix=True).select("customer_id", "box_id", part("week").alias("box_part")).distinct()
    errs = qualified_errors(t.errors, p).select("customer_id", "box_id", part("error_week").alias("error_part")).distinct()
    return (
        boxes.join(errs, ["customer_id", "box_id"], "left")
        .groupBy("customer_id")
        .agg(distinct_list("box_part").alias("box_year_parts"), distinct_list("error_part").alias("error_year_parts"))
        .groupBy("box_year_parts", "error_year_parts")
        .agg(F.count(F.lit(1)).alias("customer_count"))
    )


def box_error_quarters(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q05 by quarters of 13 weeks (week 53 belongs to the last)."""
    return box_error_halves(t, p, quarter)


# ---------------------------------------------------------------- Q09
def active_week_distribution(t: Tables, p: AnalysisParams) -> DataFrame:
    """Q09: per number of active weeks in the year: total boxes and customers."""
    per_customer = qualified_boxes(t.boxes, p, year_prefix=True).groupBy("customer_id").agg(
        F.count_distinct("box_id").alias("total_boxes"),
        F.count_distinct("week").alias("weeks"),
    )
    return (
        per_customer.groupBy("weeks")
        .agg(F.sum("total_boxes").alias("total_boxes"), F.count(F.lit(1)).alias("customer_count"))
        .orderBy("weeks")
    )


# ---------------------------------------------------------------- Q16
def propensity_by_dc(t: Tables, p: AnalysisParams, strict: bool = False) -> DataFrame:
    """Q16: Q02 per dc: customers, H2 reporters and their ratio per (dc, H1 flag).

    ``strict=False`` reproduces the analysed joins: error flags are attached on
    the customer only and strata on the two counts only, so a customer row is
    repeated once per error dc and once per dc with the same stratum, and
    ranks run over those repeated rows without the dc. The stratum
    repetition is counted arithmetically instead of materialised, and nothing is
    ranked (``_compatible_sample``).
    ``strict=True`` keys every join and the rank by dc.
    """
    # one row per (dc, customer) each, read by the strata and by the pool
    counts = freeze(half_box_counts(qualified_boxes(t.boxes, p, year_prefix=True), p, ["dc", "customer_id"]))
    errs = qualified_errors(t.errors, p, capped=True).withColumn("dc", normalise_dc("dc_code", "b"))
    flags = freeze(half_error_flags(errs, p, ["dc", "customer_id"]))
    base = counts.join(flags, ["dc", "customer_id"], "left")
    strata = stratum_sizes(base, ["dc", "h1_count", "h2_count"], p.max_half_boxes)
    if strict:
        pool = base.join(F.broadcast(strata), ["dc", "h1_count", "h2_count"], "left").select(
            "dc", "customer_id", "box_perm", "k",
            F.coalesce(F.col("h1_error"), F.lit(0)).alias("h1_error"),
            F.coalesce(F.col("h2_error"), F.lit(0)).alias("h2_error"),
        )
        chosen = matched_sample(pool, ["dc", "box_perm", "h1_error"])
    else:
        chosen = _compatible_sample(counts, flags, strata)
        per_perm = chosen.groupBy("dc", "box_perm", "h1_error").agg(
            F.sum("copies").alias("customer_count"),
            F.sum(F.col("h2_error") * F.col("copies")).alias("total_h2_errors"),
        )
        return _propensity(per_perm)
    per_perm = chosen.groupBy("dc", "box_perm", "h1_error").agg(
        F.count(F.lit(1)).alias("customer_count"), F.sum("h2_error").alias("total_h2_errors")
    )
    return _propensity(per_perm)


def _propensity(per_perm: DataFrame) -> DataFrame:
    return (
        per_perm.groupBy("dc", "h1_error")
        .agg(
            F.sum("customer_count").alias("customer_count"),
            F.sum("total_h2_errors").alias("total_h2_errors"),
        )
        .withColumn("propensity", F.try_divide(F.col("total_h2_errors"), F.col("customer_count")))
        .orderBy("dc", "h1_error")
    )


def _compatible_sample(counts: DataFrame, flags: DataFrame, strata: DataFrame) -> DataFrame:
    """Q16's analysed sample without materialising its repetition.

    As analysed, each (customer-dc row, error-flag row) pair is repeated once
    per dc whose stratum has the same two counts, and the repeated rows are
    ranked by (characters 3-6 desc, customer, dc, flag dc, stratum dc); a
    repeated row is kept when its rank is within its stratum's k. All pairs of
    one rank group share the same stratum list C (sorted by dc), and the |C|
    copies of a pair are adjacent in that order, so the copy for the j-th
    stratum has rank |C| * r + j + 1, r being the pair's own 0-based rank
    among pairs. It is kept when that is at most k_j, so when the pair is among
    the first floor((k_j - j - 1) / |C|) + 1 of its group: for each (group, j) one
    threshold, whose key is found by counting (``keys_at_ranks``), and a pair has
    as many kept copies as thresholds that it does not pass. C has at most one
    entry per dc, so the list of thresholds is bounded by the dc vocabulary.
    """
    entries = strata.groupBy("h1_count", "h2_count").agg(
        F.first("box_perm").alias("box_perm"),
        F.sort_array(F.collect_list(F.struct(F.col("dc").alias("stratum_dc"), F.col("k")))).alias("c"),
    )
    entries = freeze(entries)
    f = flags.select(F.col("dc").alias("flag_dc"), "customer_id", "h1_error", "h2_error")
    pairs = (
        counts.join(f, "customer_id", "left")
        # <= 26 x 26 strata rows: a proven broadcast bound
        .join(F.broadcast(entries.select("h1_count", "h2_count", "box_perm")), ["h1_count", "h2_count"])
        .select(
            "dc", "customer_id", "flag_dc", "box_perm",
            F.coalesce(F.col("h1_error"), F.lit(0)).alias("h1_error"),
            F.coalesce(F.col("h2_error"), F.lit(0)).alias("h2_error"),
        )
    )
    group = ["box_perm", "h1_error"]
    keyed = freeze(with_order_key(pairs, sample_order(["dc", "flag_dc"])).select("dc", *group, "h2_error", KEY))
    last_rank = F.transform("c", lambda e, j: F.floor((e["k"] - j - 1) / F.size("c")) + 1)
    targets = (
        entries.select("box_perm", F.explode(last_rank).alias("rank"))
        .withColumn("h1_error", F.explode(F.array(F.lit(0), F.lit(1))))
        .where(F.col("rank") > 0)
        .groupBy(*group, "rank").agg(F.count(F.lit(1)).alias("copies"))
    )
    thresholds = (
        keys_at_ranks(keyed, group, targets, clamp=True)
        .join(targets, [*group, "rank"])
        .groupBy(*group)
        .agg(F.collect_list(F.struct(F.col(KEY).alias("key"), "copies")).alias("until"))
    )
    copies = F.aggregate(
        "until", F.lit(0).cast("long"), lambda n, e: n + F.when(F.col(KEY) <= e["key"], e["copies"]).otherwise(F.lit(0)))
    # one row per (stratum, flag): the same bound
    return keyed.join(F.broadcast(thresholds), group).withColumn("copies", copies).filter(F.col("copies") > 0).select(
        "dc", *group, "h2_error", "copies")

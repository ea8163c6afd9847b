"""Derive boxes / errors / picks / date_dim from the driver's TPC-H style tables.

The same recipe exists twice: as Spark DataFrame code (``derive_tables``) and
as a DuckDB SQL prelude (``duckdb_prelude``) used by the oracle texts. Both are
generated from the constants below, so they cannot drift apart.

Recipe (one box per order, one error per returned-and-finished line item,
one pick per line item):

* customer_id: '-1' when ``o_custkey % 97 = 13``, else a nine-digit id
  ``(o_custkey * 7919 * 104729) % 900000000 + 100000000``
* box_id = order key, box_size = ``o_orderkey % 5``, week = ISO week of the
  order date, dc / market from the customer's nation and region
* errors: ``l_returnflag = 'R' AND l_linestatus = 'F'``; compensation is
  ``round(price(12,2) * discount(4,2) * 0.02, 2)`` as DECIMAL(18,4)
* picks: name gets ' Kit' for PROMO parts and '-r' for SMALL parts; the sku is
  'KIT-' + key when ``p_size % 10 = 0`` else 'ING-' + key
* date_dim: one row per day over whole ISO weeks covering the order dates
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.functions.dc import normalise_dc, sql_case
from boxlens.functions.weeks import iso_week
from boxlens.sources.tables import SCHEMAS, Tables

# FIXED VALUES of the test-data recipe: raw dc code by nation key (index).
NATION_DC_CODES = (
    "NZ", "GR", "Barleben", "BL", "SK", "Dublin", "CH", "LI", "FR", "Madrid",
    "Melbourne", "Milan", "BV", "MO", "NO", "Perth", "Sydney", "VE", "JP", "TO",
    "WF", "ON", "unmapped", "BV ", "AB",
)
TEAMS_BY_SUPPKEY_MOD5 = ("Production", "Procurement", "Logistics", "Customer Care", None)
UNKNOWN_CUSTKEY_MOD, UNKNOWN_CUSTKEY_REM = 97, 13
ID_MULT_1, ID_MULT_2, ID_MOD, ID_BASE = 7919, 104729, 900_000_000, 100_000_000


def _read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def _customer_id(custkey: F.Column) -> F.Column:
    masked = ((custkey * ID_MULT_1 * ID_MULT_2) % ID_MOD + ID_BASE).cast("string")
    return F.when(custkey % UNKNOWN_CUSTKEY_MOD == UNKNOWN_CUSTKEY_REM, F.lit("-1")).otherwise(masked)


def _team(suppkey: F.Column) -> F.Column:
    rem = suppkey % 5
    expr = None
    for i, team in enumerate(TEAMS_BY_SUPPKEY_MOD5):
        if team is None:
            continue
        expr = F.when(rem == i, F.lit(team)) if expr is None else expr.when(rem == i, F.lit(team))
    return expr


def derive_tables(spark: SparkSession, sf_dir: str) -> Tables:
    nation = _read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    region = _read(spark, sf_dir, "region", "r_regionkey", "r_name")
    customer = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    orders = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                   "o_orderpriority", "o_orderstatus")
    part = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    lineitem = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
                     "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag",
                     "l_linestatus")

    # nation x region is 25 rows by definition of the schema: a proven bound.
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    codes = F.array(*[F.lit(c) for c in NATION_DC_CODES])
    cust = (
        customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey)
        .select(
            "c_custkey",
            F.try_element_at(codes, (F.col("c_nationkey") + 1).cast("int")).alias("dc_code"),
            F.col("r_name").alias("market"),
        )
        .withColumn("dc", normalise_dc("dc_code", "b"))
    )
    orders_c = (
        orders.join(cust, orders.o_custkey == cust.c_custkey)
        .select(
            "o_orderkey",
            _customer_id(F.col("o_custkey")).alias("customer_id"),
            F.col("o_orderkey").cast("string").alias("box_id"),
            (F.col("o_orderkey") % 5).cast("int").alias("box_size"),
            iso_week("o_orderdate").alias("week"),
            F.month("o_orderdate").alias("month"),
            "dc_code", "dc", "market", "o_orderpriority", "o_orderstatus",
        )
    )

    boxes = orders_c.select(
        "customer_id", "box_id", "week", "box_size", "dc", "market",
        F.col("o_orderpriority").alias("shift"),
    )

    items = lineitem.join(orders_c, lineitem.l_orderkey == orders_c.o_orderkey).join(
        part, lineitem.l_partkey == part.p_partkey
    )
    returned = items.filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
    compensation = F.round(
        F.col("l_extendedprice").cast("decimal(12,2)")
        * F.col("l_discount").cast("decimal(4,2)")
        * F.lit(Decimal("0.02")),
        2,
    ).cast("decimal(18,4)")
    errors = returned.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("complaint_item_id"),
        "box_id", "box_size", "customer_id", "dc_code", "market",
        F.col("week").alias("error_week"),
        F.substring("week", 1, 4).alias("error_year"),
        "month",
        _team(F.col("l_suppkey")).alias("team"),
        F.col("p_brand").alias("error_category"),
        F.col("p_type").alias("error_subcategory"),
        F.col("o_orderstatus").alias("complaint"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("ingredient_subcategory"),
        F.col("o_orderpriority").alias("courier"),
        F.col("market").alias("delivery_region"),
        F.col("p_name").alias("sku_name"),
        F.col("l_linenumber").alias("compound_metric_number"),
        compensation.alias("compensation_eur"),
    )

    picks = items.select(
        "dc", "week", "box_id",
        F.when(F.col("p_type").startswith("PROMO"), F.concat("p_name", F.lit(" Kit")))
        .when(F.col("p_type").startswith("SMALL"), F.concat("p_name", F.lit("-r")))
        .otherwise(F.col("p_name"))
        .alias("ingredient_name"),
        F.concat(
            F.when(F.col("p_size") % 10 == 0, F.lit("KIT-")).otherwise(F.lit("ING-")),
            F.col("p_partkey").cast("string"),
        ).alias("ingredient_sku"),
    )

    # Calendar: a global min/max (partial aggregate) then one sequence of days,
    # bounded by the date range and not by the data volume.
    span = orders.agg(
        F.to_date(F.date_trunc("week", F.min("o_orderdate"))).alias("lo"),
        F.date_add(F.to_date(F.date_trunc("week", F.max("o_orderdate"))), 6).alias("hi"),
    )
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    date_dim = days.select(
        "date",
        iso_week("date").alias("week"),
        F.extract(F.lit("YEAROFWEEK"), F.col("date")).cast("string").alias("year"),
        F.month("date").alias("month"),
    )

    def typed(df: DataFrame, name: str) -> DataFrame:
        schema = SCHEMAS[name]
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])

    return Tables(
        boxes=typed(boxes, "boxes"),
        errors=typed(errors, "errors"),
        picks=typed(picks, "picks"),
        date_dim=typed(date_dim, "date_dim"),
    )


def duckdb_prelude() -> str:
    """``WITH`` clauses defining boxes / errors / picks / date_dim for DuckDB.

    Ends with a trailing comma-free CTE list; callers append ``, name AS (...)``
    CTEs and a final SELECT.
    """
    codes = ", ".join(f"'{c}'" for c in NATION_DC_CODES)
    team_arms = " ".join(
        f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEAMS_BY_SUPPKEY_MOD5) if t is not None
    )
    return f"""
WITH cust_ AS (
  SELECT c.c_custkey, ([{codes}])[c.c_nationkey + 1] AS dc_code, r.r_name AS market
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
cust2_ AS (SELECT *, {sql_case('dc_code', 'b')} AS dc FROM cust_),
orders_ AS (
  SELECT o.o_orderkey,
         CASE WHEN o.o_custkey % {UNKNOWN_CUSTKEY_MOD} = {UNKNOWN_CUSTKEY_REM} THEN '-1'
              ELSE CAST((o.o_custkey * {ID_MULT_1} * {ID_MULT_2}) % {ID_MOD} + {ID_BASE} AS VARCHAR) END AS customer_id,
         CAST(o.o_orderkey AS VARCHAR) AS box_id,
         CAST(o.o_orderkey % 5 AS INTEGER) AS box_size,
         strftime(o.o_orderdate, '%G-W%V') AS week,
         CAST(month(o.o_orderdate) AS INTEGER) AS month,
         k.dc_code, k.dc, k.market, o.o_orderpriority, o.o_orderstatus
  FROM orders o JOIN cust2_ k ON o.o_custkey = k.c_custkey
),
boxes AS (
  SELECT customer_id, box_id, week, box_size, dc, market, o_orderpriority AS shift FROM orders_
),
items_ AS (
  SELECT l.*, o.*, p.*
  FROM lineitem l JOIN orders_ o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
errors AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS complaint_item_id,
         box_id, box_size, customer_id, dc_code, market,
         week AS error_week, substr(week, 1, 4) AS error_year, month,
         CASE l_suppkey % 5 {team_arms} END AS team,
         p_brand AS error_category, p_type AS error_subcategory, o_orderstatus AS complaint,
         CASE WHEN p_size % 3 <> 0 THEN p_brand END AS ingredient_subcategory,
         o_orderpriority AS courier, market AS delivery_region, p_name AS sku_name,
         l_linenumber AS compound_metric_number,
         CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) * 0.02, 2)
              AS DECIMAL(18,4)) AS compensation_eur
  FROM items_ WHERE l_returnflag = 'R' AND l_linestatus = 'F'
),
picks AS (
  SELECT dc, week, box_id,
         CASE WHEN p_type LIKE 'PROMO%' THEN p_name || ' Kit'
              WHEN p_type LIKE 'SMALL%' THEN p_name || '-r'
              ELSE p_name END AS ingredient_name,
         CASE WHEN p_size % 10 = 0 THEN 'KIT-' ELSE 'ING-' END || CAST(p_partkey AS VARCHAR) AS ingredient_sku
  FROM items_
),
date_dim AS (
  SELECT CAST(d AS DATE) AS date, strftime(d, '%G-W%V') AS week, strftime(d, '%G') AS year,
         CAST(month(d) AS INTEGER) AS month
  FROM (SELECT unnest(generate_series(date_trunc('week', min(o_orderdate)),
                                      date_trunc('week', max(o_orderdate)) + INTERVAL 6 DAY,
                                      INTERVAL 1 DAY)) AS d FROM orders)
)"""

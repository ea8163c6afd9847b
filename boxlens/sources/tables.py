"""The four input tables and how to load them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS: dict[str, T.StructType] = {
    "boxes": T.StructType([
        T.StructField("customer_id", T.StringType()),
        T.StructField("box_id", T.StringType()),
        T.StructField("week", T.StringType()),
        T.StructField("box_size", T.IntegerType()),
        T.StructField("dc", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("shift", T.StringType()),
    ]),
    "errors": T.StructType([
        T.StructField("complaint_item_id", T.StringType()),
        T.StructField("box_id", T.StringType()),
        T.StructField("box_size", T.IntegerType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("dc_code", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("error_week", T.StringType()),
        T.StructField("error_year", T.StringType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("team", T.StringType()),
        T.StructField("error_category", T.StringType()),
        T.StructField("error_subcategory", T.StringType()),
        T.StructField("complaint", T.StringType()),
        T.StructField("ingredient_subcategory", T.StringType()),
        T.StructField("courier", T.StringType()),
        T.StructField("delivery_region", T.StringType()),
        T.StructField("sku_name", T.StringType()),
        T.StructField("compound_metric_number", T.IntegerType()),
        T.StructField("compensation_eur", T.DecimalType(18, 4)),
    ]),
    "picks": T.StructType([
        T.StructField("dc", T.StringType()),
        T.StructField("week", T.StringType()),
        T.StructField("box_id", T.StringType()),
        T.StructField("ingredient_name", T.StringType()),
        T.StructField("ingredient_sku", T.StringType()),
    ]),
    "date_dim": T.StructType([
        T.StructField("date", T.DateType()),
        T.StructField("week", T.StringType()),
        T.StructField("year", T.StringType()),
        T.StructField("month", T.IntegerType()),
    ]),
}

TABLE_NAMES = tuple(SCHEMAS)

# Storage layout written by ``Tables.write``: (partition column, clustering
# column inside files). Every report filters errors on one year and boxes on
# a year prefix or a week range, so those filters prune whole directories.
LAYOUT: dict[str, tuple[str | None, str | None]] = {
    "boxes": ("week", "customer_id"),
    "errors": ("error_year", "customer_id"),
    "picks": ("week", "box_id"),
    "date_dim": (None, None),
}


@dataclass(frozen=True)
class Tables:
    """Holder of the four inputs. All reports take one of these."""

    boxes: DataFrame
    errors: DataFrame
    picks: DataFrame
    date_dim: DataFrame

    # -- loaders -----------------------------------------------------------
    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Tables":
        """``root/<name>`` parquet directories with the schemas above.

        Explicit schemas: no inference pass over 100 TB, and a mismatching
        file fails fast instead of silently changing types.
        """
        return cls(**{
            name: spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")
            .select(*SCHEMAS[name].fieldNames())
            for name in TABLE_NAMES
        })

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: dict[str, str],
                     columns: dict[str, dict[str, str]] | None = None) -> "Tables":
        """Catalog tables, e.g. ``{"boxes": "prod.box_production", ...}``.

        ``columns`` maps, per table, our column name to the source column
        name (``{"boxes": {"customer_id": "customer_fk", ...}}``); unmapped
        columns are taken by our name. Every column is cast to the schema
        type, so a numeric-string box size (also '2.0') or a float amount is accepted.
        """
        columns = columns or {}

        def cast(c, kind: T.DataType, source: T.DataType):
            if isinstance(kind, T.IntegerType) and isinstance(source, T.StringType):
                # '2.0' is 2, as INT() reads it; text that is no number is NULL
                return F.trim(c).try_cast("decimal(38,18)").try_cast("int")
            return c.cast(kind)

        out = {}
        for name in TABLE_NAMES:
            mapping = columns.get(name, {})
            src = spark.table(names[name])
            out[name] = src.select(*[
                cast(F.col(c), f.dataType, src.schema[c].dataType).alias(f.name)
                for f in SCHEMAS[name].fields for c in [mapping.get(f.name, f.name)]
            ])
        return cls(**out)

    @classmethod
    def from_tpch(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        """Derive the four tables from the driver's TPC-H style parquet files."""
        from boxlens.sources.derive import derive_tables

        return derive_tables(spark, sf_dir)

    @classmethod
    def from_dataframes(cls, spark: SparkSession, **frames) -> "Tables":
        """Build from in-memory rows (tests): missing tables are empty."""
        out = {}
        for name in TABLE_NAMES:
            df = frames.get(name)
            if df is None:
                df = spark.createDataFrame([], SCHEMAS[name])
            elif not isinstance(df, DataFrame):
                df = spark.createDataFrame(df, SCHEMAS[name])
            out[name] = df
        return cls(**out)

    def register_views(self, prefix: str = "") -> None:
        """Expose the four tables as temp views (``boxes``, ``errors``,
        ``picks``, ``date_dim``, optionally prefixed) for ad-hoc Spark SQL
        next to the report functions."""
        for name in TABLE_NAMES:
            getattr(self, name).createOrReplaceTempView(f"{prefix}{name}")

    # -- contract ----------------------------------------------------------
    def malformed_weeks(self) -> DataFrame:
        """One row: per table, rows whose week key is not ``YYYY-Www`` with
        ww in 01..53 (NULL keys are not counted). The reports order and
        aggregate weeks as these keys; a malformed key would sort wrongly, so
        check new inputs once. Four map-side combined counts, one job each."""
        pattern = r"^[0-9]{4}-W(0[1-9]|[1-4][0-9]|5[0-3])$"

        def bad(df: DataFrame, col: str) -> DataFrame:
            c = F.col(col)
            return df.agg(F.count(F.when(c.isNotNull() & ~c.rlike(pattern), F.lit(1))).alias(col))

        parts = [
            bad(self.boxes, "week").withColumnRenamed("week", "boxes"),
            bad(self.errors, "error_week").withColumnRenamed("error_week", "errors"),
            bad(self.picks, "week").withColumnRenamed("week", "picks"),
            bad(self.date_dim, "week").withColumnRenamed("week", "date_dim"),
        ]
        return parts[0].select(
            "boxes", *[p.select(p.columns[0]).scalar().alias(p.columns[0]) for p in parts[1:]]
        )

    # -- sinks -------------------------------------------------------------
    def write(self, root: str, mode: str = "overwrite") -> None:
        """Materialise all four tables as parquet under ``root`` (see LAYOUT).

        ``REBALANCE(partition column)`` sends each week or year to few tasks
        (few files per directory) while AQE splits a partition that grows past
        the advisory size - a week holding a huge share of the rows is written
        by many tasks - and coalesces small ones. Within files rows are sorted
        by customer (or box), the key of most report shuffles and joins, which
        also tightens parquet statistics.
        """
        for name in TABLE_NAMES:
            df: DataFrame = getattr(self, name)
            part, cluster = LAYOUT[name]
            writer_df = df
            if part:
                writer_df = df.hint("rebalance", part).sortWithinPartitions(part, cluster)
            writer = writer_df.write.mode(mode)
            if part:
                writer = writer.partitionBy(part)
            writer.parquet(f"{root}/{name}")

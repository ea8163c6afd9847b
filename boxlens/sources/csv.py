"""CSV scan with a header (the regression input of the model)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REGRESSION_SCHEMA = T.StructType([
    T.StructField("box_size", T.IntegerType()),
    T.StructField("error_rate", T.DoubleType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = REGRESSION_SCHEMA) -> DataFrame:
    """Header CSV. An explicit schema is the default; ``schema=None`` infers
    types like the original single-machine reader did (an extra pass)."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)

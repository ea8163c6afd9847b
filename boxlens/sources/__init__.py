"""Input tables: explicit schemas, loaders and the derivation of the four
report tables from the driver's TPC-H style parquet files."""

from boxlens.sources.tables import Tables, SCHEMAS

__all__ = ["Tables", "SCHEMAS"]

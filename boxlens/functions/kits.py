"""Meal-kit predicate on pick rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES - the substrings and the suffix that mark a meal kit.
KIT_INFIX = "kit"      # in name or sku, any case
KIT_NAME_INFIX = "mk"  # in name, any case, no word boundary
KIT_NAME_SUFFIX = "-r"  # at the end of the name, case-sensitive


def is_meal_kit(name: Column | str = "ingredient_name", sku: Column | str = "ingredient_sku") -> Column:
    """S11. NULL name and sku give NULL (a CASE then takes its ELSE arm)."""
    name = F.col(name) if isinstance(name, str) else name
    sku = F.col(sku) if isinstance(sku, str) else sku
    low = F.lower(name)
    return (
        low.contains(KIT_INFIX)
        | F.lower(sku).contains(KIT_INFIX)
        | low.contains(KIT_NAME_INFIX)
        | name.endswith(KIT_NAME_SUFFIX)
    )

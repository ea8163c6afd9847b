"""Hand-made rows for the cases the driver data cannot show (FIXTURES.md §3)."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from boxlens.functions.weeks import week_key


def box(customer, box_id, week, size=2, dc="Auckland", market="AU", shift="A"):
    return (customer, box_id, week, size, dc, market, shift)


def err(item, box_id, customer, week, comp, team="Production", dc_code="NZ", size=2,
        metric=1, sku="rice", market="AU", month=1):
    return (item, box_id, size, customer, dc_code, market, week, week[:4], month, team,
            "cat", "sub", "complaint", "ingr", "courier", "region", sku, metric,
            Decimal(str(comp)))


def pick(dc, week, box_id, name, sku="ING-1"):
    return (dc, week, box_id, name, sku)


def calendar(start: date, end: date):
    """date_dim rows with ISO week keys, ISO year and calendar month."""
    rows, d = [], start
    while d <= end:
        y, w, _ = d.isocalendar()
        rows.append((d, week_key(str(y), w), str(y), d.month))
        d += timedelta(days=1)
    return rows

"""Money helpers (cents are the truth; dollars are derived)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents_to_dollars(cents: Column) -> Column:
    """``float64(cents) / 100``."""
    return cents.cast("double") / F.lit(100.0)


def effective_quantity(quantity: Column) -> Column:
    """A quantity of zero or less counts as one."""
    return F.when(F.coalesce(quantity, F.lit(0)) <= 0, F.lit(1)).otherwise(quantity)


def line_cents(price: Column, quantity: Column, rounding: str = "parity") -> Column:
    """Dollars -> cents for one line.

    ``parity`` truncates ``(price * 100) * qty`` in binary floating point, as
    the reference service does (19.99 -> 1998).  ``exact`` goes through
    DECIMAL(10,2) like the SQL schema and rounds half up (19.99 -> 1999).
    """
    qty = effective_quantity(quantity)
    if rounding == "parity":
        return (price * F.lit(100.0) * qty.cast("double")).cast("long")
    if rounding == "exact":
        dec = price.cast("decimal(10,2)") * F.lit(100).cast("decimal(3,0)") * qty.cast("decimal(10,0)")
        return F.round(dec, 0).cast("long")
    raise ValueError(f"unknown rounding {rounding!r}")


def money_text(cents: Column) -> Column:
    """``%.2f`` of the dollar amount."""
    return F.format_string("%.2f", cents_to_dollars(cents))

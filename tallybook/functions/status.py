"""Status ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_STATUSES = ("PENDING", "PARTIAL")


def sale_payment_status(sale: Column, paid: Column) -> Column:
    return (
        F.when((sale <= 0) | (paid <= 0), "PENDING")
        .when(paid < sale, "PARTIAL")
        .otherwise("COMPLETE")
    )


def account_status(balance: Column, paid: Column) -> Column:
    """Registered customers: owed, settled or overpaid."""
    return (
        F.when((balance > 0) & (paid == 0), "PENDING")
        .when(balance > 0, "PARTIAL")
        .when(balance == 0, "PAID")
        .otherwise("EXTRA PAID")
    )


def supplier_status(balance: Column, paid: Column, tolerance: str = "0") -> Column:
    limit = F.lit(tolerance).cast("decimal(3,1)")
    return (
        F.when(balance < -limit, "EXTRA PAID")
        .when(F.abs(balance) <= limit, "PAID")
        .when(paid > 0, "PARTIAL")
        .otherwise("PENDING")
    )


def costing_status(done: Column, lines: Column) -> Column:
    return F.when(done == 0, "PENDING").when(done < lines, "PARTIAL").otherwise("COMPLETE")


def outstanding_side(balance: Column) -> Column:
    return F.when(balance < 0, "ADVANCE").otherwise("PAYABLE")

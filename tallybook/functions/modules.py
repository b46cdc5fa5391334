"""The eight sales modules and the names each report prints for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Module:
    prefix: str  # leading part of ref_no
    table: str
    report: str  # label in the sales reports
    source: str  # label in the registered ledger
    deleted: str  # label in the deleted report, restore and permanent delete


# fixed values: order is the priority wherever one of several rows is picked
MODULES = (
    Module("PKG-", "bookings", "Packages", "Booking", "PACKAGE"),
    Module("HOT-", "hotels", "Hotels", "Hotel", "HOTEL"),
    Module("VISA-", "visa", "Visa", "Visa", "VISA"),
    Module("CARD-", "card", "Card", "Card", "CARD"),
    Module("GRP-", "groups", "Groups", "Group", "GROUP"),
    Module("TIC-", "ticketing", "Ticketing", "Ticketing", "TICKETING"),
    Module("TRN-", "transport", "Transport", "Transport", "TRANSPORT"),
    Module("ZIY-", "ziyarat", "Ziyarat", "Ziyarat", "ZIYARAT"),
)
CUSTOMER_PREFIX = "CUST-"
SUPPLIER_PREFIX = "SUP-"


def module_prefix(ref_no: Column) -> Column:
    """``PKG-00012`` -> ``PKG-``."""
    return F.regexp_extract(ref_no, r"^[A-Z]+-", 0)


def module_value(prefix: Column, field: str) -> Column:
    """Look a module attribute up by prefix; NULL for any other prefix."""
    chain = F.when(prefix == MODULES[0].prefix, F.lit(getattr(MODULES[0], field)))
    for m in MODULES[1:]:
        chain = chain.when(prefix == m.prefix, F.lit(getattr(m, field)))
    return chain


def module_rank(prefix: Column) -> Column:
    """Position of the module in ``MODULES``."""
    chain = F.when(prefix == MODULES[0].prefix, F.lit(0))
    for i, m in enumerate(MODULES[1:], start=1):
        chain = chain.when(prefix == m.prefix, F.lit(i))
    return chain.otherwise(F.lit(len(MODULES)))

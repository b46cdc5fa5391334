"""Name dimensions: one row per key, so a lookup is an equi join that cannot fan out.

Every pick is ordered (module order, then id), where a LIMIT 1 without an
ORDER BY would be arbitrary. Each is a grouped aggregate with map-side partial
results, so a key that repeats very often is collapsed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.coerce import is_named
from tallybook.functions.modules import MODULES, module_rank


def _first_name(name: str = "customer_name"):
    return F.min_by(F.col(name), F.struct("_rank", "id"))


def names_by_any_key(sales: DataFrame) -> DataFrame:
    """(key, name): key is a customer code or a ref_no; deleted sales count too."""
    return (
        sales.where(is_named("customer_name"))
        .select(
            "id",
            "customer_name",
            module_rank(F.col("prefix")).alias("_rank"),
            F.explode(F.array("customer_code", "ref_no")).alias("key"),
        )
        .where(is_named("key"))
        .groupBy("key")
        .agg(_first_name().alias("name"))
    )


def names_by_code(sales: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """(customer_code, name) from active sales, then the customer master."""
    rows = sales.where(~F.col("is_deleted") & is_named("customer_code") & is_named("customer_name")).select(
        "customer_code", "customer_name", module_rank(F.col("prefix")).alias("_rank"), "id"
    )
    if customers is not None:
        master = customers.where(is_named("name")).select(
            "customer_code", F.col("name").alias("customer_name"), F.lit(len(MODULES)).alias("_rank"), "id"
        )
        rows = rows.unionByName(master)
    return rows.groupBy("customer_code").agg(_first_name().alias("name"))


def greatest_name_by_ref(sales: DataFrame) -> DataFrame:
    """(ref_no, name): the greatest name over all rows of the ref."""
    return sales.groupBy("ref_no").agg(F.max("customer_name").alias("name"))


def one_per_key(dimension: DataFrame, key: str, *columns: str) -> DataFrame:
    """The dimension with its key made unique, so an unused lookup can be pruned."""
    return dimension.groupBy(key).agg(*[F.max(c).alias(c) for c in columns])

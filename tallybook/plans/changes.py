"""Set-based changes: upserts, status rollups, deletes, reference numbers.

Each takes current tables plus a frame of changes and returns the new table,
to be written to a new location.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.books import Books
from tallybook.functions.coerce import MONEY, is_blank, is_named, number, or_text, padded, total, total_if
from tallybook.functions.modules import CUSTOMER_PREFIX, MODULES, SUPPLIER_PREFIX, module_prefix
from tallybook.functions.status import costing_status
from tallybook.operators.keyed import first_per_key, remove, set_flag, upsert
from tallybook.operators.running import numbered
from tallybook.plans.lines import LABELLED, STAY, STAY_COLUMNS, TEXTS, with_totals
from tallybook.plans.outstanding import status_of_paid_refs, status_of_refs
from tallybook.plans.sales import active, of_module

# purchases


def clean_purchase_items(requests: DataFrame) -> DataFrame:
    """Drop blank items, keep the first of equal trimmed items, price the rest.

    ``requests`` has ref_no, position, item, amounts as text or numbers, and
    supplier fields. Cost and profit are 0 until both amount and rate are known.
    """
    rows = requests.where(is_named("item")).withColumn("_key", F.trim("item"))
    rows = first_per_key(rows, ["ref_no", "_key"], F.col("position"))
    amounts = {c: number(F.col(c).cast("string")) for c in ("sale_sar", "sale_rate", "purchase_sar", "purchase_rate")}
    rows = rows.withColumns(amounts)
    costed = (F.col("purchase_sar") > 0) & (F.col("purchase_rate") > 0)
    zero = F.lit(0).cast(MONEY)
    return (
        rows.withColumn("sale_pkr", (F.col("sale_sar") * F.col("sale_rate")).cast(MONEY))
        .withColumn(
            "purchase_pkr", F.when(costed, F.col("purchase_sar") * F.col("purchase_rate")).otherwise(zero).cast(MONEY)
        )
        .withColumn("profit", F.when(costed, F.col("sale_pkr") - F.col("purchase_pkr")).otherwise(zero).cast(MONEY))
        .withColumn("supplier_code", or_text("supplier_code", ""))
        .withColumn("supplier_name", or_text("supplier_name", ""))
        .withColumn("is_deleted", F.lit(False))
        .drop("_key", "position")
    )


def purchase_upsert(books: Books, requests: DataFrame) -> DataFrame:
    """Insert or update by (ref_no, item); a deleted row comes back, created_at stays."""
    changes = clean_purchase_items(requests)
    # two spellings of one trimmed item cannot both arrive, so (ref_no, item) is unique
    return upsert(
        books.purchases,
        changes,
        ["ref_no", "item"],
        update=[
            "sale_sar",
            "sale_rate",
            "sale_pkr",
            "purchase_sar",
            "purchase_rate",
            "purchase_pkr",
            "profit",
            "supplier_code",
            "supplier_name",
        ],
        force={"is_deleted": F.lit(False)},
        unique=True,
    )


def costing_of_refs(items: DataFrame) -> DataFrame:
    """(ref_no, purchase_status) from cleaned items: none, some or all costed."""
    done = F.count_if((F.col("purchase_sar") > 0) & (F.col("purchase_rate") > 0))
    return items.groupBy("ref_no").agg(costing_status(done, F.count("*")).alias("purchase_status"))


def _rolled_up(sales: DataFrame, statuses: DataFrame, column: str) -> DataFrame:
    fresh = statuses.withColumnRenamed(column, "_new")
    return (
        sales.join(fresh, "ref_no", "left")
        .withColumn(column, F.coalesce("_new", column))
        .select(*sales.columns)
    )


def purchase_status_rollup(books: Books, items: DataFrame, deleted_refs: DataFrame | None = None) -> DataFrame:
    """Sales with the costing status of the saved refs; refs whose purchases were deleted fall to PENDING."""
    statuses = costing_of_refs(items)
    if deleted_refs is not None:
        reset = deleted_refs.select("ref_no").distinct()
        statuses = statuses.join(reset, "ref_no", "left_anti").unionByName(
            reset.withColumn("purchase_status", F.lit("PENDING"))
        )
    return _rolled_up(books.sales, statuses, "purchase_status")


def payment_status_rollup(books: Books, touched: DataFrame | None = None) -> DataFrame:
    """Sales with the payment status of every ref whose payments changed (default: all paid refs)."""
    statuses = status_of_paid_refs(books) if touched is None else status_of_refs(books, touched)
    return _rolled_up(books.sales, statuses.where(of_module(F.col("ref_no"))), "payment_status")


# deletes


def delete_eligibility(books: Books) -> DataFrame:
    """Per sale: may it be deleted, and what stands in the way."""
    costs = active(books.purchases).groupBy("ref_no").agg(total("purchase_pkr").alias("_cost"))
    received = books.customer_payments.groupBy("ref_no").agg(
        total_if(F.col("type") == "payment", "amount").alias("_received")
    )
    reason = (
        F.when(F.col("_cost") > 0, "Purchase entries exist for this ref")
        .when(F.col("_received") > 0, "Payment has been received for this ref")
    )
    return (
        books.sales.select("ref_no")
        .join(costs, "ref_no", "left")
        .join(received, "ref_no", "left")
        .select("ref_no", reason.alias("reason"))
        .withColumn("deletable", F.col("reason").isNull())
    )


def soft_delete(rows: DataFrame, keys: DataFrame, key: str = "ref_no") -> DataFrame:
    return set_flag(rows, keys, [key], "is_deleted", True)


def restore(rows: DataFrame, keys: DataFrame, key: str = "ref_no") -> DataFrame:
    return set_flag(rows, keys, [key], "is_deleted", False)


def restore_purchases(books: Books, keys: DataFrame) -> DataFrame:
    """Restore whole refs, but not one that has an active purchase already."""
    allowed = keys.join(active(books.purchases).select("ref_no"), "ref_no", "left_anti")
    return restore(books.purchases, allowed)


def permanent_delete(rows: DataFrame, keys: DataFrame, key: str = "ref_no") -> DataFrame:
    """Drop listed rows that are flagged as deleted."""
    return remove(rows, keys, [key], F.col("is_deleted"))


def entry_delete(rows: DataFrame, keys: DataFrame, protected: Column | None = None) -> DataFrame:
    """Drop ledger entries by id; ``protected`` rows stay."""
    only = None if protected is None else ~F.coalesce(protected, F.lit(False))
    return remove(rows, keys, ["id"], only)


LIVE_PURCHASE = "Live Purchase"


def purchase_entry_delete(books: Books, keys: DataFrame) -> DataFrame:
    return entry_delete(books.purchases, keys, F.col("status") == LIVE_PURCHASE)


# reference numbers


def digits(ref: str | Column) -> Column:
    """The number in a reference; NULL if it has none."""
    return F.regexp_replace(ref, "[^0-9]", "").try_cast("bigint")


def ref_high_water(books: Books) -> DataFrame:
    """(prefix, last_no): the highest number in use per kind of reference."""
    refs = (
        books.sales.select(F.col("ref_no").alias("ref"))
        .unionByName(books.suppliers.select(F.col("supplier_code").alias("ref")))
        .unionByName(books.customers.select(F.col("customer_code").alias("ref")))
    )
    return refs.groupBy(module_prefix(F.col("ref")).alias("prefix")).agg(
        F.coalesce(F.max(digits(F.col("ref"))), F.lit(0)).alias("last_no")
    )


def ref_allocate(books: Books, requests: DataFrame, order_id: str = "request_id", **sizes) -> DataFrame:
    """Give each request (prefix, order_id) the next free reference of its prefix."""
    return (
        numbered(requests, "_n", group=["prefix"], order_id=order_id, **sizes)
        .join(ref_high_water(books), "prefix", "left")
        .withColumn("_no", F.coalesce("last_no", F.lit(0)) + F.col("_n"))
        .withColumn(
            "ref_no",
            F.concat("prefix", F.when(F.col("prefix") == SUPPLIER_PREFIX, padded(F.col("_no"), 4)).otherwise(padded(F.col("_no"), 5))),
        )
        .select(*requests.columns, "ref_no")
    )


# master data and sales


def _trimmed(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def customer_upsert(books: Books, requests: DataFrame) -> DataFrame:
    """Customers with named requests applied by code; contact fields are trimmed."""
    changes = requests.where(is_named("name")).select(
        "id", "customer_code", "name", _trimmed("contact_no").alias("contact_no"), _trimmed("email").alias("email")
    )
    changes = changes.withColumn("is_deleted", F.lit(False))
    return upsert(books.customers, changes, ["customer_code"], update=["name", "contact_no", "email"])


def supplier_upsert(books: Books, requests: DataFrame) -> DataFrame:
    changes = requests.where(is_named("supplier_name")).select(
        "id", "supplier_code", "supplier_name", "category", "contact_no"
    )
    changes = changes.withColumn("is_deleted", F.lit(False))
    return upsert(books.suppliers, changes, ["supplier_code"], update=["supplier_name", "category", "contact_no"])


def bank_upsert(books: Books, requests: DataFrame) -> DataFrame:
    complete = ~(is_blank("bank_name") | is_blank("account_title") | is_blank("account_number"))
    changes = requests.where(complete).select(
        "id",
        *[F.trim(c).alias(c) for c in ("bank_name", "account_title", "account_number")],
        or_text("status", "Active").alias("status"),
    )
    return upsert(books.banks, changes, ["id"], update=["bank_name", "account_title", "account_number", "status"])


def sales_upsert(books: Books, requests: DataFrame) -> DataFrame:
    """Sales with requests applied by ref_no.

    An empty customer code is stored as NULL. A card sale is CLEARED for a
    registered customer and PENDING otherwise; other modules keep their status
    and a new sale starts as PENDING.
    """
    code = F.nullif(F.col("customer_code"), F.lit(""))
    changes = requests.withColumn("customer_code", code).withColumn("prefix", module_prefix(F.col("ref_no")))
    card = F.col("prefix") == "CARD-"
    card_status = F.when(card & F.col("customer_code").isNotNull(), "CLEARED").when(card, "PENDING")
    changes = changes.withColumn("_card_status", card_status)
    fields = ["customer_code", "customer_name", "booking_date", "total_pkr"]
    current = books.sales.withColumn("_card_status", F.lit(None).cast("string"))
    new = changes.select("id", "prefix", "ref_no", *fields, "created_at", "_card_status").withColumns(
        {
            "payment_status": F.coalesce("_card_status", F.lit("PENDING")),
            "purchase_status": F.lit("PENDING"),
            "is_deleted": F.lit(False),
        }
    )
    merged = upsert(current, new, ["ref_no"], update=[*fields, "_card_status"])
    return merged.withColumn("payment_status", F.coalesce("_card_status", "payment_status")).select(
        *books.sales.columns
    )


def master_save(
    current: DataFrame, requests: DataFrame, *, code: str, prefix: str, width: int, name: str, fields: dict[str, Column], **sizes
) -> DataFrame:
    """Master data with requests (request_id, id, fields) saved.

    A request with an id changes the row of that id, if there is one; of several the first counts. One without an
    id is a new row, if it is named: ids and codes go on above the highest in use, in request_id order.
    """
    given = requests.select("request_id", "id", *[v.alias(c) for c, v in fields.items()])
    changed = upsert(current, given.where("id is not null"), ["id"], update=list(fields), insert=False, order=[F.col("request_id")])
    last = current.agg(F.struct(F.coalesce(F.max("id"), F.lit(0)).alias("id"), F.coalesce(F.max(digits(code)), F.lit(0)).alias("no")).alias("v")).scalar()
    new = given.where(F.col("id").isNull() & is_named(name)).withColumn("prefix", F.lit(prefix))
    new = numbered(new, "_n", group=["prefix"], order_id="request_id", **sizes).withColumn("_last", last)
    new = new.select(
        (F.col("_last.id") + F.col("_n")).alias("id"),
        F.concat("prefix", padded(F.col("_last.no") + F.col("_n"), width)).alias(code),
        *fields,
        F.lit(False).alias("is_deleted"),
    )
    return changed.unionByName(new.select(*current.columns))


def customer_save(books: Books, requests: DataFrame, **sizes) -> DataFrame:
    """Customers changed by id, new ones under the next code; contact fields are trimmed."""
    fields = {"name": F.col("name"), "contact_no": _trimmed("contact_no"), "email": _trimmed("email")}
    return master_save(books.customers, requests, code="customer_code", prefix=CUSTOMER_PREFIX, width=5, name="name", fields=fields, **sizes)


def supplier_save(books: Books, requests: DataFrame, **sizes) -> DataFrame:
    fields = {c: F.col(c) for c in ("supplier_name", "category", "contact_no")}
    return master_save(books.suppliers, requests, code="supplier_code", prefix=SUPPLIER_PREFIX, width=4, name="supplier_name", fields=fields, **sizes)


# sales of a module with their nested rows


def _as_list(rows: DataFrame, column: str) -> Column:
    """Nested rows as they are stored: the JSON text of the whole list; none is an empty list."""
    if isinstance(rows.schema[column].dataType, T.ArrayType):
        return F.coalesce(F.to_json(column), F.lit("[]"))
    return or_text(column, "[]")


def _folded(text: Column, shape: str, field: str) -> Column:
    """Sum of a field over a stored list; unreadable numbers are 0."""
    start = F.lit(0).cast("decimal(28,2)")
    parsed = F.when(F.ltrim(text).startswith("["), F.from_json(text, shape))
    return F.coalesce(F.aggregate(parsed, start, lambda total, x: (total + number(x[field])).cast("decimal(28,2)")), start)


def _travellers(rows: DataFrame, count: str) -> Column:
    """Fares of adults, children and infants."""
    out = F.lit(0).cast("decimal(28,2)")
    for t in ("adult", "child", "infant"):
        out = (out + number(F.col(f"{t}_{count}").cast("string")) * number(F.col(f"{t}_rate").cast("string"))).cast("decimal(28,2)")
    return out


def _priced(rows: DataFrame, totals: dict[str, Column], rate: str | None) -> DataFrame:
    """``rows`` with totals: as sent, or folded from the lines where a request leaves them out; PKR by the rate."""
    sent = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    first = next(iter(totals))
    rows = rows.withColumns({c: F.coalesce(sent(c), v).cast("decimal(20,2)") for c, v in totals.items()})
    if rate is None:
        return rows
    pkr = F.col(first).cast(MONEY) * number(F.col(rate).cast("string"))
    return rows.withColumn("total_pkr", F.coalesce(sent("total_pkr"), pkr).cast("decimal(20,2)"))


def _nested_bookings(rows: DataFrame) -> DataFrame:
    lists = ("flights", "hotels", "visa", "transport", "ziyarat")
    rows = rows.withColumns({c: _as_list(rows, c) for c in lists if c in rows.columns})
    totals = {
        "flight_total": _travellers(rows, "count"),
        "hotels_total": _folded(F.col("hotels"), STAY, "total"),
        "transport_total": _folded(F.col("transport"), LABELLED, "amount"),
        "ziyarat_total": _folded(F.col("ziyarat"), LABELLED, "amount"),
    }
    return _priced(rows, totals, None)


def _nested_hotels(rows: DataFrame) -> DataFrame:
    """Stays come as one list and are stored as parallel lists, one for each field."""
    if "hotels" in rows.columns:
        stays = F.coalesce("hotels", F.array().cast(rows.schema["hotels"].dataType))
        # the field of an array of structs is the array of that field
        lists = {column: F.to_json(stays[field]) for field, column in STAY_COLUMNS.items()}
        rows = rows.withColumns(lists).drop("hotels")
    start = F.lit(0).cast("decimal(28,2)")
    stored = F.from_json("hotel_total", TEXTS)
    total = F.coalesce(F.aggregate(stored, start, lambda t, x: (t + number(x)).cast("decimal(28,2)")), start)
    return _priced(rows, {"hotels_total": total}, "sar_rate")


def _nested_ticketing(rows: DataFrame) -> DataFrame:
    if "flights" in rows.columns:
        flights = F.coalesce("flights", F.array().cast(rows.schema["flights"].dataType))
        lists = {
            "flight_from": F.transform(flights, lambda x: x["from"]),
            "flight_to": F.transform(flights, lambda x: x["to"]),
            "flight_date": F.transform(flights, lambda x: x["date"]),
            "airline": F.transform(flights, lambda x: F.coalesce(x["airline"], F.lit(""))),
        }
        rows = rows.withColumns({c: F.to_json(v) for c, v in lists.items()}).drop("flights")
    return _priced(rows, {"total_sar": _travellers(rows, "qty")}, "pkr_rate")


def _nested_labelled(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("rows", _as_list(rows, "rows"))
    return _priced(rows, {"total_sar": _folded(F.col("rows"), LABELLED, "sar")}, "pkr_rate")


NESTED = {
    "bookings": _nested_bookings,
    "hotels": _nested_hotels,
    "visa": with_totals,
    "card": with_totals,
    "groups": with_totals,
    "ticketing": _nested_ticketing,
    "transport": _nested_labelled,
    "ziyarat": _nested_labelled,
}


def with_module_totals(rows: DataFrame, table: str) -> DataFrame:
    """A module table, or requests for it, with stored lists and totals."""
    return NESTED[table](rows)


def module_save(current: DataFrame, requests: DataFrame, table: str, **sizes) -> DataFrame:
    """A module table with requests saved; the lists of a request replace those of the sale as a whole.

    Totals are folded from the rows sent: always for visa, card and groups, elsewhere where a request leaves
    them out. A request without a ref_no gets the next number of the module, in request_id order. An empty
    customer code is stored as NULL. A save does not bring a deleted sale back.
    """
    prefix = next(m.prefix for m in MODULES if m.table == table)
    asked = with_module_totals(requests, table).withColumn("prefix", F.lit(prefix))
    if "customer_code" in asked.columns:
        asked = asked.withColumn("customer_code", F.nullif(F.col("customer_code"), F.lit("")))
    last = current.agg(F.coalesce(F.max(digits("ref_no")), F.lit(0)).alias("v")).scalar()
    new = numbered(asked.where(is_blank("ref_no")), "_n", group=["prefix"], order_id="request_id", **sizes)
    new = new.withColumn("ref_no", F.concat("prefix", padded(last + F.col("_n"), 5))).select(*asked.columns)
    named = asked.where(is_named("ref_no"))
    fields = [c for c in current.columns if c in asked.columns and c not in ("ref_no", "is_deleted")]
    changed = named.unionByName(new).withColumn("is_deleted", F.lit(False)).select("ref_no", *fields, "is_deleted")
    return upsert(current, changed, ["ref_no"], update=fields)

"""Ledger tables derived from the star-schema test tables.

``VIEWS`` is SQL that Spark and DuckDB both read, so the same text feeds the
Spark plans and the oracle. ``{name}`` stands for another view or base table.
Nested module tables need JSON text, which the two engines build differently,
so those are Spark only (the oracle works on their flat rules).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tallybook.books import Books
from tallybook.functions.modules import MODULES

# columns of the test tables, given so that no job has to infer them
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
BASE = tuple(SCHEMAS)


def prefix_sql(key: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{m.prefix}'" for i, m in enumerate(MODULES[:-1]))
    return f"CASE {key} % 8 {arms} ELSE '{MODULES[-1].prefix}' END"


def ref_sql(key: str) -> str:
    return f"({prefix_sql(key)} || lpad(CAST({key} AS STRING), 8, '0'))"


def code_sql(prefix: str, key: str) -> str:
    return f"'{prefix}' || lpad(CAST({key} AS STRING), 8, '0')"


_WALKIN_KEY = "CAST(floor(event_id / 9) AS BIGINT)"
_PAID_KEY = "CAST(floor(event_id / 3) AS BIGINT)"
_TENTH = "CAST(floor({0} / 10) AS BIGINT)"
_DAY = "CAST(DATE '1995-01-01' + CAST(event_id % 2400 AS INT) AS DATE)"
_METHOD = "CASE event_id % 4 WHEN 0 THEN 'Cash' WHEN 1 THEN 'cash' WHEN 2 THEN 'Bank' ELSE 'bank' END"
_BANK = "CASE WHEN event_id % 4 >= 2 THEN event_id % 5 END"
_TYPE = (
    "CASE event_id % 10 WHEN 0 THEN 'opening_balance' WHEN 1 THEN 'adjustment'"
    " WHEN 2 THEN 'Adjustment' WHEN 3 THEN NULL ELSE 'payment' END"
)


def _amount(factor: int) -> str:
    return f"CAST(CAST(value AS DECIMAL(18,2)) * {factor} AS DECIMAL(18,2))"


# every line is a purchase of its own: part, supplier, ship day and quantity tell lines of one number apart
_LINE_ID = "(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT)"
_ITEM = (
    "'Item ' || CAST(l_linenumber AS STRING) || ' - part ' || CAST(l_partkey AS STRING) || ' of ' || CAST(l_suppkey AS STRING)"
    " || ', ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' on ' || CAST(CAST(l_shipdate AS DATE) AS STRING)"
)
# a fifth of the lines is bought under the base of a sale's line (``Hotel 1``), another fifth under a full label
_KIND = "CASE l_orderkey % 8 WHEN 1 THEN 'Hotel ' WHEN 2 THEN 'Visa ' WHEN 3 THEN 'Card ' WHEN 4 THEN 'Groups ' WHEN 7 THEN 'Ziyarat ' ELSE 'Transport ' END"
_ITEM = (
    f"CASE l_partkey % 5 WHEN 0 THEN {_KIND} || CAST(l_linenumber AS STRING)"
    f" WHEN 1 THEN {_KIND} || CAST(l_linenumber AS STRING) || ' - D' || CAST(l_linenumber AS STRING) ELSE {_ITEM} END"
)
_FEED = f"""{_LINE_ID} AS id, {ref_sql("l_orderkey")} AS ref_no, {_ITEM} AS item, l_partkey, l_suppkey,
 CAST(l_quantity AS DECIMAL(18,2)) AS sale_sar, CAST(75.50 AS DECIMAL(18,2)) AS sale_rate,
 CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(l_quantity AS DECIMAL(18,2)) END AS purchase_sar,
 CAST(CAST(70 AS DECIMAL(18,2)) + CAST(l_tax AS DECIMAL(18,2)) * 100 AS DECIMAL(18,2)) AS purchase_rate,
 CASE WHEN l_partkey % 20 = 0 THEN '' WHEN l_partkey % 20 = 1 THEN NULL ELSE {code_sql("SUP-", "l_suppkey")} END AS supplier_code,
 CASE WHEN l_partkey % 20 IN (0, 2) THEN '' WHEN l_partkey % 20 = 1 THEN NULL ELSE 'Supplier#' || lpad(CAST(l_suppkey AS STRING), 9, '0') END AS supplier_name,
 CASE WHEN l_linestatus = 'F' THEN 'Live Purchase' ELSE 'Purchase' END AS status,
 l_shipdate AS created_at, l_partkey % 23 = 0 AS is_deleted"""

VIEWS = {
    "sales": f"""
SELECT o_orderkey AS id, {prefix_sql("o_orderkey")} AS prefix, {ref_sql("o_orderkey")} AS ref_no,
 CASE WHEN o_custkey % 10 = 0 THEN {code_sql("CUST-", _TENTH.format("o_custkey"))} WHEN o_custkey % 10 = 9 THEN '' ELSE NULL END AS customer_code,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN '' ELSE c_name END AS customer_name,
 CAST(o_orderdate AS DATE) AS booking_date, o_orderdate + INTERVAL 3 DAY AS created_at,
 CAST(o_totalprice AS DECIMAL(18,2)) AS total_pkr,
 CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'PENDING' ELSE 'PARTIAL' END AS payment_status,
 CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'COMPLETE' WHEN '2' THEN 'PARTIAL' ELSE 'PENDING' END AS purchase_status,
 o_orderkey % 17 = 0 AS is_deleted
 FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey""",
    "purchase_feed": f"""
SELECT {_FEED} FROM {{lineitem}}""",
    "purchases": f"""
SELECT id, ref_no, item, sale_sar, sale_rate, CAST(sale_sar * sale_rate AS DECIMAL(18,2)) AS sale_pkr, purchase_sar, purchase_rate,
 CASE WHEN purchase_sar > 0 AND purchase_rate > 0 THEN CAST(purchase_sar * purchase_rate AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS purchase_pkr,
 CASE WHEN purchase_sar > 0 AND purchase_rate > 0 THEN CAST(sale_sar * sale_rate - purchase_sar * purchase_rate AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS profit,
 supplier_code, supplier_name, status, created_at, is_deleted FROM (SELECT {_FEED} FROM {{lineitem}}) t""",
    "customer_payments": f"""
SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN {ref_sql(_WALKIN_KEY)} ELSE {code_sql("CUST-", "user_id")} END AS ref_no, {_DAY} AS payment_date, {_amount(5000)} AS amount, {_TYPE} AS type, {_METHOD} AS payment_method, {_BANK} AS bank_profile_id, event_id % 19 = 0 AS is_deleted FROM {{events}} WHERE event_type IN ('purchase','signup')""",
    "supplier_payments": f"""
SELECT event_id AS id, user_id AS supplier_id, {_DAY} AS payment_date, {_amount(1200)} AS amount, {_TYPE} AS type, {_METHOD} AS payment_method, {_BANK} AS bank_profile_id FROM {{events}} WHERE event_type = 'click'""",
    "purchase_payments": f"""
SELECT event_id AS id, {ref_sql(_PAID_KEY)} AS ref_no, {_DAY} AS payment_date, {_amount(100)} AS amount, {_TYPE} AS type, {_METHOD} AS payment_method FROM {{events}} WHERE event_type IN ('click','view')""",
    "expenses": f"""
SELECT event_id AS id, {_DAY} AS expense_date, 'Expense ' || CAST(event_id % 7 AS STRING) AS title, {_amount(100)} AS amount, {_METHOD} AS payment_method, {_BANK} AS bank_profile_id, 'k ' || CAST(event_id % 3 AS STRING) AS remarks FROM {{events}} WHERE event_type = 'view'""",
    "cash_txns": f"""
SELECT event_id AS id, {_DAY} AS txn_date, ts AS created_at, CASE event_id % 6 WHEN 0 THEN 'deposit' WHEN 2 THEN 'deposit' ELSE 'withdraw' END AS type, {_amount(100)} AS amount, 'manual' AS comment FROM {{events}} WHERE event_type = 'error' AND event_id % 2 = 0""",
    "bank_txns": f"""
SELECT event_id AS id, {_DAY} AS txn_date, ts AS created_at, CASE event_id % 6 WHEN 1 THEN 'deposit' WHEN 3 THEN 'deposit' ELSE 'withdraw' END AS type, {_amount(100)} AS amount, 'manual' AS comment, event_id % 5 AS bank_profile_id FROM {{events}} WHERE event_type = 'error' AND event_id % 2 = 1""",
    "suppliers": f"""
SELECT s_suppkey AS id, {code_sql("SUP-", "s_suppkey")} AS supplier_code, s_name AS supplier_name, 'Category ' || CAST(s_nationkey % 4 AS STRING) AS category, '0300' || CAST(s_suppkey AS STRING) AS contact_no, s_suppkey % 29 = 7 AS is_deleted FROM {{supplier}}""",
    "customers": f"""
SELECT c_custkey AS id, {code_sql("CUST-", "c_custkey")} AS customer_code, c_name AS name, '0321' || CAST(c_custkey AS STRING) AS contact_no, lower(c_mktsegment) || '@example.org' AS email, c_custkey % 31 = 0 AS is_deleted FROM {{customer}}""",
    "banks": """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS bank_name, 'Title ' || n_name AS account_title, 'AC-' || CAST(n_nationkey * 37 AS STRING) AS account_number, CASE WHEN n_nationkey % 3 = 0 THEN 'Inactive' WHEN n_nationkey % 3 = 1 THEN 'Active' ELSE 'active' END AS status FROM {nation}""",
    # id 2 was closed later but covers the earlier year: latest by id and latest by date differ
    "snapshots": """
SELECT CAST(1 AS BIGINT) AS id, DATE '1996-01-01' AS date_from, DATE '1996-12-31' AS date_to, CAST(100000 AS DECIMAL(18,2)) AS opening_cash, CAST(250000 AS DECIMAL(18,2)) AS opening_bank, CAST(7000 AS DECIMAL(18,2)) AS opening_profit, CAST(9000 AS DECIMAL(18,2)) AS total_customer_receivable, CAST(8000 AS DECIMAL(18,2)) AS total_supplier_payable
UNION ALL SELECT CAST(2 AS BIGINT), DATE '1995-01-01', DATE '1995-12-31', CAST(40000 AS DECIMAL(18,2)), CAST(60000 AS DECIMAL(18,2)), CAST(NULL AS DECIMAL(18,2)), CAST(NULL AS DECIMAL(18,2)), CAST(5000 AS DECIMAL(18,2))""",
    "balances": f"""
SELECT CAST(1 + s_suppkey % 2 AS BIGINT) AS snapshot_id, 'SUPPLIER' AS balance_type, {code_sql("SUP-", "s_suppkey")} AS code, s_name AS name, CAST(s_acctbal AS DECIMAL(18,2)) AS balance, CASE WHEN s_acctbal < 0 THEN 'ADVANCE' ELSE 'PAYABLE' END AS status FROM {{supplier}}
UNION ALL SELECT CAST(1 + o_custkey % 2 AS BIGINT), 'CUSTOMER', {ref_sql("o_orderkey")}, 'Order ' || CAST(o_orderkey AS STRING), CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)), 'PENDING' FROM {{orders}}""",
    # odd months of both years under their own snapshot, January 1996 again under snapshot 2
    "profit_months": """
SELECT snapshot_id, report_year, report_month, CAST(t AS DECIMAL(18,2)) AS total_sales, CAST(t * 0.7 AS DECIMAL(18,2)) AS total_purchase, CAST(t * 0.3 AS DECIMAL(18,2)) AS base_profit,
 CAST(t * 0.01 AS DECIMAL(18,2)) AS supplier_adjustment, CAST(t * 0.02 AS DECIMAL(18,2)) AS customer_adjustment, CAST(t * 0.05 AS DECIMAL(18,2)) AS total_expense, CAST(t * 0.24 AS DECIMAL(18,2)) AS net_profit,
 CASE WHEN snapshot_id = 1 THEN DATE '1996-01-01' ELSE DATE '1995-01-01' END AS archive_from, CASE WHEN snapshot_id = 1 THEN DATE '1996-12-31' ELSE DATE '1995-12-31' END AS archive_to
 FROM (SELECT CAST(CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 1 ELSE 2 END AS BIGINT) AS snapshot_id, CAST(year(o_orderdate) AS INT) AS report_year, CAST(month(o_orderdate) AS INT) AS report_month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS t
  FROM {orders} WHERE o_orderdate < TIMESTAMP '1997-01-01' AND month(o_orderdate) % 2 = 1 GROUP BY 1, 2, 3
  UNION ALL SELECT CAST(2 AS BIGINT), CAST(1996 AS INT), CAST(1 AS INT), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) FROM {orders} WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-01-15') m""",
    # the purge of snapshot 2 has been logged, that of snapshot 1 has not
    "logs": "SELECT CAST(1 AS BIGINT) AS id, CAST(1997 - year(o_orderdate) AS BIGINT) AS snapshot_id, DATE '1995-01-01' AS date_from, DATE '1995-12-31' AS date_to, "
    + ", ".join(
        f"count(CASE WHEN o_orderkey % 8 = {i} THEN 1 END) AS {m.table}_count" for i, m in enumerate(MODULES)
    )
    + ", CAST(NULL AS BIGINT) AS customer_payments_count, CAST(0 AS BIGINT) AS supplier_payments_count, count(*) AS purchase_entries_count,"
    " CAST(NULL AS TIMESTAMP) AS deleted_at, TIMESTAMP '2002-01-05 00:00:00' AS archived_at, 'archive-1995.zip' AS backup_file"
    " FROM {orders} WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY year(o_orderdate)",
    # unchecked intake requests: all text, as a form sends them
    "requests": f"""
SELECT event_id AS request_id, CASE event_type WHEN 'purchase' THEN 'customer' WHEN 'signup' THEN 'registered' WHEN 'click' THEN 'supplier' WHEN 'view' THEN 'expense' ELSE CASE event_id % 3 WHEN 0 THEN 'cash' WHEN 1 THEN 'bank' ELSE 'purchase' END END AS kind,
 CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 13 = 1 THEN NULL WHEN event_type = 'purchase' THEN {ref_sql(_WALKIN_KEY)} WHEN event_type = 'click' THEN {code_sql("SUP-", "user_id")} ELSE {code_sql("CUST-", "user_id")} END AS party,
 CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '-5' WHEN 3 THEN 'abc' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END AS amount,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST({_DAY} AS STRING) END AS entry_date,
 CASE event_id % 5 WHEN 0 THEN 'Bank' WHEN 1 THEN 'Cash' WHEN 2 THEN 'bank' WHEN 3 THEN '' ELSE NULL END AS payment_method,
 CASE WHEN event_id % 7 < 5 THEN CAST(event_id % 7 AS STRING) END AS bank_profile_id,
 CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'adjustment' WHEN 2 THEN 'deposit' WHEN 3 THEN 'withdraw' ELSE NULL END AS type,
 CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'note ' || CAST(event_id % 9 AS STRING) END AS note
 FROM {{events}}""",
}

# Spark only: one row per sale of the module, with its nested lines
_COUNT = "1 + o_orderkey % 3"
_RATE = "CAST(70 + o_custkey % 10 AS DECIMAL(18,2))"


def _elements(fields: str, count: str = _COUNT) -> str:
    return f"to_json(transform(sequence(1, CAST({count} AS INT)), i -> named_struct({fields})))"


_PRICED = """'type', CASE (o_orderkey + i) % 4 WHEN 0 THEN '' WHEN 1 THEN 'Umrah' WHEN 2 THEN 'Visit' ELSE NULL END,
 'persons', CAST((o_custkey + i) % 5 AS INT), 'rate', CAST(100 + (o_orderkey * i) % 400 AS INT),
 'total', CASE (o_orderkey + i) % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE CAST((o_custkey + i) % 5 * (100 + (o_orderkey * i) % 400) AS INT) END"""
_LABELLED = """'description', CASE WHEN o_orderkey % 3 = 0 THEN 'D' || i END, 'text', CASE WHEN (o_orderkey + i) % 2 = 0 THEN 'T' || i ELSE '' END,
 'route', CASE WHEN o_custkey % 4 <> 0 THEN 'R' || i END, '{0}', CASE WHEN o_custkey % 6 = 0 THEN 'n/a' ELSE CAST(50 + (o_custkey * i) % 90 AS STRING) END"""
_STAYS = {
    "hotel": "'Hotel ' || CAST((o_custkey + i) % 9 AS STRING)",
    "type": "CASE WHEN (o_orderkey + i) % 3 = 0 THEN '' ELSE 'quad' END",
    "rooms": "CAST((o_orderkey + i) % 3 AS STRING)",
    "nights": "CAST((o_custkey + i) % 4 AS STRING)",
    "total": "CAST(((o_orderkey + i) % 3) * ((o_custkey + i) % 4) * 55 AS STRING)",
}
_FLIGHT = {
    "airline": "CASE WHEN (o_custkey + i) % 3 = 0 THEN '' ELSE 'PK' || CAST((o_custkey + i) % 7 AS STRING) END",
    "from": "CASE WHEN (o_orderkey + i) % 5 = 0 THEN '' ELSE 'LHE' END",
    "to": "CASE WHEN (o_custkey + i) % 2 = 0 THEN 'JED' ELSE 'MED' END",
}


def _pick(fields: dict[str, str], *names: str) -> str:
    return ", ".join(f"'{n}', {fields[n]}" for n in names or fields)


def _parallel(expression: str, count: str = _COUNT) -> str:
    return f"to_json(transform(sequence(1, CAST({count} AS INT)), i -> {expression}))"


_HEAD = f"{ref_sql('o_orderkey')} AS ref_no, o_orderkey % 17 = 0 AS is_deleted, CAST(o_orderdate AS DATE) AS booking_date"


def _module(i: int, columns: str) -> str:
    return f"SELECT {_HEAD}, {columns} FROM {{orders}} WHERE o_orderkey % 8 = {i}"


NESTED = {
    "bookings": _module(
        0,
        f"""c_name AS customer_name, CAST(o_custkey % 4 AS INT) AS adult_count, CAST(o_custkey % 3 AS INT) AS child_count, CAST(o_custkey % 2 AS INT) AS infant_count,
 CAST(900 AS DECIMAL(18,2)) AS adult_rate, CAST(700 AS DECIMAL(18,2)) AS child_rate, CAST(200 AS DECIMAL(18,2)) AS infant_rate,
 {_RATE} AS flight_sar_rate, {_RATE} AS hotel_sar_rate, {_RATE} AS visa_sar_rate, {_RATE} AS transport_sar_rate, CASE WHEN o_custkey % 7 <> 0 THEN {_RATE} END AS ziyarat_sar_rate,
 CASE WHEN o_custkey % 5 <> 0 THEN {_elements(_pick(_FLIGHT))} END AS flights, {_elements(_pick(_STAYS))} AS hotels,
 CASE WHEN o_custkey % 9 <> 0 THEN {_elements(_PRICED)} END AS visa, {_elements(_LABELLED.format("amount"))} AS transport, {_elements(_LABELLED.format("amount"), "o_custkey % 2 + 1")} AS ziyarat""",
    ).replace("{orders}", "{orders} JOIN {customer} ON c_custkey = o_custkey"),
    "hotels": _module(
        1,
        f"""CAST(NULL AS STRING) AS agent_name, {_parallel(_STAYS["hotel"])} AS hotel_name, {_parallel(_STAYS["type"])} AS hotel_type, {_parallel(_STAYS["rooms"])} AS hotel_rooms,
 {_parallel(_STAYS["nights"])} AS hotel_nights, {_parallel(_STAYS["total"])} AS hotel_total, {_parallel("'Makkah'")} AS hotel_location,
 {_parallel("CAST(date_add(CAST(o_orderdate AS DATE), i) AS STRING)")} AS hotel_checkin, {_parallel("CAST(date_add(CAST(o_orderdate AS DATE), i + 2) AS STRING)", "o_orderkey % 3")} AS hotel_checkout,
 {_parallel("'55'")} AS hotel_rate, {_RATE} AS sar_rate""",
    ),
    **{
        m.table: _module(i, f"{_elements(_PRICED)} AS rows, {_RATE} AS pkr_rate")
        for i, m in enumerate(MODULES)
        if m.table in ("visa", "card", "groups")
    },
    "ticketing": _module(
        5,
        f"""CAST(o_custkey % 4 AS INT) AS adult_qty, CAST(o_custkey % 3 AS INT) AS child_qty, CAST(o_custkey % 2 AS INT) AS infant_qty,
 CAST(900 AS DECIMAL(18,2)) AS adult_rate, CAST(700 AS DECIMAL(18,2)) AS child_rate, CAST(200 AS DECIMAL(18,2)) AS infant_rate, {_RATE} AS pkr_rate,
 {_parallel(_FLIGHT["from"])} AS flight_from, {_parallel(_FLIGHT["to"])} AS flight_to, {_parallel(_FLIGHT["airline"])} AS airline""",
    ),
    **{
        m.table: _module(i, f"{_elements(_LABELLED.format('sar'))} AS rows, {_RATE} AS pkr_rate")
        for i, m in enumerate(MODULES)
        if m.table in ("transport", "ziyarat")
    },
}
# sequence(1, 0) counts down, so an empty list needs its own arm
NESTED["hotels"] = NESTED["hotels"].replace(
    "to_json(transform(sequence(1, CAST(o_orderkey % 3 AS INT))",
    "to_json(transform(slice(sequence(1, 3), 1, CAST(o_orderkey % 3 AS INT))",
)


def depends(text: str) -> list[str]:
    names = (*BASE, *VIEWS)
    return [n for n in names if "{" + n + "}" in text]


def base_frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def view_frame(spark: SparkSession, name: str, books: Books) -> DataFrame:
    text = VIEWS.get(name) or NESTED[name]
    return spark.sql(text, **{needed: getattr(books, needed) for needed in depends(text)})


def load(spark: SparkSession, sf_dir: str) -> Books:
    """Books over one test-data folder; each table is planned on first use."""
    books = Books()
    for name in BASE:
        books.define(name, lambda n=name: base_frame(spark, sf_dir, n))
    for name in (*VIEWS, *NESTED):
        books.define(name, lambda n=name: view_frame(spark, n, books))
    return books


def with_prefix(query: str) -> str:
    """Put the views a DuckDB query names (as ``fx_<view>``) in front of it as CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in depends(VIEWS[name]):
            if needed in VIEWS:
                add(needed)
        ordered.append(name)

    for name in VIEWS:
        if f"fx_{name}" in query:
            add(name)
    if not ordered:
        return query
    names = {b: b for b in BASE} | {v: f"fx_{v}" for v in VIEWS}
    ctes = ",\n".join(f"fx_{n} AS ({VIEWS[n].format(**names)})" for n in ordered)
    body = query.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

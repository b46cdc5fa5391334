"""Plain lists, counts, exports and imports."""

from tallybook.functions.catalogue import ARCHIVE, BY_NAME, DATED
from tallybook.functions.modules import MODULES


def label(field: str, column: str = "prefix") -> str:
    arms = " ".join(f"WHEN '{m.prefix}' THEN '{getattr(m, field)}'" for m in MODULES)
    return f"CASE {column} {arms} END"


def rank(column: str = "prefix") -> str:
    arms = " ".join(f"WHEN '{m.prefix}' THEN {i}" for i, m in enumerate(MODULES))
    return f"CASE {column} {arms} END"


SALES_COLUMNS = "id, ref_no, customer_code, customer_name, booking_date, created_at, total_pkr, payment_status, purchase_status, is_deleted"
WALKIN = "(customer_code IS NULL OR customer_code = '')"
PROFILED = (
    "sales purchases customer_payments supplier_payments purchase_payments expenses cash_txns bank_txns"
    " suppliers customers banks balances profit_months"
).split()


def counts(tables: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM fx_{t} {where}" for t, where in tables.items()
    )


def tables_counted(where: dict[str, str], others: tuple[str, ...]) -> str:
    """(table_name, row_count) of module tables and the named tables; ``where`` by date column."""
    day = where.get("booking_date", "true")
    modules = [
        f"SELECT '{m.table}' AS table_name, count(*) AS row_count FROM orders WHERE o_orderkey % 8 = {i} AND ({day.replace('booking_date', 'CAST(o_orderdate AS DATE)')})"
        for i, m in enumerate(MODULES)
    ]
    dated = [
        f"SELECT '{t.name}', count(*) FROM fx_{t.frame} WHERE {where.get(t.day, 'true')}" for t in DATED if t.day != "booking_date"
    ]
    return " UNION ALL ".join([*modules, *dated, *(f"SELECT '{BY_NAME[t].name}', count(*) FROM fx_{BY_NAME[t].frame}" for t in others)])


def between(first: str, last: str, keep: str = "") -> dict[str, str]:
    """The condition on each date column; ``keep`` inverts it, undated rows stay."""
    out = {}
    for column in ("booking_date", "created_at", "payment_date", "expense_date"):
        value = f"CAST({column} AS DATE)"
        test = f"{value} BETWEEN DATE '{first}' AND DATE '{last}'"
        out[column] = f"NOT COALESCE({test}, false)" if keep else test
    return out


ARCHIVES = tuple(t.name for t in ARCHIVE)

SQL = {
    "sales_unified": f"SELECT {label('table')} AS type, {SALES_COLUMNS} FROM fx_sales",
    "bookings_active": "SELECT id, ref_no, customer_name, booking_date, total_pkr FROM fx_sales WHERE ref_no LIKE 'PKG-%' AND NOT is_deleted ORDER BY id DESC",
    "sales_lookup": "SELECT ref_no, customer_code, customer_name, booking_date, total_pkr FROM fx_sales WHERE NOT is_deleted AND ref_no IN (SELECT ref_no FROM fx_purchase_payments)",
    "sales_deleted_lookup": "SELECT ref_no, customer_code, customer_name, booking_date, total_pkr FROM fx_sales WHERE is_deleted AND ref_no IN (SELECT ref_no FROM fx_purchases WHERE is_deleted)",
    "suppliers_active": "SELECT id, supplier_code, supplier_name, category, contact_no FROM fx_suppliers WHERE NOT is_deleted ORDER BY supplier_code",
    "banks_list": "SELECT * FROM fx_banks ORDER BY id",
    "bank_profiles_active": "SELECT id, bank_name, account_title, account_number FROM fx_banks WHERE LOWER(status) = 'active' ORDER BY id",
    "customers_list": "SELECT id, customer_code, name, contact_no, email FROM fx_customers WHERE NOT is_deleted ORDER BY name",
    "customers_search": "SELECT id, customer_code, name, contact_no, email FROM fx_customers WHERE NOT is_deleted AND (name ILIKE '%00001%' OR customer_code ILIKE '%00001%') ORDER BY name",
    "expense_list": "SELECT e.id, expense_date, title, amount, payment_method, bank_profile_id, bank_name, remarks FROM fx_expenses e LEFT JOIN fx_banks b ON b.id = e.bank_profile_id ORDER BY expense_date DESC, e.id DESC",
    "live_data_start": "SELECT MIN(created_at) AS first_date FROM fx_sales WHERE ref_no LIKE 'PKG-%'",
    "table_profile": counts(dict.fromkeys(PROFILED, "")),
    "capacity_projection": f"""
WITH c AS ({counts(dict.fromkeys(PROFILED, ""))}), t AS (SELECT CAST(sum(row_count) AS BIGINT) AS total_rows FROM c)
SELECT total_rows, round(CAST(120.0 AS DOUBLE) / total_rows * 1024, 2) AS avg_row_kb,
 CAST(floor(CAST(380.0 AS DOUBLE) / (CAST(120.0 AS DOUBLE) / total_rows)) AS BIGINT) AS possible_more_rows FROM t""",
    "manifest_expired": "SELECT 'backup-' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '.zip' AS name, ts AS created_at FROM events WHERE ts < TIMESTAMP '2024-03-15 00:00:00' - INTERVAL 60 DAY",
    "manifest_list": "SELECT 'backup-' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '.zip' AS name, ts AS created_at FROM events ORDER BY name DESC",
    "manifest_latest": "SELECT 'backup-' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '.zip' AS name, ts AS created_at FROM events ORDER BY event_id DESC LIMIT 1",
    "export_range": tables_counted(between("1997-01-01", "1998-12-31"), ARCHIVES),
    "export_full": tables_counted({}, ("purchase_payments", "banks", "suppliers", "customers", *ARCHIVES)),
    "purge_range": tables_counted(between("1997-01-01", "1998-12-31", "keep"), ()),
    # close 1 has not been purged, close 2 has
    "purge_close": tables_counted(between("1996-01-01", "1996-12-31", "keep"), ()),
    "purge_close_again": tables_counted({}, ()),
    "export_roundtrip": "SELECT * FROM fx_purchases",
    "import_normalize": """
SELECT event_id AS id, CASE WHEN event_id % 7 > 1 THEN date_trunc('millisecond', ts) END AS sent_at,
 CASE WHEN event_id % 5 > 1 THEN -CAST(value AS DECIMAL(18,2)) END AS amount, event_id % 3 = 0 AS is_deleted,
 CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
 CASE WHEN event_id % 6 <> 0 THEN 'a "' || event_type || '", b' END AS note FROM events""",
    "import_merge": """
SELECT id, ref_no, payment_date, CASE WHEN payment_date < DATE '1997-01-01' THEN CAST(0 AS DECIMAL(18,2)) ELSE amount END AS amount,
 type, payment_method, bank_profile_id, is_deleted FROM fx_customer_payments""",
    "sales_all": f"SELECT {label('report')} AS type, id, ref_no, customer_name, booking_date, total_pkr FROM fx_sales WHERE NOT is_deleted ORDER BY booking_date DESC",
    "sales_recent": f"SELECT {label('report')} AS type, id, ref_no, customer_name, booking_date, total_pkr, created_at FROM fx_sales WHERE NOT is_deleted AND created_at >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 30 DAY",
    "purchase_status_pending": "SELECT ref_no, customer_name, booking_date, purchase_status FROM fx_sales WHERE NOT is_deleted AND purchase_status IN ('PENDING','PARTIAL')",
    "walkin_pending": f"SELECT ref_no, customer_name, payment_status FROM fx_sales WHERE NOT is_deleted AND payment_status IN ('PENDING','PARTIAL') AND {WALKIN}",
}

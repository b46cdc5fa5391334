"""Profit, adjustments, purchase reports, period close."""

from oracles.ledgers import DEC, REF_NAME, js_round
from oracles.lists import label, rank
from tallybook.functions.modules import MODULES

MEASURES = "total_sales total_purchase base_profit supplier_adjustment customer_adjustment total_expense".split()
START, END = "DATE '1997-01-01'", "DATE '1998-12-31'"
PREVIOUS = f"(SELECT {{0}} FROM fx_snapshots WHERE date_to < {END} ORDER BY date_to DESC, id DESC LIMIT 1)"


def live(sales_day: str = "created_at") -> str:
    def part(measure: str, value: str, table: str, day: str, where: str) -> str:
        return f"SELECT CAST(year({day}) AS INT) AS y, CAST(month({day}) AS INT) AS m, '{measure}' AS k, {value} AS v FROM {table} WHERE {where}"

    rows = " UNION ALL ".join(
        (
            part("total_sales", "total_pkr", "fx_sales", sales_day, "NOT is_deleted"),
            part("total_purchase", "purchase_pkr", "fx_purchases", "created_at", "NOT is_deleted"),
            part("base_profit", "profit", "fx_purchases", "created_at", "NOT is_deleted"),
            part("supplier_adjustment", "amount", "fx_supplier_payments", "payment_date", "lower(type) = 'adjustment'"),
            part("customer_adjustment", "amount", "fx_customer_payments", "payment_date", "lower(type) = 'adjustment'"),
            part("total_expense", "amount", "fx_expenses", "expense_date", "true"),
        )
    )
    sums = ", ".join(f"COALESCE(sum(v) FILTER (k = '{m}'), 0) AS {m}" for m in MEASURES)
    return f"SELECT y, m, {sums} FROM ({rows}) u GROUP BY y, m"


NET = "base_profit + supplier_adjustment - customer_adjustment - total_expense"
MONTHS = f"""
 arch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_month ORDER BY snapshot_id DESC) AS rn FROM fx_profit_months WHERE report_year = 1996) t WHERE rn = 1),
 lv AS ({live()}),
 mon AS (SELECT CAST(range AS INT) AS m FROM range(1, 13)),
 comb AS (SELECT mon.m AS month, {", ".join(f"CASE WHEN report_month IS NOT NULL THEN arch.{x} ELSE COALESCE(lv.{x}, 0) END AS {x}" for x in MEASURES)},
  CASE WHEN report_month IS NOT NULL THEN arch.net_profit ELSE COALESCE(lv.base_profit + lv.supplier_adjustment - lv.customer_adjustment - lv.total_expense, 0) END AS net_profit,
  CASE WHEN report_month IS NOT NULL THEN 'archive' ELSE 'live' END AS source
  FROM mon LEFT JOIN arch ON report_month = mon.m LEFT JOIN lv ON lv.y = 1996 AND lv.m = mon.m)"""
ROUNDED = ", ".join(f"{js_round(x)} AS {x}" for x in (*MEASURES, "net_profit"))


def opening(method: str, manual: str, column: str) -> str:
    since = f"COALESCE({PREVIOUS.format('date_to')}, DATE '1970-01-01')"
    counted = f"lower(payment_method) = '{method}' AND lower(COALESCE(type, '')) <> 'adjustment'"
    between = f"> {since} AND {{0}} <= {END}"
    return f"""
SELECT CAST(COALESCE({PREVIOUS.format(column)}, 0) + COALESCE(sum(b), 0) AS {DEC}) AS {column} FROM (
 SELECT sum(amount) AS b FROM fx_customer_payments WHERE {counted} AND NOT is_deleted AND payment_date {between.format('payment_date')}
 UNION ALL SELECT -sum(amount) FROM fx_supplier_payments WHERE {counted} AND payment_date {between.format('payment_date')}
 UNION ALL SELECT -sum(amount) FROM fx_expenses WHERE lower(payment_method) = '{method}' AND expense_date {between.format('expense_date')}
 UNION ALL SELECT sum(CASE WHEN type = 'deposit' THEN amount ELSE -amount END) FROM fx_{manual} WHERE CAST(created_at AS DATE) {between.format('CAST(created_at AS DATE)')}) x"""


CUSTOMER_OUT = f"""
SELECT x.ref_no, customer_name, payment_status, total_pkr, CAST(COALESCE(received, 0) AS {DEC}) AS received, CAST(total_pkr - COALESCE(received, 0) AS {DEC}) AS balance FROM fx_sales x
LEFT JOIN (SELECT ref_no, sum(amount) AS received FROM fx_customer_payments WHERE payment_date <= {END} GROUP BY ref_no) cp ON cp.ref_no = x.ref_no
WHERE NOT is_deleted AND booking_date BETWEEN {START} AND {END} AND payment_status IN ('PENDING','PARTIAL') AND total_pkr - COALESCE(received, 0) > 0"""
SUPPLIER_OUT = f"""
SELECT supplier_code, supplier_name, balance, CASE WHEN balance < 0 THEN 'ADVANCE' ELSE 'PAYABLE' END AS status FROM (
 SELECT s.supplier_code, s.supplier_name, CAST(COALESCE(past.balance, 0) + COALESCE(bought, 0) - COALESCE(paid, 0) AS {DEC}) AS balance FROM fx_suppliers s
 LEFT JOIN fx_balances past ON past.code = s.supplier_code AND balance_type = 'SUPPLIER' AND snapshot_id = {PREVIOUS.format('id')}
 LEFT JOIN (SELECT supplier_code, sum(purchase_pkr) AS bought FROM fx_purchases WHERE NOT is_deleted AND CAST(created_at AS DATE) BETWEEN {START} AND {END} GROUP BY supplier_code) pe ON pe.supplier_code = s.supplier_code
 LEFT JOIN (SELECT supplier_id, sum(amount) AS paid FROM fx_supplier_payments WHERE payment_date BETWEEN {START} AND {END} GROUP BY supplier_id) sp ON sp.supplier_id = s.id
 WHERE NOT s.is_deleted) t WHERE balance <> 0"""
OPENING_PROFIT = f"SELECT CAST(COALESCE(sum(net_profit), 0) AS {DEC}) AS opening_profit FROM fx_profit_months WHERE archive_to <= {END}"
HEADER = f"""
SELECT CAST((SELECT max(id) + 1 FROM fx_snapshots) AS BIGINT) AS id, {START} AS date_from, {END} AS date_to, ({opening('cash', 'cash_txns', 'opening_cash')}) AS opening_cash,
 ({opening('bank', 'bank_txns', 'opening_bank')}) AS opening_bank, ({OPENING_PROFIT}) AS opening_profit,
 CAST((SELECT COALESCE(sum(balance), 0) FROM ({CUSTOMER_OUT}) c) AS {DEC}) AS total_customer_receivable, CAST((SELECT COALESCE(sum(balance), 0) FROM ({SUPPLIER_OUT}) s) AS {DEC}) AS total_supplier_payable"""


def close_profit(first: str, last: str, snapshot: str, sales_day: str = "created_at") -> str:
    sums = ", ".join(f"CAST(COALESCE({m}, 0) AS {DEC}) AS {m}" for m in MEASURES)
    return f"""
SELECT CAST(year(d) AS INT) AS report_year, CAST(month(d) AS INT) AS report_month, {sums}, CAST(COALESCE({NET}, 0) AS {DEC}) AS net_profit, {first} AS archive_from, {last} AS archive_to, CAST({snapshot} AS BIGINT) AS snapshot_id
FROM (SELECT CAST(range AS DATE) AS d FROM range(CAST({first} AS TIMESTAMP), CAST({last} AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) mm LEFT JOIN ({live(sales_day)}) l ON y = year(d) AND m = month(d)"""


SUMS = ", ".join(f"CAST(sum({c}) AS {DEC}) AS {c}" for c in ("sale_pkr", "purchase_pkr", "profit"))
DETAIL = "ref_no, item, sale_sar, sale_rate, sale_pkr, purchase_sar, purchase_rate, purchase_pkr, profit, supplier_code, supplier_name, created_at"


def purged(table: str, name: str, day: str) -> str:
    return f"SELECT '{name}' AS table_name, count(CASE WHEN {day} BETWEEN {START} AND {END} THEN 1 END) AS purged FROM {table}"


PURGE = " UNION ALL ".join(
    (
        f"SELECT {label('table')} AS table_name, count(CASE WHEN booking_date BETWEEN {START} AND {END} THEN 1 END) AS purged FROM fx_sales GROUP BY 1",
        purged("fx_purchases", "purchase_entries", "CAST(created_at AS DATE)"),
        purged("fx_customer_payments", "customer_payments", "payment_date"),
        purged("fx_supplier_payments", "supplier_payments", "payment_date"),
        purged("fx_expenses", "expense_ledger", "expense_date"),
        purged("fx_bank_txns", "bank_transactions", "CAST(created_at AS DATE)"),
        purged("fx_cash_txns", "cash_transactions", "CAST(created_at AS DATE)"),
    )
)


def in_1996(day: str) -> str:
    return f"{day} BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"


SQL = {
    "monthly_profit": f"""
WITH {MONTHS} SELECT month, monthname(make_date(1996, month, 1)) AS month_name, {ROUNDED}, source FROM comb""",
    "profit_month": f"WITH {MONTHS} SELECT source, {ROUNDED} FROM comb WHERE month = 1",
    "profit_month_live": f"WITH {MONTHS} SELECT source, {ROUNDED} FROM comb WHERE month = 2",
    "profit_year": f"""
WITH {MONTHS}, s AS (SELECT count(*) FILTER (source = 'archive') AS n, {", ".join(f"sum({m}) AS {m}" for m in MEASURES)} FROM comb)
SELECT CASE WHEN n = 12 THEN 'archive' WHEN n > 0 THEN 'combined' ELSE 'live' END AS source, {", ".join(f"{js_round(m)} AS {m}" for m in MEASURES)}, {js_round(f"({NET})")} AS net_profit FROM s""",
    "sale_adjustments": f"""
WITH ref AS (SELECT ref_no, sum(total_pkr) FILTER (NOT is_deleted) AS a FROM fx_sales GROUP BY ref_no), code AS (SELECT customer_code, sum(total_pkr) FILTER (NOT is_deleted) AS a FROM fx_sales WHERE customer_code <> '' GROUP BY customer_code),
 rn AS (SELECT * FROM (SELECT ref_no, customer_name, row_number() OVER (PARTITION BY ref_no ORDER BY {rank()}, id) AS k FROM fx_sales WHERE customer_name <> '') t WHERE k = 1),
 cn AS (SELECT * FROM (SELECT customer_code, customer_name, row_number() OVER (PARTITION BY customer_code ORDER BY {rank()}, id) AS k FROM fx_sales WHERE customer_name <> '' AND customer_code <> '') t WHERE k = 1),
 j AS (SELECT cp.*, CASE WHEN cp.ref_no LIKE 'CUST-%' THEN code.a ELSE ref.a END AS sale, CASE WHEN cp.ref_no LIKE 'CUST-%' THEN cn.customer_name ELSE rn.customer_name END AS nm
  FROM fx_customer_payments cp LEFT JOIN ref ON ref.ref_no = cp.ref_no LEFT JOIN code ON code.customer_code = cp.ref_no LEFT JOIN rn ON rn.ref_no = cp.ref_no LEFT JOIN cn ON cn.customer_code = cp.ref_no WHERE cp.type = 'adjustment')
SELECT id, payment_date AS date, ref_no, payment_method, COALESCE(nm, 'Unknown Customer') AS customer_name, CAST(round(COALESCE(sale, 0), 0) AS BIGINT) AS amount,
 CAST(round(amount, 0) AS BIGINT) AS adjustment_amount, CAST(round(COALESCE(sale, 0) - amount, 0) AS BIGINT) AS net_amount FROM j""",
    "supplier_adjustments": "SELECT s.id AS supplier_id, supplier_code, supplier_name, payment_date, amount AS adjustment_amount FROM fx_suppliers s JOIN fx_supplier_payments p ON p.supplier_id = s.id WHERE lower(payment_method) = 'adjustment' OR lower(type) = 'adjustment'",
    "supplier_adjustments_range": f"SELECT s.id AS supplier_id, supplier_code, supplier_name, payment_date, amount AS adjustment_amount FROM fx_suppliers s JOIN fx_supplier_payments p ON p.supplier_id = s.id WHERE (lower(payment_method) = 'adjustment' OR lower(type) = 'adjustment') AND payment_date BETWEEN {START} AND {END}",
    "supplier_purchase_detail": f"""
SELECT p.id, ref_no, item, sale_sar, sale_rate, sale_pkr, purchase_sar, purchase_rate, purchase_pkr, CAST(sale_pkr - purchase_pkr AS {DEC}) AS profit, created_at AS booking_date, s.supplier_name
FROM fx_purchases p LEFT JOIN fx_suppliers s ON s.supplier_code = p.supplier_code WHERE NOT p.is_deleted AND (purchase_sar > 0 OR purchase_rate > 0)""",
    "supplier_names": "SELECT 'ALL' AS supplier_name UNION ALL SELECT supplier_name FROM fx_suppliers WHERE NOT is_deleted",
    "purchase_list": f"""
WITH {REF_NAME}, p AS (SELECT ref_no, {SUMS}, min(created_at) AS created_at FROM fx_purchases WHERE NOT is_deleted GROUP BY ref_no)
SELECT p.ref_no, name AS customer_name, sale_pkr, purchase_pkr, profit, created_at FROM p LEFT JOIN refname n ON n.ref_no = p.ref_no""",
    "purchase_list_search": f"""
WITH {REF_NAME}, p AS (SELECT ref_no, {SUMS}, min(created_at) AS created_at FROM fx_purchases WHERE NOT is_deleted AND CAST(created_at AS DATE) BETWEEN {START} AND {END} GROUP BY ref_no)
SELECT p.ref_no, name AS customer_name, sale_pkr, purchase_pkr, profit, created_at FROM p LEFT JOIN refname n ON n.ref_no = p.ref_no WHERE p.ref_no ILIKE '%pkg-%' OR name ILIKE '%pkg-%'""",
    "purchase_detail": f"WITH {REF_NAME} SELECT {DETAIL.replace('ref_no', 'p.ref_no', 1)}, name AS customer_name FROM fx_purchases p LEFT JOIN refname n ON n.ref_no = p.ref_no WHERE NOT is_deleted",
    "purchase_detail_totals": f"SELECT ref_no, {SUMS} FROM fx_purchases WHERE NOT is_deleted GROUP BY ref_no",
    "purchase_detail_deleted": f"SELECT {DETAIL} FROM fx_purchases WHERE is_deleted",
    "purchase_deleted_totals": f"SELECT ref_no, {SUMS} FROM fx_purchases WHERE is_deleted GROUP BY ref_no",
    "purchase_count": "SELECT ref_no, count(*) AS total FROM fx_purchases WHERE NOT is_deleted GROUP BY ref_no",
    "missing_supplier": f"""
WITH n AS (SELECT ref_no, max(customer_name) AS name FROM fx_sales WHERE NOT is_deleted GROUP BY ref_no)
SELECT id, p.ref_no, COALESCE(name, '') AS customer_name, supplier_name, supplier_code, CAST(purchase_sar * purchase_rate AS {DEC}) AS row_amount, 'COMPLETE' AS status, 'Supplier missing in this row' AS note
FROM fx_purchases p LEFT JOIN n ON n.ref_no = p.ref_no WHERE NOT is_deleted AND purchase_sar > 0 AND purchase_rate > 0 AND (supplier_name IS NULL OR supplier_name = '' OR supplier_code IS NULL OR supplier_code = '')""",
    "deleted_report": f"""
WITH {REF_NAME}
SELECT {label('deleted')} AS type, ref_no, customer_name, booking_date, CAST(total_pkr AS {DEC}) AS amount FROM fx_sales WHERE is_deleted
UNION ALL SELECT 'PURCHASE', p.ref_no, COALESCE(name, '-'), CAST(min(created_at) AS DATE), CAST(sum(purchase_pkr) AS {DEC}) FROM fx_purchases p LEFT JOIN refname n ON n.ref_no = p.ref_no WHERE is_deleted GROUP BY p.ref_no, name
UNION ALL SELECT 'SUPPLIER', supplier_code, supplier_name, NULL, NULL FROM fx_suppliers WHERE is_deleted
UNION ALL SELECT 'CUSTOMER', customer_code, name, NULL, NULL FROM fx_customers WHERE is_deleted""",
    "customer_outstanding": CUSTOMER_OUT,
    "supplier_outstanding": SUPPLIER_OUT,
    "opening_cash": opening("cash", "cash_txns", "opening_cash"),
    "opening_bank": opening("bank", "bank_txns", "opening_bank"),
    "opening_profit": OPENING_PROFIT,
    "snapshot_header": HEADER,
    "snapshot_publish": HEADER,
    "snapshot_balances": f"""
SELECT CAST(3 AS BIGINT) AS snapshot_id, 'CUSTOMER' AS balance_type, ref_no AS code, customer_name AS name, balance, payment_status AS status FROM ({CUSTOMER_OUT}) c
UNION ALL SELECT 3, 'SUPPLIER', supplier_code, supplier_name, balance, status FROM ({SUPPLIER_OUT}) s""",
    "snapshot_profit": close_profit(START, END, "3"),
    "rearchive_profit": f"""
WITH f AS ({close_profit("DATE '1996-01-01'", "DATE '1996-12-31'", "1", "booking_date")})
SELECT snapshot_id, report_year, report_month, {", ".join(f"CAST({m} AS {DEC}) AS {m}" for m in (*MEASURES, "net_profit"))}, archive_from, archive_to FROM fx_profit_months WHERE NOT (snapshot_id = 1 AND report_year = 1996)
UNION ALL SELECT snapshot_id, report_year, report_month, {", ".join((*MEASURES, "net_profit"))}, archive_from, archive_to FROM f""",
    "archive_list": f"""
SELECT s.id, date_from, date_to, {", ".join(f"CAST(COALESCE({c}, 0) AS {DEC}) AS {c}" for c in ("total_customer_receivable", "total_supplier_payable", "opening_cash", "opening_bank", "opening_profit"))},
 CASE WHEN EXISTS (SELECT 1 FROM fx_logs l WHERE l.snapshot_id = s.id) THEN 1 ELSE 0 END AS has_log, CAST(COALESCE((SELECT sum(net_profit) FROM fx_profit_months a WHERE a.snapshot_id = s.id), 0) AS {DEC}) AS total_profit FROM fx_snapshots s""",
    "archive_view_balances": f"SELECT CASE WHEN lower(balance_type) LIKE '%customer%' THEN 'customers' ELSE 'suppliers' END AS side, code, name, CAST(balance AS {DEC}) AS balance FROM fx_balances WHERE snapshot_id = 1",
    "archive_view_profit": f"SELECT report_year, report_month, CAST(total_sales AS {DEC}) AS total_sales, CAST(total_purchase AS {DEC}) AS total_purchase, CAST(net_profit AS {DEC}) AS net_profit FROM fx_profit_months WHERE snapshot_id = 2",
    "archive_log": "SELECT id, snapshot_id, COALESCE(deleted_at, archived_at) AS deleted_at, "
    + ", ".join(f"COALESCE({m.table}_count, 0) AS {m.table}_count" for m in MODULES)
    + ", COALESCE(customer_payments_count, 0) AS customer_payments_count, COALESCE(supplier_payments_count, 0) AS supplier_payments_count, COALESCE(purchase_entries_count, 0) AS purchase_entries_count FROM fx_logs WHERE snapshot_id = 2",
    "purge_counts": PURGE,
    "purge_log": "SELECT CAST(1 AS BIGINT) AS snapshot_id, DATE '1996-01-01' AS date_from, DATE '1996-12-31' AS date_to, "
    + ", ".join(f"(SELECT count(*) FROM fx_sales WHERE prefix = '{m.prefix}' AND {in_1996('booking_date')}) AS {m.table}_count" for m in MODULES)
    + f", (SELECT count(*) FROM fx_customer_payments WHERE {in_1996('payment_date')}) AS customer_payments_count, (SELECT count(*) FROM fx_supplier_payments WHERE {in_1996('payment_date')}) AS supplier_payments_count, (SELECT count(*) FROM fx_purchases WHERE {in_1996('CAST(created_at AS DATE)')}) AS purchase_entries_count",
    "purge_retained": f"SELECT ref_no, item, created_at FROM fx_purchases WHERE CAST(created_at AS DATE) NOT BETWEEN {START} AND {END}",
    "snapshot_drop": """
SELECT 'snapshots' AS table_name, count(*) AS row_count FROM fx_snapshots WHERE id <> 2 UNION ALL SELECT 'balances', count(*) FROM fx_balances WHERE snapshot_id <> 2
UNION ALL SELECT 'profit_months', count(*) FROM fx_profit_months WHERE snapshot_id <> 2 UNION ALL SELECT 'logs', count(*) FROM fx_logs WHERE snapshot_id <> 2""",
}

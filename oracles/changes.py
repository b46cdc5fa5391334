"""Upserts, deletes, reference numbers, intake and streams."""

from oracles.ledgers import WALKIN_STATUS
from oracles.nested import NIGHTS, PERSONS, PRICE, RATE, REF, ROOMS, elements
from tallybook.sources.fixtures import prefix_sql

PREFIX = prefix_sql("event_id")
CLEANED = """
req AS (SELECT ref_no, l_partkey, l_suppkey, purchase_sar AS given, CASE WHEN l_partkey % 37 = 5 THEN '' WHEN l_partkey % 3 = 0 THEN ' ' || item ELSE item END AS item,
  sale_sar, CAST(80 AS DECIMAL(18,2)) AS sale_rate, CASE WHEN l_partkey % 6 < 2 THEN CAST(0 AS DECIMAL(18,2)) ELSE purchase_sar END AS purchase_sar, CAST(77.25 AS DECIMAL(18,2)) AS purchase_rate,
  COALESCE(supplier_code, '') AS supplier_code, COALESCE(supplier_name, '') AS supplier_name, id, status, created_at
  FROM fx_purchase_feed WHERE purchase_sar > 0 AND status = 'Purchase'),
cl AS (SELECT *, CAST(sale_sar * sale_rate AS DECIMAL(18,2)) AS sale_pkr, CAST(purchase_sar * purchase_rate AS DECIMAL(18,2)) AS purchase_pkr,
  CAST(CASE WHEN purchase_sar > 0 THEN sale_sar * sale_rate - purchase_sar * purchase_rate ELSE 0 END AS DECIMAL(18,2)) AS profit
  FROM (SELECT *, row_number() OVER (PARTITION BY ref_no, trim(item) ORDER BY l_partkey, l_suppkey, sale_sar, given, created_at) AS rn FROM req WHERE item <> '') t WHERE rn = 1)"""
NEW = "sale_sar sale_rate sale_pkr purchase_sar purchase_rate purchase_pkr profit supplier_code supplier_name".split()
ELIGIBLE = """
el AS (SELECT s.ref_no, CASE WHEN cost > 0 THEN 'Purchase entries exist for this ref' WHEN received > 0 THEN 'Payment has been received for this ref' END AS reason
 FROM fx_sales s LEFT JOIN (SELECT ref_no, sum(purchase_pkr) AS cost FROM fx_purchases WHERE NOT is_deleted GROUP BY ref_no) c ON c.ref_no = s.ref_no
 LEFT JOIN (SELECT ref_no, sum(amount) AS received FROM fx_customer_payments WHERE type = 'payment' GROUP BY ref_no) p ON p.ref_no = s.ref_no)"""
SALE_REQUESTS = """
req AS (SELECT ref_no, CASE WHEN id % 4 = 0 THEN 'CUST-00000001' END AS customer_code, customer_name, booking_date, CAST(total_pkr + 10 AS DECIMAL(18,2)) AS total_pkr FROM fx_sales WHERE payment_status = 'PARTIAL'
 UNION ALL SELECT 'CARD-' || CAST(c_custkey + 50000000 AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN 'CUST-00000002' END, c_name, DATE '2001-09-01', CAST(c_acctbal AS DECIMAL(18,2)) FROM customer)"""
A = "TRY_CAST(amount AS DECIMAL(18,2))"
NONE = f"COALESCE({A}, 0) = 0"
LOW = f"COALESCE({A}, 0) <= 0"


def blank(*columns: str) -> str:
    return " OR ".join(f"COALESCE({c}, '') = ''" for c in columns)


INTAKE = f"""
chk AS (SELECT *, {A} AS a, COALESCE(CASE kind
 WHEN 'customer' THEN CASE WHEN {blank('party')} THEN 'Ref No required' WHEN {LOW} THEN 'Invalid amount' WHEN {blank('entry_date')} THEN 'Date required' END
 WHEN 'registered' THEN CASE WHEN {blank('party')} THEN 'Customer Code is required' WHEN {LOW} THEN 'Amount must be greater than zero' WHEN {blank('entry_date')} THEN 'Payment Date is required' END
 WHEN 'supplier' THEN CASE WHEN party IS NULL OR party NOT IN (SELECT supplier_code FROM fx_suppliers) THEN 'Supplier not found' END
 WHEN 'purchase' THEN CASE WHEN {blank('party', 'entry_date')} OR {NONE} THEN 'Amount & Date required' END
 WHEN 'expense' THEN CASE WHEN {blank('entry_date', 'party', 'payment_method')} OR {NONE} THEN 'Missing required fields' END
 WHEN 'cash' THEN CASE WHEN {blank('entry_date', 'type')} OR {NONE} THEN 'Missing fields' END
 WHEN 'bank' THEN CASE WHEN {blank('entry_date', 'type', 'bank_profile_id')} OR {NONE} THEN 'Date, Amount, Type, & Bank Profile required' END
 END, CASE WHEN {A} IS NULL THEN 'Invalid amount' END) AS reason FROM fx_requests)"""
ACCEPTED = f"""
WITH {INTAKE} SELECT request_id, kind, party, CASE WHEN kind = 'purchase' THEN CAST(floor(a + 0.5) AS DECIMAL(18,2)) ELSE a END AS amount, CAST(entry_date AS DATE) AS entry_date,
 CASE kind WHEN 'customer' THEN COALESCE(NULLIF(payment_method, ''), 'cash') WHEN 'registered' THEN COALESCE(NULLIF(payment_method, ''), 'Cash') WHEN 'purchase' THEN COALESCE(NULLIF(payment_method, ''), 'Cash') ELSE payment_method END AS payment_method,
 CASE WHEN kind = 'bank' OR payment_method = 'Bank' THEN CAST(bank_profile_id AS BIGINT) END AS bank_profile_id,
 CASE WHEN kind IN ('customer', 'registered', 'purchase') THEN COALESCE(NULLIF(type, ''), 'payment') ELSE type END AS type,
 CASE WHEN kind IN ('expense', 'cash', 'bank') THEN COALESCE(note, '') ELSE note END AS note FROM chk WHERE reason IS NULL"""

def edited(table: str, kind: str, where: str, columns: dict[str, str], kept: str) -> str:
    """Rows of ``table`` with the columns of the accepted edit of the same id."""
    picks = ", ".join(f"CASE WHEN e.request_id IS NULL THEN p.{c} ELSE {v} END AS {c}" for c, v in columns.items())
    return f"""
WITH e AS (SELECT *, {A} AS a FROM fx_requests WHERE kind = '{kind}' AND {A} IS NOT NULL AND NOT ({where}))
SELECT p.id, {kept}{picks} FROM {table} p LEFT JOIN e ON e.request_id = p.id"""


EDIT_BANK = "CASE WHEN e.payment_method = 'Bank' THEN CAST(e.bank_profile_id AS BIGINT) END"
EDIT_DAY = "CAST(e.entry_date AS DATE)"

LABEL_SAR = "CASE WHEN o_custkey % 6 = 0 THEN 0 ELSE 50 + (o_custkey * i) % 90 END"


def new_ref(prefix: str, key: str) -> str:
    """The next references of a module, one for each supplier."""
    no = f"(SELECT max({key}) FROM cur) + row_number() OVER (ORDER BY s_suppkey)"
    return f"'{prefix}' || CASE WHEN {no} > 99999 THEN CAST({no} AS VARCHAR) ELSE lpad(CAST({no} AS VARCHAR), 5, '0') END"


def row_saves(module: int, prefix: str, sar: str, persons: bool = True) -> str:
    """Sales with one list of rows saved at another rate, and new ones with one row."""
    own = f"CAST(sum({PERSONS}) AS BIGINT) AS persons, " if persons else ""
    return f"""
WITH cur AS (SELECT o_orderkey AS k, {REF} AS ref_no, o_orderkey % 17 = 0 AS is_deleted, CAST(o_orderdate AS DATE) AS booking_date, any_value({RATE}) + 1 AS pkr_rate, {own}
 sum({sar.format(p=PERSONS, q=PRICE)}) AS sar FROM {elements(module, active="true")} GROUP BY o_orderkey, o_orderdate)
SELECT ref_no, is_deleted, booking_date, CAST(pkr_rate AS DECIMAL(18,2)) AS pkr_rate, {"persons, " if persons else ""}CAST(sar AS DECIMAL(20,2)) AS total_sar, CAST(sar * pkr_rate AS DECIMAL(20,2)) AS total_pkr FROM cur
UNION ALL SELECT {new_ref(prefix, "k")}, false, DATE '2001-09-01', 70, {"2, " if persons else ""}CAST(s_suppkey AS DECIMAL(18,2)), CAST(s_suppkey * 70 AS DECIMAL(18,2)) FROM supplier"""


SQL = {
    "expense_edits": edited(
        "fx_expenses",
        "expense",
        f"{blank('entry_date', 'party', 'payment_method')} OR {NONE}",
        {
            "expense_date": EDIT_DAY,
            "title": "e.party",
            "amount": "e.a",
            "payment_method": "e.payment_method",
            "bank_profile_id": EDIT_BANK,
            "remarks": "COALESCE(e.note, '')",
        },
        "",
    ),
    "supplier_payment_edits": edited(
        "fx_supplier_payments",
        "supplier",
        LOW,
        {
            "amount": "e.a",
            "payment_date": EDIT_DAY,
            "payment_method": "COALESCE(NULLIF(e.payment_method, ''), 'Bank')",
            "bank_profile_id": EDIT_BANK,
            "type": "e.type",
        },
        "p.supplier_id, ",
    ),
    "cash_edits": edited(
        "fx_cash_txns",
        "cash",
        f"{blank('entry_date', 'type')} OR {LOW}",
        {"txn_date": EDIT_DAY, "type": "e.type", "amount": "e.a", "comment": "COALESCE(e.note, '')"},
        "",
    ),
    "bank_edits": edited(
        "fx_bank_txns",
        "bank",
        "FALSE",
        {
            "txn_date": EDIT_DAY,
            "type": "e.type",
            "amount": "e.a",
            "comment": "COALESCE(e.note, '')",
            "bank_profile_id": "CAST(e.bank_profile_id AS BIGINT)",
        },
        "",
    ),
    "module_save": row_saves(2, "VISA-", "CASE WHEN (o_orderkey + i) % 5 < 2 THEN 0 ELSE {p} * {q} END"),
    "module_save_card": row_saves(3, "CARD-", "CASE WHEN (o_orderkey + i) % 5 < 2 THEN 0 ELSE {p} * {q} END"),
    "module_save_groups": row_saves(4, "GRP-", "CASE WHEN (o_orderkey + i) % 5 < 2 THEN 0 ELSE {p} * {q} END"),
    "module_save_transport": row_saves(6, "TRN-", LABEL_SAR, persons=False),
    "module_save_ziyarat": row_saves(7, "ZIY-", LABEL_SAR, persons=False),
    "module_save_hotels": f"""
WITH cur AS (SELECT o_orderkey AS k, any_value(o_orderdate) AS d, any_value({RATE}) + 1 AS rate, sum({ROOMS} * {NIGHTS} * 55) AS total, count(*) AS n FROM {elements(1, active="true")} GROUP BY o_orderkey)
SELECT {REF.replace("o_orderkey", "k")} AS ref_no, k % 17 = 0 AS is_deleted, CAST(d AS DATE) AS booking_date, CAST(rate AS DECIMAL(18,2)) AS sar_rate, CAST(total AS DECIMAL(20,2)) AS hotels_total, CAST(total * rate AS DECIMAL(20,2)) AS total_pkr, CAST(n AS INT) AS n_rows FROM cur
UNION ALL SELECT {new_ref("HOT-", "k")}, false, DATE '2001-09-01', 70, s_suppkey, s_suppkey * 70, 1 FROM supplier""",
    "module_save_ticketing": f"""
WITH cur AS (SELECT o_orderkey AS k, o_orderdate AS d, {RATE} + 1 AS rate, o_custkey % 4 * 900 + o_custkey % 3 * 700 + o_custkey % 2 * 200 AS total FROM orders WHERE o_orderkey % 8 = 5)
SELECT {REF.replace("o_orderkey", "k")} AS ref_no, k % 17 = 0 AS is_deleted, CAST(d AS DATE) AS booking_date, CAST(rate AS DECIMAL(18,2)) AS pkr_rate, CAST(total AS DECIMAL(20,2)) AS total_sar, CAST(total * rate AS DECIMAL(20,2)) AS total_pkr, CAST(1 + k % 3 AS INT) AS n_rows FROM cur
UNION ALL SELECT {new_ref("TIC-", "k")}, false, DATE '2001-09-01', 70, 2 * s_suppkey, 140 * s_suppkey, 1 FROM supplier""",
    "module_save_bookings": f"""
WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d, o_custkey AS c, {RATE} + 1 AS rate, o_custkey % 4 * 900 + o_custkey % 3 * 700 + o_custkey % 2 * 200 AS fares FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 8 = 0),
 h AS (SELECT o_orderkey AS k, sum({ROOMS} * {NIGHTS} * 55) AS hotels, sum({LABEL_SAR}) AS transport FROM {elements(0, active="true")} GROUP BY o_orderkey),
 z AS (SELECT o_orderkey AS k, sum({LABEL_SAR}) AS ziyarat FROM {elements(0, "1 + o_custkey % 2", active="true")} GROUP BY o_orderkey), cur AS (SELECT * FROM o JOIN h USING (k) JOIN z USING (k))
SELECT {REF.replace("o_orderkey", "k")} AS ref_no, k % 17 = 0 AS is_deleted, CAST(d AS DATE) AS booking_date, CAST(rate AS DECIMAL(18,2)) AS visa_sar_rate, CAST(fares AS DECIMAL(20,2)) AS flight_total, CAST(hotels AS DECIMAL(20,2)) AS hotels_total,
 CAST(transport AS DECIMAL(20,2)) AS transport_total, CAST(ziyarat AS DECIMAL(20,2)) AS ziyarat_total, CAST(CASE WHEN c % 5 <> 0 THEN 1 + k % 3 ELSE 0 END AS INT) AS n_rows FROM cur
UNION ALL SELECT {new_ref("PKG-", "k")}, false, DATE '2001-09-01', 70, 900, 0, s_suppkey, 0, 0 FROM supplier""",
    "customer_save": """
WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 <> 0 THEN upper(c_name) END AS name, '0300' || CAST(c_custkey AS VARCHAR) AS contact_no, CASE WHEN c_custkey % 5 <> 0 THEN 'a@example.org' ELSE '' END AS email FROM customer)
SELECT c.id, c.customer_code, CASE WHEN r.k IS NULL THEN c.name ELSE r.name END AS name, COALESCE(r.contact_no, c.contact_no) AS contact_no, COALESCE(r.email, c.email) AS email, c.is_deleted FROM fx_customers c LEFT JOIN r ON r.k = c.id AND r.k % 3 = 0
UNION ALL SELECT m + n, 'CUST-' || CASE WHEN m + n > 99999 THEN CAST(m + n AS VARCHAR) ELSE lpad(CAST(m + n AS VARCHAR), 5, '0') END, name, contact_no, email, false
FROM (SELECT *, row_number() OVER (ORDER BY k) AS n, (SELECT max(id) FROM fx_customers) AS m FROM r WHERE k % 3 = 1 AND name IS NOT NULL) x""",
    "supplier_save": """
WITH r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 <> 0 THEN upper(s_name) ELSE '' END AS name FROM supplier)
SELECT c.id, c.supplier_code, CASE WHEN r.k IS NULL THEN c.supplier_name ELSE r.name END AS supplier_name, CASE WHEN r.k IS NULL THEN c.category ELSE 'Changed' END AS category, CASE WHEN r.k IS NULL THEN c.contact_no ELSE '0' END AS contact_no, c.is_deleted
FROM fx_suppliers c LEFT JOIN r ON 2 * r.k = c.id AND r.k % 3 = 0
UNION ALL SELECT m + n, 'SUP-' || CASE WHEN m + n > 9999 THEN CAST(m + n AS VARCHAR) ELSE lpad(CAST(m + n AS VARCHAR), 4, '0') END, name, 'Changed', '0', false
FROM (SELECT *, row_number() OVER (ORDER BY k) AS n, (SELECT max(id) FROM fx_suppliers) AS m FROM r WHERE k % 3 = 1 AND name <> '') x""",
    "purchase_upsert": f"""
WITH {CLEANED} SELECT COALESCE(p.ref_no, c.ref_no) AS ref_no, COALESCE(p.item, c.item) AS item, {", ".join(f"CASE WHEN c.ref_no IS NOT NULL THEN c.{x} ELSE p.{x} END AS {x}" for x in NEW)},
 CASE WHEN p.ref_no IS NOT NULL THEN p.created_at ELSE c.created_at END AS created_at, CASE WHEN p.ref_no IS NOT NULL THEN p.id ELSE c.id END AS id, CASE WHEN c.ref_no IS NOT NULL THEN false ELSE p.is_deleted END AS is_deleted
FROM fx_purchases p FULL JOIN cl c ON c.ref_no = p.ref_no AND c.item = p.item""",
    "purchase_status_rollup": f"""
WITH {CLEANED}, st AS (SELECT ref_no, CASE WHEN count(*) FILTER (purchase_sar > 0) = 0 THEN 'PENDING' WHEN count(*) FILTER (purchase_sar > 0) < count(*) THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM cl GROUP BY ref_no)
SELECT s.ref_no, CASE WHEN s.ref_no IN (SELECT ref_no FROM fx_purchases WHERE is_deleted) THEN 'PENDING' ELSE COALESCE(st.status, purchase_status) END AS purchase_status FROM fx_sales s LEFT JOIN st ON st.ref_no = s.ref_no""",
    "payment_status_rollup": f"""
WITH r AS ({WALKIN_STATUS}) SELECT s.ref_no, CASE WHEN s.ref_no IN (SELECT ref_no FROM fx_customer_payments) THEN COALESCE(r.payment_status, 'PENDING') ELSE s.payment_status END AS payment_status
FROM fx_sales s LEFT JOIN r ON r.ref_no = s.ref_no""",
    "delete_eligibility": f"WITH {ELIGIBLE} SELECT ref_no, reason, reason IS NULL AS deletable FROM el",
    "soft_delete": f"WITH {ELIGIBLE} SELECT s.ref_no, s.is_deleted OR (payment_status = 'COMPLETE' AND reason IS NULL) AS is_deleted FROM fx_sales s JOIN el ON el.ref_no = s.ref_no",
    "restore": "SELECT ref_no, item, is_deleted AND ref_no IN (SELECT ref_no FROM fx_purchases WHERE NOT is_deleted) AS is_deleted FROM fx_purchases",
    "permanent_delete": "SELECT ref_no, is_deleted FROM fx_sales WHERE NOT (is_deleted AND year(booking_date) = 1997)",
    "entry_delete": "SELECT ref_no, item, status FROM fx_purchases WHERE year(created_at) <> 1998 OR status = 'Live Purchase'",
    "payment_delete": "SELECT id, amount FROM fx_supplier_payments WHERE type IS DISTINCT FROM 'adjustment'",
    "payment_edits": f"""
WITH e AS (SELECT *, {A} AS a FROM fx_requests WHERE kind IN ('customer', 'registered') AND {A} > 0 AND (kind = 'registered' OR entry_date IS NOT NULL))
SELECT p.id, ref_no, CASE WHEN e.request_id IS NULL THEN payment_date ELSE CAST(entry_date AS DATE) END AS payment_date, COALESCE(e.a, p.amount) AS amount,
 CASE WHEN e.request_id IS NULL THEN p.type ELSE COALESCE(NULLIF(e.type, ''), 'payment') END AS type, CASE WHEN e.request_id IS NULL THEN p.payment_method ELSE COALESCE(NULLIF(e.payment_method, ''), 'Bank') END AS payment_method,
 CASE WHEN e.request_id IS NULL THEN p.bank_profile_id WHEN e.payment_method = 'Bank' THEN CAST(e.bank_profile_id AS BIGINT) END AS bank_profile_id, is_deleted
FROM fx_customer_payments p LEFT JOIN e ON e.request_id = p.id""",
    "ref_high_water": """
SELECT prefix, max(CAST(regexp_replace(ref_no, '[^0-9]', '', 'g') AS BIGINT)) AS last_no FROM fx_sales GROUP BY prefix
UNION ALL SELECT 'SUP-', max(CAST(substr(supplier_code, 5) AS BIGINT)) FROM fx_suppliers UNION ALL SELECT 'CUST-', max(CAST(substr(customer_code, 6) AS BIGINT)) FROM fx_customers""",
    "ref_allocate": f"""
WITH r AS (SELECT event_id AS request_id, CASE WHEN event_type = 'click' THEN 'SUP-' ELSE {PREFIX} END AS prefix FROM events),
 h AS (SELECT prefix, max(id) AS n FROM fx_sales GROUP BY prefix UNION ALL SELECT 'SUP-', max(id) FROM fx_suppliers),
 k AS (SELECT r.*, COALESCE(n, 0) + row_number() OVER (PARTITION BY r.prefix ORDER BY request_id) AS no FROM r LEFT JOIN h ON h.prefix = r.prefix)
SELECT request_id, prefix, prefix || CASE WHEN prefix = 'SUP-' THEN CASE WHEN no > 9999 THEN CAST(no AS VARCHAR) ELSE lpad(CAST(no AS VARCHAR), 4, '0') END WHEN no > 99999 THEN CAST(no AS VARCHAR) ELSE lpad(CAST(no AS VARCHAR), 5, '0') END AS ref_no FROM k""",
    "master_upsert": """
WITH r AS (SELECT c_custkey + 90000000 AS id, 'CUST-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS customer_code, upper(c_name) AS name, '0300' || CAST(c_custkey AS VARCHAR) AS contact_no,
 CASE WHEN c_custkey % 5 <> 0 THEN 'a@example.org' ELSE '' END AS email FROM customer WHERE c_custkey % 7 <> 0)
SELECT COALESCE(c.id, r.id) AS id, COALESCE(c.customer_code, r.customer_code) AS customer_code, COALESCE(r.name, c.name) AS name, COALESCE(r.contact_no, c.contact_no) AS contact_no, COALESCE(r.email, c.email) AS email,
 COALESCE(c.is_deleted, false) AS is_deleted FROM fx_customers c FULL JOIN r ON r.customer_code = c.customer_code""",
    "supplier_upsert": """
WITH r AS (SELECT s_suppkey + 90000000 AS id, 'SUP-' || lpad(CAST(s_suppkey * 2 AS VARCHAR), 8, '0') AS supplier_code, upper(s_name) AS supplier_name FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT COALESCE(c.id, r.id) AS id, COALESCE(c.supplier_code, r.supplier_code) AS supplier_code, COALESCE(r.supplier_name, c.supplier_name) AS supplier_name, CASE WHEN r.id IS NULL THEN c.category ELSE 'Changed' END AS category,
 CASE WHEN r.id IS NULL THEN c.contact_no ELSE '0' END AS contact_no, COALESCE(c.is_deleted, false) AS is_deleted FROM fx_suppliers c FULL JOIN r ON r.supplier_code = c.supplier_code""",
    "bank_upsert": """
WITH r AS (SELECT CAST(n_nationkey * 2 AS BIGINT) AS id, n_name AS bank_name, CASE WHEN n_nationkey % 3 = 0 THEN 'Inactive' ELSE 'Active' END AS status FROM nation WHERE n_nationkey % 5 <> 0)
SELECT COALESCE(b.id, r.id) AS id, COALESCE(r.bank_name, b.bank_name) AS bank_name, CASE WHEN r.id IS NULL THEN account_title ELSE 'T' END AS account_title, CASE WHEN r.id IS NULL THEN account_number ELSE 'X1' END AS account_number,
 COALESCE(r.status, b.status) AS status FROM fx_banks b FULL JOIN r ON r.id = b.id""",
    "sales_upsert": f"""
WITH {SALE_REQUESTS} SELECT COALESCE(s.ref_no, r.ref_no) AS ref_no, CASE WHEN r.ref_no IS NULL THEN s.customer_code ELSE r.customer_code END AS customer_code, CASE WHEN r.ref_no IS NULL THEN s.customer_name ELSE r.customer_name END AS customer_name,
 COALESCE(r.booking_date, s.booking_date) AS booking_date, COALESCE(r.total_pkr, s.total_pkr) AS total_pkr,
 CASE WHEN r.ref_no IS NULL THEN s.payment_status WHEN r.ref_no LIKE 'CARD-%' THEN CASE WHEN r.customer_code IS NULL THEN 'PENDING' ELSE 'CLEARED' END ELSE COALESCE(s.payment_status, 'PENDING') END AS payment_status,
 COALESCE(s.is_deleted, false) AS is_deleted FROM fx_sales s FULL JOIN req r ON r.ref_no = s.ref_no""",
    "intake_validate": ACCEPTED,
    "intake_rejected": f"WITH {INTAKE} SELECT request_id, kind, reason FROM chk WHERE reason IS NOT NULL",
    "payment_feed": ACCEPTED,
    "daily_cash_flow": """
SELECT CAST(ts AS DATE) AS day, source, CAST(sum(a) AS DECIMAL(20,2)) AS net, count(*) AS entries,
 CAST(ts AS DATE) + INTERVAL 1 DAY > (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS is_open FROM (
 SELECT ts, CASE WHEN event_type IN ('purchase','signup') THEN 'customer' WHEN event_type = 'click' THEN 'supplier' WHEN event_type = 'view' THEN 'expense' WHEN event_id % 2 = 0 THEN 'deposit' ELSE 'withdraw' END AS source,
  CASE WHEN event_type IN ('purchase','signup') OR (event_type = 'error' AND event_id % 2 = 0) THEN 1 ELSE -1 END * CAST(value AS DECIMAL(18,2)) AS a FROM events) t
GROUP BY CAST(ts AS DATE), source""",
}

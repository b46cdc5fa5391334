"""Ledgers, pending lists and the balance sheet."""

from oracles.lists import WALKIN, label, rank

# names: one per customer code or ref_no, in module order
ANY_NAME = f"""anyname AS (SELECT key, customer_name AS name FROM (
 SELECT key, customer_name, row_number() OVER (PARTITION BY key ORDER BY {rank()}, id) AS rn FROM (
  SELECT customer_code AS key, customer_name, prefix, id FROM fx_sales UNION ALL SELECT ref_no, customer_name, prefix, id FROM fx_sales) u
 WHERE key <> '' AND customer_name <> '') WHERE rn = 1)"""


def code_name(master: bool) -> str:
    more = "UNION ALL SELECT customer_code, name, 8, id FROM fx_customers WHERE name <> ''" if master else ""
    return f"""codename AS (SELECT customer_code, customer_name AS name FROM (
 SELECT *, row_number() OVER (PARTITION BY customer_code ORDER BY r, id) AS rn FROM (
  SELECT customer_code, customer_name, {rank()} AS r, id FROM fx_sales WHERE NOT is_deleted AND customer_code <> '' AND customer_name <> '' {more}) u) WHERE rn = 1)"""


REF_NAME = "refname AS (SELECT ref_no, max(customer_name) AS name FROM fx_sales GROUP BY ref_no)"
METHOD = "CASE WHEN lower(payment_method) = 'bank' AND bank_name <> '' THEN 'Bank: ' || bank_name ELSE COALESCE(payment_method, '') END"
DEC = "DECIMAL(20,2)"


def js_round(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def last_by_day(column: str) -> str:
    return f"COALESCE((SELECT date_to FROM fx_snapshots WHERE {column} IS NOT NULL ORDER BY date_to DESC, id DESC LIMIT 1), DATE '1970-01-01')"


LAST_DAY = "(SELECT date_to FROM fx_snapshots ORDER BY id DESC LIMIT 1)"
LAST_ID = "(SELECT max(id) FROM fx_snapshots)"


def money_ledger(method: str, op: str, column: str, manual: str, active: str, bank: str, partition: str, opening: str = "0") -> str:
    counted = f"lower(COALESCE(type,'')) NOT IN ('adjustment','opening_balance') AND lower(COALESCE(payment_method,'')) = '{method}'"
    day = last_by_day(column)
    return f"""
WITH {ANY_NAME}, e AS (
 SELECT p.id, payment_date AS txn_date, 'Customer Payment - ' || COALESCE(name, 'Walk-in Customer') || ' (Ref: ' || ref_no || ')' AS description, CAST(round(amount, 0) AS BIGINT) AS credit, CAST(NULL AS BIGINT) AS debit, 'customer' AS source{bank}
 FROM fx_customer_payments p LEFT JOIN anyname ON key = ref_no WHERE {counted} {active} AND payment_date {op} {day}
 UNION ALL SELECT p.id, payment_date, 'Supplier Payment - ' || COALESCE(supplier_name, '') || ' (Ref: ' || CAST(p.id AS VARCHAR) || ')', NULL, CAST(round(amount, 0) AS BIGINT), 'supplier'{bank}
 FROM fx_supplier_payments p LEFT JOIN fx_suppliers s ON s.id = p.supplier_id WHERE {counted} AND payment_date {op} {day}
 UNION ALL SELECT id, expense_date, 'Expense: ' || title, NULL, CAST(round(amount, 0) AS BIGINT), 'expense'{bank} FROM fx_expenses WHERE lower(payment_method) = '{method}' AND expense_date {op} {day}
 UNION ALL SELECT id, txn_date, comment, CASE WHEN type = 'deposit' THEN CAST(round(amount, 0) AS BIGINT) END, CASE WHEN type = 'withdraw' THEN CAST(round(amount, 0) AS BIGINT) END, 'manual'{bank} FROM {manual} WHERE txn_date {op} {day})
SELECT id, txn_date, description, COALESCE(credit, 0) AS credit, COALESCE(debit, 0) AS debit, source{bank},
 CAST(sum(COALESCE(credit, 0) - COALESCE(debit, 0)) OVER ({partition} ORDER BY txn_date, id) + {opening} AS BIGINT) AS balance
FROM e {"WHERE bank_profile_id IS NOT NULL" if bank else ""}"""


REGISTERED = f"""
WITH {code_name(False)}, e AS (
 SELECT customer_code, booking_date AS entry_date, {rank()} AS grp, id, 'SALE-' || ref_no AS entry_id, 'Sale Invoice (' || {label('source')} || ') - Ref: ' || ref_no AS description,
  CAST(0 AS BIGINT) AS debit, {js_round('total_pkr')} AS credit, 'sale' AS entry_type, CAST(NULL AS BIGINT) AS bank_profile_id FROM fx_sales WHERE NOT is_deleted AND customer_code <> ''
 UNION ALL SELECT ref_no, payment_date, 8, p.id, CAST(p.id AS VARCHAR),
  CASE WHEN type = 'opening_balance' THEN '🔑 Opening Balance' WHEN type = 'adjustment' THEN 'Adjustment Receipt (' || {METHOD} || ')' ELSE 'Payment Received (' || {METHOD} || ')' END,
  CASE WHEN type = 'opening_balance' THEN 0 ELSE {js_round('amount')} END, CASE WHEN type = 'opening_balance' THEN {js_round('amount')} ELSE 0 END,
  CASE WHEN type = 'opening_balance' THEN 'opening_balance' ELSE 'payment' END, bank_profile_id
 FROM fx_customer_payments p LEFT JOIN fx_banks b ON b.id = bank_profile_id WHERE ref_no LIKE 'CUST-%'),
b AS (SELECT *, CAST(sum(credit - debit) OVER (PARTITION BY customer_code ORDER BY entry_date, grp, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM e)
SELECT b.customer_code, COALESCE(name, 'Registered Customer') AS customer_name, entry_date, entry_id, description, debit, credit, entry_type, bank_profile_id, balance
FROM b LEFT JOIN codename n ON n.customer_code = b.customer_code"""

POSITIONS = f"""
 pur AS (SELECT supplier_code, sum(purchase_pkr) AS bought FROM fx_purchases WHERE NOT is_deleted AND CAST(created_at AS DATE) > {LAST_DAY} GROUP BY supplier_code),
 pay AS (SELECT supplier_id, sum(CASE WHEN type = 'opening_balance' THEN amount ELSE 0 END) AS opening, sum(CASE WHEN type <> 'opening_balance' THEN amount ELSE 0 END) AS paid
  FROM fx_supplier_payments WHERE payment_date > {LAST_DAY} GROUP BY supplier_id),
 pos AS (SELECT s.supplier_code, s.supplier_name, CAST(COALESCE(sb.balance, 0) + COALESCE(bought, 0) + COALESCE(opening, 0) AS {DEC}) AS owed, CAST(COALESCE(paid, 0) AS {DEC}) AS paid,
  CAST(COALESCE(sb.balance, 0) + COALESCE(bought, 0) + COALESCE(opening, 0) - COALESCE(paid, 0) AS {DEC}) AS balance
  FROM fx_suppliers s LEFT JOIN pur ON pur.supplier_code = s.supplier_code LEFT JOIN pay ON pay.supplier_id = s.id
  LEFT JOIN fx_balances sb ON sb.code = s.supplier_code AND sb.balance_type = 'SUPPLIER' AND sb.snapshot_id = {LAST_ID} WHERE NOT s.is_deleted)"""

BS_WALKIN = f"""
 rec AS (SELECT ref_no, sum(amount) AS received FROM fx_customer_payments WHERE payment_date > {LAST_DAY} AND type <> 'opening_balance' AND NOT is_deleted GROUP BY ref_no),
 walkin AS (SELECT s.ref_no, COALESCE(NULLIF(customer_name, ''), 'Walk-In Customer') AS customer_name, CAST(total_pkr AS {DEC}) AS sale_total, CAST(COALESCE(received, 0) AS {DEC}) AS received,
  CAST(COALESCE(c.balance, 0) + total_pkr - COALESCE(received, 0) AS {DEC}) AS balance, payment_status AS status
  FROM fx_sales s LEFT JOIN rec ON rec.ref_no = s.ref_no LEFT JOIN fx_balances c ON c.code = s.ref_no AND c.balance_type = 'CUSTOMER' AND c.snapshot_id = {LAST_ID}
  WHERE NOT is_deleted AND payment_status IN ('PENDING','PARTIAL') AND {WALKIN})"""

BS_REGISTERED = f"""
 codes AS (SELECT customer_code FROM fx_sales WHERE NOT is_deleted AND customer_code <> '' UNION SELECT ref_no FROM fx_customer_payments WHERE ref_no LIKE 'CUST-%' AND NOT is_deleted),
 deb AS (SELECT customer_code, sum(amount) AS a FROM (SELECT customer_code, total_pkr AS amount FROM fx_sales WHERE NOT is_deleted
   UNION ALL SELECT ref_no, amount FROM fx_customer_payments WHERE type = 'opening_balance' AND NOT is_deleted) u GROUP BY customer_code),
 cre AS (SELECT ref_no AS customer_code, sum(amount) AS a FROM fx_customer_payments WHERE type <> 'opening_balance' AND NOT is_deleted GROUP BY ref_no),
 reg AS (SELECT codes.customer_code, CAST(COALESCE(deb.a, 0) AS {DEC}) AS sale_total, CAST(COALESCE(cre.a, 0) AS {DEC}) AS received, CAST(COALESCE(deb.a, 0) - COALESCE(cre.a, 0) AS {DEC}) AS balance
  FROM codes LEFT JOIN deb ON deb.customer_code = codes.customer_code LEFT JOIN cre ON cre.customer_code = codes.customer_code WHERE COALESCE(deb.a, 0) > 0 OR COALESCE(cre.a, 0) > 0)"""

WALKIN_ACCOUNTS = f"""acc AS (SELECT ref_no, any_value(customer_name) FILTER (rn = 1) AS customer_name, any_value(booking_date) FILTER (rn = 1) AS booking_date, {js_round('sum(total_pkr)')} AS sale FROM (
 SELECT *, row_number() OVER (PARTITION BY ref_no ORDER BY {rank()}, id) AS rn FROM fx_sales WHERE NOT is_deleted AND {WALKIN}) t GROUP BY ref_no)"""

WALKIN_STATUS = f"""
SELECT s.ref_no, CAST(sale AS {DEC}) AS total_sale, CAST(COALESCE(paid, 0) AS {DEC}) AS total_paid,
 CASE WHEN sale <= 0 OR COALESCE(paid, 0) <= 0 THEN 'PENDING' WHEN paid < sale THEN 'PARTIAL' ELSE 'COMPLETE' END AS payment_status
FROM (SELECT ref_no, sum(total_pkr) AS sale FROM fx_sales WHERE NOT is_deleted AND {WALKIN} GROUP BY ref_no) s
LEFT JOIN (SELECT ref_no, sum(amount) AS paid FROM fx_customer_payments GROUP BY ref_no) p ON p.ref_no = s.ref_no"""

SQL = {
    "cash_ledger": money_ledger("cash", ">", "opening_cash", "fx_cash_txns", "AND NOT is_deleted", "", ""),
    "cash_ledger_opening": money_ledger("cash", ">", "opening_cash", "fx_cash_txns", "AND NOT is_deleted", "", "", "100000"),
    "bank_ledger": money_ledger(
        "bank", ">=", "opening_bank", "fx_bank_txns", "", ", bank_profile_id", "PARTITION BY bank_profile_id"
    ),
    "walkin_payment_status": WALKIN_STATUS,
    "walkin_ledger": f"""
WITH {WALKIN_ACCOUNTS}, e AS (
 SELECT ref_no, booking_date AS entry_date, 0 AS line_group, CAST(0 AS BIGINT) AS id, 'CUSTOMER' AS entry_id, 'Customer: ' || COALESCE(customer_name, 'null') AS description, CAST(0 AS BIGINT) AS debit, CAST(0 AS BIGINT) AS credit, CAST(NULL AS DATE) AS pd FROM acc
 UNION ALL SELECT ref_no, booking_date, 1, 0, 'SALE', 'Sale Invoice', 0, sale, NULL FROM acc WHERE sale > 0
 UNION ALL SELECT p.ref_no, payment_date, 2, p.id, CAST(p.id AS VARCHAR), CASE WHEN type = 'adjustment' THEN 'Adjustment' ELSE 'Payment Received (' || {METHOD} || ')' END, {js_round('amount')}, 0, payment_date
 FROM fx_customer_payments p JOIN acc ON acc.ref_no = p.ref_no LEFT JOIN fx_banks b ON b.id = bank_profile_id)
SELECT ref_no, entry_date, line_group, entry_id, description, debit, credit, CAST(sum(credit - debit) OVER (PARTITION BY ref_no ORDER BY line_group, pd, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM e""",
    "registered_ledger": REGISTERED,
    "registered_statement": REGISTERED + " WHERE entry_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'",
    "registered_closing": f"""
SELECT customer_code, CAST(sum(a) AS BIGINT) AS total_remaining_balance FROM (
 SELECT customer_code, {js_round('total_pkr')} AS a FROM fx_sales WHERE NOT is_deleted AND customer_code <> ''
 UNION ALL SELECT ref_no, CASE WHEN type = 'opening_balance' THEN 1 ELSE -1 END * {js_round('amount')} FROM fx_customer_payments WHERE ref_no LIKE 'CUST-%') u GROUP BY customer_code""",
    "registered_pending": f"""
WITH {code_name(True)}, cr AS (SELECT customer_code, sum(a) AS a FROM (SELECT customer_code, total_pkr AS a FROM fx_sales WHERE NOT is_deleted AND customer_code <> ''
  UNION ALL SELECT ref_no, amount FROM fx_customer_payments WHERE type = 'opening_balance' AND ref_no <> '') u GROUP BY customer_code),
 db AS (SELECT ref_no AS customer_code, sum(amount) AS a FROM fx_customer_payments WHERE type <> 'opening_balance' AND ref_no <> '' GROUP BY ref_no),
 agg AS (SELECT c.customer_code, CAST(COALESCE(cr.a, 0) - COALESCE(db.a, 0) AS {DEC}) AS bal, COALESCE(db.a, 0) AS paid FROM (SELECT customer_code FROM cr UNION SELECT customer_code FROM db) c
  LEFT JOIN cr ON cr.customer_code = c.customer_code LEFT JOIN db ON db.customer_code = c.customer_code)
SELECT agg.customer_code, COALESCE(name, 'Registered Customer') AS customer_name, bal AS remaining_balance, CASE WHEN bal < 0 THEN 'EXTRA PAID' WHEN paid = 0 THEN 'PENDING' ELSE 'PARTIAL' END AS payment_status
FROM agg LEFT JOIN codename n ON n.customer_code = agg.customer_code WHERE bal <> 0""",
    "supplier_pending": f"""
WITH {POSITIONS} SELECT supplier_code, supplier_name, owed AS total_purchase, paid AS total_paid, balance AS pending_amount,
 CASE WHEN balance < -0.5 THEN 'EXTRA PAID' WHEN abs(balance) <= 0.5 THEN 'PAID' WHEN paid > 0 THEN 'PARTIAL' ELSE 'PENDING' END AS status FROM pos WHERE abs(balance) > 0.5""",
    "supplier_ledger": f"""
WITH e AS (
 SELECT code AS supplier_code, 0 AS grp, CAST(0 AS BIGINT) AS id, {LAST_DAY} AS entry_date, 'Snapshot Opening' AS type, CAST(NULL AS VARCHAR) AS payment_method, CAST(NULL AS BIGINT) AS bank_profile_id, CAST(NULL AS VARCHAR) AS item, CAST(NULL AS VARCHAR) AS ref_no,
  CASE WHEN balance > 0 THEN balance ELSE 0 END AS debit, CASE WHEN balance < 0 THEN -balance ELSE 0 END AS credit FROM fx_balances WHERE snapshot_id = {LAST_ID} AND balance_type = 'SUPPLIER' AND balance <> 0 AND code IN (SELECT supplier_code FROM fx_suppliers)
 UNION ALL SELECT supplier_code, 1, id, CAST(created_at AS DATE), 'Purchase', '-', NULL, item, ref_no, purchase_pkr, 0 FROM fx_purchases WHERE NOT is_deleted AND CAST(created_at AS DATE) > {LAST_DAY} AND supplier_code IN (SELECT supplier_code FROM fx_suppliers)
 UNION ALL SELECT supplier_code, 2, p.id, payment_date, type, payment_method, bank_profile_id, NULL, NULL, CASE WHEN type = 'opening_balance' THEN amount ELSE 0 END, CASE WHEN type <> 'opening_balance' THEN amount ELSE 0 END
 FROM fx_supplier_payments p JOIN fx_suppliers s ON s.id = p.supplier_id WHERE payment_date > {LAST_DAY})
SELECT supplier_code, e.id, entry_date, CASE WHEN type = 'opening_balance' THEN 'Opening Bal' ELSE type END AS type,
 CASE WHEN type = 'opening_balance' THEN 'opening_balance' WHEN item <> '' THEN item ELSE COALESCE(type, 'null') || ' (' || COALESCE(payment_method, '') || ')' END AS description,
 payment_method, bank_name, ref_no, CAST(debit AS {DEC}) AS debit, CAST(credit AS {DEC}) AS credit,
 CASE WHEN type = 'opening_balance' OR lower(type) LIKE '%payment%' OR lower(type) LIKE '%adjustment%' THEN 'payment' WHEN type = 'Snapshot Opening' THEN 'snapshot' ELSE 'purchase' END AS entry_type,
 CAST(sum(debit - credit) OVER (PARTITION BY supplier_code ORDER BY entry_date, e.id, grp ROWS UNBOUNDED PRECEDING) AS {DEC}) AS balance
FROM e LEFT JOIN fx_banks b ON b.id = bank_profile_id""",
    "purchase_ledger": f"""
WITH c AS (SELECT ref_no, min(created_at) AS first_at, sum(purchase_pkr) AS cost FROM fx_purchases WHERE NOT is_deleted GROUP BY ref_no HAVING sum(purchase_pkr) <> 0),
e AS (SELECT ref_no, 0 AS grp, CAST(0 AS BIGINT) AS id, 'PURCHASE' AS entry_id, CAST(first_at AS DATE) AS entry_date, 'Purchase Entry' AS description, {js_round('cost')} AS debit, CAST(NULL AS BIGINT) AS credit FROM c
 UNION ALL SELECT ref_no, 1, id, CAST(id AS VARCHAR), payment_date, CASE WHEN type = 'adjustment' THEN 'Adjustment' ELSE 'Payment (' || COALESCE(payment_method, 'null') || ')' END, NULL, {js_round('amount')} FROM fx_purchase_payments)
SELECT ref_no, entry_id, entry_date, description, debit, credit, CAST(sum(COALESCE(debit, 0) - COALESCE(credit, 0)) OVER (PARTITION BY ref_no ORDER BY grp, CASE WHEN grp = 1 THEN entry_date END, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM e""",
    "purchase_payables_pending": f"""
WITH {REF_NAME}, t AS (SELECT ref_no, {js_round('sum(purchase_pkr)')} AS total FROM fx_purchases WHERE NOT is_deleted GROUP BY ref_no),
 p AS (SELECT ref_no, {js_round('sum(amount)')} AS paid FROM fx_purchase_payments GROUP BY ref_no)
SELECT t.ref_no, COALESCE(name, '') AS customer_name, CASE WHEN COALESCE(paid, 0) > 0 THEN 'PARTIAL' ELSE 'PENDING' END AS status,
 CASE WHEN COALESCE(paid, 0) > 0 THEN 'Payment partially made' ELSE 'Payment not made' END AS note
FROM t LEFT JOIN p ON p.ref_no = t.ref_no LEFT JOIN refname n ON n.ref_no = t.ref_no WHERE total > 0 AND COALESCE(paid, 0) < total""",
    "bs_walkin": f"WITH {BS_WALKIN} SELECT * FROM walkin",
    "bs_registered": f"""
WITH {code_name(True)}, {BS_REGISTERED} SELECT reg.customer_code, COALESCE(name, 'Registered Client') AS customer_name, sale_total, received, balance,
 CASE WHEN balance > 0 AND received = 0 THEN 'PENDING' WHEN balance > 0 THEN 'PARTIAL' WHEN balance = 0 THEN 'PAID' ELSE 'EXTRA PAID' END AS status FROM reg LEFT JOIN codename n ON n.customer_code = reg.customer_code""",
    "bs_suppliers": f"""
WITH {POSITIONS} SELECT supplier_code, supplier_name, owed AS purchase_total, paid, balance,
 CASE WHEN balance < 0 THEN 'EXTRA PAID' WHEN balance = 0 THEN 'PAID' WHEN paid > 0 THEN 'PARTIAL' ELSE 'PENDING' END AS status FROM pos""",
    "bs_summary": f"""
WITH {BS_WALKIN}, {BS_REGISTERED}, {POSITIONS}, c AS (SELECT balance FROM walkin UNION ALL SELECT balance FROM reg)
SELECT CAST((SELECT COALESCE(sum(balance), 0) FROM c WHERE balance > 0) AS {DEC}) AS total_receivable, CAST((SELECT COALESCE(sum(balance), 0) FROM pos WHERE balance > 0) AS {DEC}) AS total_payable,
 CAST((SELECT COALESCE(-sum(balance), 0) FROM c WHERE balance < 0) AS {DEC}) AS total_extra_received, CAST((SELECT COALESCE(-sum(balance), 0) FROM pos WHERE balance < 0) AS {DEC}) AS total_extra_paid""",
    "payment_status_stream": f"""
WITH r AS ({WALKIN_STATUS}) SELECT k.ref_no, COALESCE(r.payment_status, 'PENDING') AS payment_status
FROM (SELECT DISTINCT ref_no FROM fx_customer_payments WHERE ref_no NOT LIKE 'CUST-%') k LEFT JOIN r ON r.ref_no = k.ref_no""",
}

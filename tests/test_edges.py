"""Hand-made rows with known answers."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook import Books
from tallybook.functions import coerce, status
from tallybook.operators.keyed import upsert
from tallybook.plans import changes, close, intake, ledgers, lines, outstanding, profit, purchases, sales

D = Decimal
DAY = dt.date(2024, 1, 5)
SALES = (
    "id bigint, prefix string, ref_no string, customer_code string, customer_name string, booking_date date,"
    " created_at timestamp_ntz, total_pkr decimal(18,2), payment_status string, purchase_status string, is_deleted boolean"
)
PAYMENTS = (
    "id bigint, ref_no string, payment_date date, amount decimal(18,2), type string, payment_method string,"
    " bank_profile_id bigint, is_deleted boolean"
)
SUPPLIER_PAYMENTS = (
    "id bigint, supplier_id bigint, payment_date date, amount decimal(18,2), type string, payment_method string, bank_profile_id bigint"
)
SNAPSHOTS = (
    "id bigint, date_from date, date_to date, opening_cash decimal(18,2), opening_bank decimal(18,2)"
)
BALANCES = "snapshot_id bigint, balance_type string, code string, name string, balance decimal(18,2), status string"
PURCHASES = (
    "id bigint, ref_no string, item string, sale_sar decimal(18,2), sale_rate decimal(18,2), sale_pkr decimal(18,2),"
    " purchase_sar decimal(18,2), purchase_rate decimal(18,2), purchase_pkr decimal(18,2), profit decimal(18,2),"
    " supplier_code string, supplier_name string, status string, created_at timestamp_ntz, is_deleted boolean"
)
BANKS = "id bigint, bank_name string"
EMPTY = {
    "sales": SALES,
    "customer_payments": PAYMENTS,
    "supplier_payments": SUPPLIER_PAYMENTS,
    "purchase_payments": "id bigint, ref_no string, payment_date date, amount decimal(18,2), type string, payment_method string",
    "purchases": PURCHASES,
    "expenses": "id bigint, expense_date date, title string, amount decimal(18,2), payment_method string, bank_profile_id bigint",
    "cash_txns": "id bigint, txn_date date, created_at timestamp_ntz, type string, amount decimal(18,2), comment string",
    "bank_txns": "id bigint, txn_date date, created_at timestamp_ntz, type string, amount decimal(18,2), comment string, bank_profile_id bigint",
    "suppliers": "id bigint, supplier_code string, supplier_name string, is_deleted boolean",
    "customers": "id bigint, customer_code string, name string, is_deleted boolean",
    "banks": BANKS,
    "snapshots": SNAPSHOTS,
    "balances": BALANCES,
}


def make(spark, **rows):
    return Books({t: spark.createDataFrame(rows.get(t, []), schema) for t, schema in EMPTY.items()})


def sale(ref, total, id=1, code=None, name="Ali", pay="PENDING", deleted=False, day=DAY):
    prefix = ref.split("-")[0] + "-"
    at = dt.datetime.combine(day, dt.time())
    return (id, prefix, ref, code, name, day, at, None if total is None else D(total), pay, "PENDING", deleted)


def purchase(ref, item, sar, rate, id=1, deleted=False, code="SUP-1", day=DAY, state="Purchase"):
    cost = D(sar) * D(rate)
    at = dt.datetime.combine(day, dt.time(23, 59))
    return (id, ref, item, D(1), D(1), D(1), D(sar), D(rate), cost, D(1) - cost, code, "S", state, at, deleted)


def one(df):
    return [tuple(r) for r in df.collect()]


def test_two_rounding_rules(spark):
    values = [D("2.5"), D("-2.5"), D("0.5"), D("0.49"), D("-0.5"), None]
    df = spark.createDataFrame([(v,) for v in values], "x decimal(18,2)")
    assert [r[0] for r in df.select(coerce.half_up("x")).collect()] == [3, -2, 1, 0, 0, 0]
    assert [r[0] for r in df.select(coerce.half_away("x")).collect()] == [3, -3, 1, 0, -1, None]


def test_unreadable_number_is_zero(spark):
    df = spark.createDataFrame([("3.5",), ("",), ("abc",), (None,), (" 7 ",)], "x string")
    assert [r[0] for r in df.select(coerce.number("x")).collect()] == [D("3.50"), 0, 0, 0, 7]


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([(1,), (99999,), (123456,)], "n bigint")
    assert [r[0] for r in df.select(coerce.padded(F.col("n"), 5)).collect()] == ["00001", "99999", "123456"]


def test_sale_status_ladder(spark):
    rows = [(0, 5), (10, 0), (10, -1), (10, 3), (10, 10), (10, 11)]
    df = spark.createDataFrame(rows, "sale int, paid int")
    got = [r[0] for r in df.select(status.sale_payment_status(F.col("sale"), F.col("paid"))).collect()]
    assert got == ["PENDING", "PENDING", "PENDING", "PARTIAL", "COMPLETE", "COMPLETE"]


def test_supplier_status_tolerance(spark):
    rows = [("0.50", 0), ("-0.50", 0), ("0.51", 0), ("0.51", 1), ("-0.51", 1)]
    df = spark.createDataFrame([(D(b), p) for b, p in rows], "b decimal(18,2), p int")
    loose = [r[0] for r in df.select(status.supplier_status(F.col("b"), F.col("p"), "0.5")).collect()]
    exact = [r[0] for r in df.select(status.supplier_status(F.col("b"), F.col("p"))).collect()]
    assert loose == ["PAID", "PAID", "PENDING", "PARTIAL", "EXTRA PAID"]
    assert exact == ["PENDING", "EXTRA PAID", "PENDING", "PARTIAL", "EXTRA PAID"]


def test_cash_ledger_ties_share_a_balance(spark):
    """Same day and id in two sources: both show the balance after both."""
    b = make(
        spark,
        expenses=[(7, DAY, "Tea", D("10.50"), "Cash", None)],
        cash_txns=[
            (7, DAY, dt.datetime(2024, 1, 5), "deposit", D("100.00"), "in"),
            (8, DAY, dt.datetime(2024, 1, 5), "withdraw", D("-2.50"), "odd"),
            (9, DAY, dt.datetime(2024, 1, 5), "other", D("5.00"), "neither"),
        ],
    )
    got = {(r.id, r.source): (r.credit, r.debit, r.balance) for r in ledgers.cash_ledger(b).collect()}
    assert got[(7, "expense")] == (0, 11, 89)
    assert got[(7, "manual")] == (100, 0, 89)
    assert got[(8, "manual")] == (0, -3, 92)
    assert got[(9, "manual")] == (0, 0, 92)


def test_cash_and_bank_cutoffs(spark):
    """Cash starts after the closing day, bank on it; the opening is added only on request."""
    closed = dt.date(2024, 1, 4)
    pay = lambda i, day, m: (i, "CUST-1", day, D(10), "payment", m, 1, i == 9)
    b = make(
        spark,
        snapshots=[(1, closed, closed, D(500), D(900))],
        customer_payments=[
            pay(1, closed, "cash"),
            pay(2, DAY, "CASH"),
            pay(3, closed, "Bank"),
            pay(9, DAY, "cash"),
            pay(10, DAY, "bank"),
            (11, "CUST-1", DAY, D(10), "Adjustment", "cash", None, False),
            (12, "CUST-1", DAY, D(10), None, "cash", None, False),
        ],
    )
    assert [r.id for r in ledgers.cash_ledger(b).collect()] == [2, 12]
    assert [r.balance for r in ledgers.cash_ledger(b, with_opening=True).collect()] == [510, 520]
    assert [(r.id, r.balance) for r in ledgers.bank_ledger(b).collect()] == [(3, 10), (10, 20)]
    assert [r.balance for r in ledgers.bank_ledger(b, with_opening=True).collect()] == [910, 920]


def test_walkin_ledger(spark):
    b = make(
        spark,
        sales=[sale("PKG-1", "100.50", name=None), sale("HOT-1", "0", id=2), sale("VISA-1", "5", id=3, code="CUST-9")],
        customer_payments=[
            (5, "PKG-1", DAY, D("20.50"), "payment", "Bank", 1, False),
            (4, "PKG-1", DAY, D("10.49"), "adjustment", "cash", None, True),
            (6, "HOT-1", DAY, D("1"), None, None, 7, False),
            (7, "VISA-1", DAY, D("1"), None, "cash", None, False),
        ],
        banks=[(1, "Meezan")],
    )
    rows = sorted(
        (r.ref_no, r.line_group, r.entry_id, r.description, r.debit, r.credit, r.balance)
        for r in ledgers.walkin_ledger(b).collect()
    )
    assert rows == [
        ("HOT-1", 0, "CUSTOMER", "Customer: Ali", 0, 0, 0),
        ("HOT-1", 2, "6", "Payment Received ()", 1, 0, -1),
        ("PKG-1", 0, "CUSTOMER", "Customer: null", 0, 0, 0),
        ("PKG-1", 1, "SALE", "Sale Invoice", 0, 101, 101),
        ("PKG-1", 2, "4", "Adjustment", 10, 0, 91),
        ("PKG-1", 2, "5", "Payment Received (Bank: Meezan)", 21, 0, 70),
    ]


def test_statement_carries_the_balance(spark):
    early = dt.date(2023, 12, 1)
    b = make(
        spark,
        sales=[sale("PKG-1", "100", code="CUST-1", day=early), sale("HOT-2", "7", id=2, code="CUST-1")],
        customer_payments=[(1, "CUST-1", DAY, D(30), "payment", "cash", None, False)],
    )
    rows = one(ledgers.registered_ledger(b, DAY, DAY).select("entry_id", "balance").orderBy("entry_id"))
    assert rows == [("1", 77), ("SALE-HOT-2", 107)]


def test_null_type_payments_of_suppliers_count_nowhere(spark):
    b = make(
        spark,
        suppliers=[(1, "SUP-1", "S", False), (2, "SUP-2", "T", True)],
        supplier_payments=[
            (1, 1, DAY, D(5), None, "cash", None),
            (2, 1, DAY, D(7), "opening_balance", "cash", None),
            (3, 1, DAY, D(2), "adjustment", "cash", None),
        ],
    )
    assert one(outstanding.supplier_pending(b)) == [("SUP-1", "S", D("7.00"), D("2.00"), D("5.00"), "PARTIAL")]


def test_supplier_ledger_opening_and_labels(spark):
    closed = dt.date(2024, 1, 1)
    b = make(
        spark,
        snapshots=[(1, closed, closed, None, None)],
        balances=[(1, "SUPPLIER", "SUP-1", "S", D("-40"), None)],
        suppliers=[(1, "SUP-1", "S", False)],
        purchases=[purchase("PKG-1", "Hotel", "2", "10", id=3), purchase("PKG-1", "Old", "2", "10", id=4, day=closed)],
        supplier_payments=[
            (3, 1, DAY, D(5), "opening_balance", "cash", None),
            (4, 1, DAY, D(6), "payment", "Cash", None),
            (5, 1, DAY, D(9), None, None, None),
        ],
    )
    rows = [
        (r.id, r.type, r.description, r.debit, r.credit, r.entry_type, r.balance)
        for r in ledgers.supplier_ledger(b).orderBy("entry_date", "id", "entry_type").collect()
    ]
    assert rows == [
        (0, "Snapshot Opening", "Snapshot Opening ()", 0, 40, "snapshot", -40),
        (3, "Opening Bal", "opening_balance", 5, 0, "payment", -15),
        (3, "Purchase", "Hotel", 20, 0, "purchase", -20),
        (4, "payment", "payment (Cash)", 0, 6, "payment", -21),
        (5, None, "null ()", 0, 0, "purchase", -21),
    ]


def test_repeated_ref_does_not_fan_out(spark):
    b = make(
        spark,
        sales=[sale("PKG-1", "1", name="A"), sale("PKG-1", "1", id=2, name="B")],
        purchases=[purchase("PKG-1", "x", "2", "10")],
    )
    row = purchases.purchase_list(b).collect()
    assert [(r.customer_name, r.purchase_pkr) for r in row] == [("B", D("20.00"))]


def test_search_takes_wildcards_literally(spark):
    b = make(spark, purchases=[purchase("PKG-1", "x", "2", "10")])
    assert purchases.purchase_list(b, search="%").count() == 0
    assert purchases.purchase_list(b, search="kg-").count() == 1


def test_unify_sales_prunes_branches(spark):
    tables = {}
    for i, (prefix, table) in enumerate((("PKG-", "bookings"), ("VISA-", "visa"))):
        tables[table] = spark.createDataFrame([sale(f"{prefix}1", "5", id=i)], SALES).drop("prefix")
    both = sales.unify_sales(tables)
    assert sorted(r.prefix for r in both.collect()) == ["PKG-", "VISA-"]
    plan = both.where("prefix = 'VISA-'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_reference_numbers(spark):
    refs = ["PKG-00001", "PKG-99999", "PKG-100000", "HOT-none"]
    b = make(spark, sales=[sale(r, "1", id=i) for i, r in enumerate(refs)])
    assert dict(one(changes.ref_high_water(b))) == {"PKG-": 100000, "HOT-": 0}
    asked = spark.createDataFrame([(5, "PKG-"), (3, "PKG-"), (1, "SUP-"), (2, "TIC-")], "request_id bigint, prefix string")
    got = {r.request_id: r.ref_no for r in changes.ref_allocate(b, asked).collect()}
    assert got == {3: "PKG-100001", 5: "PKG-100002", 1: "SUP-0001", 2: "TIC-00001"}


REQUEST = "ref_no string, position int, item string, sale_sar string, sale_rate string, purchase_sar string, purchase_rate string, supplier_code string, supplier_name string, id bigint, status string, created_at timestamp_ntz"


def test_purchase_upsert(spark):
    now = dt.datetime(2024, 2, 2)
    b = make(spark, purchases=[purchase("PKG-1", "Hotel", "1", "1", deleted=True), purchase("PKG-2", "Visa", "1", "1", id=2)])
    asked = spark.createDataFrame(
        [
            ("PKG-1", 0, "Hotel", "10", "2", "4", "3", None, "S", 90, "x", now),
            ("PKG-1", 1, " Hotel ", "99", "9", "9", "9", "SUP-9", "S", 91, "x", now),
            ("PKG-1", 2, "", "1", "1", "1", "1", "SUP-9", "S", 92, "x", now),
            ("PKG-3", 0, "New", "abc", "2", "4", "", "SUP-9", "S", 93, "x", now),
        ],
        REQUEST,
    )
    once = changes.purchase_upsert(b, asked)
    rows = {(r.ref_no, r.item): r for r in once.collect()}
    assert set(rows) == {("PKG-1", "Hotel"), ("PKG-2", "Visa"), ("PKG-3", "New")}
    hotel, new = rows[("PKG-1", "Hotel")], rows[("PKG-3", "New")]
    assert (hotel.sale_pkr, hotel.purchase_pkr, hotel.profit, hotel.is_deleted, hotel.id) == (20, 12, 8, False, 1)
    assert hotel.created_at == dt.datetime(2024, 1, 5, 23, 59) and hotel.supplier_code == ""
    assert (new.sale_pkr, new.purchase_pkr, new.profit, new.id) == (0, 0, 0, 93)
    twice = changes.purchase_upsert(b.replace(purchases=once), asked)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
    statuses = dict(one(changes.costing_of_refs(changes.clean_purchase_items(asked))))
    assert statuses == {"PKG-1": "COMPLETE", "PKG-3": "PENDING"}


def test_upsert_without_insert(spark):
    current = spark.createDataFrame([(1, "a")], "id int, v string")
    changed = spark.createDataFrame([(1, None), (2, "z")], "id int, v string")
    assert one(upsert(current, changed, ["id"], update=["v"], insert=False)) == [(1, None)]


def test_deletes(spark):
    b = make(
        spark,
        sales=[sale("PKG-1", "1"), sale("PKG-2", "1", id=2, deleted=True), sale("PKG-3", "1", id=3), sale("PKG-4", "1", id=4)],
        purchases=[
            purchase("PKG-1", "x", "1", "5"),
            purchase("PKG-8", "a", "1", "5", id=2, deleted=True),
            purchase("PKG-8", "b", "1", "5", id=3),
            purchase("PKG-9", "a", "1", "5", id=4, deleted=True, state="Live Purchase"),
        ],
        customer_payments=[
            (1, "PKG-3", DAY, D(1), "payment", "cash", None, False),
            (2, "PKG-4", DAY, D(1), "adjustment", "cash", None, False),
        ],
    )
    can = {r.ref_no: r.deletable for r in changes.delete_eligibility(b).collect()}
    assert can == {"PKG-1": False, "PKG-2": True, "PKG-3": False, "PKG-4": True}
    keys = spark.createDataFrame([("PKG-1",), ("PKG-2",), ("PKG-1",)], "ref_no string")
    flags = {r.ref_no: r.is_deleted for r in changes.soft_delete(b.sales, keys).collect()}
    assert flags == {"PKG-1": True, "PKG-2": True, "PKG-3": False, "PKG-4": False}
    assert changes.restore(changes.soft_delete(b.sales, keys), keys).where("is_deleted").count() == 0
    kept = {r.ref_no for r in changes.permanent_delete(b.sales, keys).collect()}
    assert kept == {"PKG-1", "PKG-3", "PKG-4"}
    back = spark.createDataFrame([("PKG-8",), ("PKG-9",)], "ref_no string")
    restored = {(r.ref_no, r.item): r.is_deleted for r in changes.restore_purchases(b, back).collect()}
    assert restored[("PKG-8", "a")] is True and restored[("PKG-9", "a")] is False
    ids = spark.createDataFrame([(3,), (4,)], "id bigint")
    assert {r.id for r in changes.purchase_entry_delete(b, ids).collect()} == {1, 2, 4}


def test_purge(spark):
    inside, outside = dt.date(2024, 1, 31), dt.date(2024, 2, 1)
    first, last = dt.date(2024, 1, 1), dt.date(2024, 1, 31)
    rows = [purchase("PKG-1", "a", "1", "5", day=inside), purchase("PKG-1", "b", "1", "5", id=2, day=outside)]
    undated = (3, "PKG-2", "c", *[D(1)] * 7, "SUP-1", "S", "x", None, False)
    b = make(spark, sales=[sale("PKG-1", "1", day=inside), sale("GRP-1", "1", id=2, day=inside)], purchases=[*rows, undated])
    counts = dict(one(close.purge_counts(b, first, last)))
    assert (counts["bookings"], counts["groups"], counts["purchase_entries"], counts["expense_ledger"] if "expense_ledger" in counts else 0) == (1, 1, 1, 0)
    kept = close.purge_retained(b, "purchases", first, last)
    assert {r.item for r in kept.collect()} == {"b", "c"}
    assert kept.count() + counts["purchase_entries"] == b.purchases.count()
    assert close.purge_log(b, first, last).count() == 0
    with_close = b.replace(snapshots=spark.createDataFrame([(4, first, last, None, None)], SNAPSHOTS))
    logged = close.purge_log(with_close, first, last).collect()[0]
    assert (logged.snapshot_id, logged.groups_count, logged.ziyarat_count) == (4, 1, 0)
    done = b.replace(snapshots=with_close.snapshots, logs=spark.createDataFrame([(4,)], "snapshot_id bigint"))
    assert close.purgeable(done, 4).count() == 0
    assert close.purgeable(done.replace(logs=spark.createDataFrame([(5,)], "snapshot_id bigint")), 4).count() == 1


def test_month_spine_keeps_the_last_month(spark):
    rows = one(profit.month_spine(spark, dt.date(2023, 12, 20), dt.date(2024, 2, 3)).select("report_year", "report_month"))
    assert rows == [(2023, 12), (2024, 1), (2024, 2)]


def test_intake_rules(spark):
    schema = "request_id bigint, kind string, party string, amount string, entry_date string, payment_method string, bank_profile_id string, type string, note string"
    rows = [
        (1, "customer", "PKG-1", "5", "2024-01-05", None, "3", None, None),
        (2, "customer", "", "5", "2024-01-05", None, None, None, None),
        (3, "registered", "CUST-1", "-1", "2024-01-05", None, None, None, None),
        (4, "registered", "CUST-1", "1", None, None, None, None, None),
        (5, "purchase", "PKG-1", "2.5", "2024-01-05", "Bank", "3", "", None),
        (6, "supplier", "SUP-9", "1", "2024-01-05", "Bank", "3", "payment", None),
        (7, "expense", "Tea", "1", "2024-01-05", "", None, None, None),
        (8, "bank", None, "1", "2024-01-05", None, "4", "deposit", None),
        (9, "cash", None, "0", "2024-01-05", None, None, "deposit", None),
        (10, "customer", "PKG-1", "1", "soon", None, None, None, None),
    ]
    suppliers = spark.createDataFrame([(1, "SUP-1")], "id bigint, supplier_code string")
    out = {r.request_id: r for r in intake.checked(spark.createDataFrame(rows, schema), suppliers).collect()}
    reasons = {i: r.reason for i, r in out.items()}
    assert reasons == {
        1: None,
        2: "Ref No required",
        3: "Amount must be greater than zero",
        4: "Payment Date is required",
        5: None,
        6: "Supplier not found",
        7: "Missing required fields",
        8: None,
        9: "Missing fields",
        10: "Invalid date",
    }
    assert (out[1].payment_method, out[1].bank_profile_id, out[1].type) == ("cash", None, "payment")
    assert (out[5].amount, out[5].payment_method, out[5].bank_profile_id, out[5].type) == (3, "Bank", 3, "payment")
    assert (out[8].bank_profile_id, out[8].note) == (4, "")


def package(**more):
    row = {
        "ref_no": "PKG-1",
        "is_deleted": False,
        "adult_count": 2,
        "child_count": 0,
        "infant_count": 1,
        "adult_rate": D(100),
        "child_rate": D(50),
        "infant_rate": D(10),
        "flight_sar_rate": D(75),
        "hotel_sar_rate": D(76),
        "visa_sar_rate": None,
        "transport_sar_rate": D(77),
        "ziyarat_sar_rate": D(78),
        "flights": None,
        "hotels": None,
        "visa": None,
        "transport": None,
        "ziyarat": None,
    }
    return {k: json.dumps(v) if isinstance(v, list) else v for k, v in (row | more).items()}


PACKAGE = (
    "ref_no string, is_deleted boolean, adult_count int, child_count int, infant_count int, adult_rate decimal(18,2), child_rate decimal(18,2),"
    " infant_rate decimal(18,2), flight_sar_rate decimal(18,2), hotel_sar_rate decimal(18,2), visa_sar_rate decimal(18,2), transport_sar_rate decimal(18,2),"
    " ziyarat_sar_rate decimal(18,2), flights string, hotels string, visa string, transport string, ziyarat string"
)


def test_package_lines(spark):
    rows = [
        package(
            flights=[{"airline_name": "PIA", "from": "LHE", "flight_to": "JED"}, {"airline": "other"}],
            hotels=[{"hotel": "Hilton", "type": "quad", "rooms": 2, "nights": "1", "total": "500"}, {"total": "x"}],
            visa=[{"type": "Umrah", "persons": 3, "rate": 10}, {"persons": 1, "rate": 10, "total": 0}],
            transport=[{"route": "A-B", "amount": 40}, {}],
            ziyarat=[{"description": "Badr", "amount": "7.5"}],
        ),
        package(ref_no="PKG-2", adult_count=0, infant_count=0),
        package(ref_no="PKG-3", is_deleted=True),
    ]
    books = Books(bookings=spark.createDataFrame(rows, PACKAGE))
    got = sorted((r.item, r.sale_sar, r.sale_rate, r.sale_pkr) for r in lines.purchase_lines(books, "pkg").collect())
    assert got == sorted(
        [
            ("Ticket – Adult (2 Persons) - PIA | LHE → JED", 200, 75, 15000),
            ("Ticket – Infant (1 Person) - PIA | LHE → JED", 10, 75, 750),
            ("Hotel 1 - Hilton (QUAD, 2 Rooms, 1 Night)", 500, 76, 38000),
            ("Hotel 2 -  (0 Room, 0 Night)", 0, 76, 0),
            ("Visa 1 - Umrah (3 Persons)", 30, 0, 0),
            ("Visa 2 (1 Person)", 0, 0, 0),
            ("Transport 1 - A-B", 40, 77, 3080),
            ("Transport 2", 0, 77, 0),
            ("Ziyarat 1 - Badr", D("7.5"), 78, 585),
        ]
    )


def test_module_rows_and_short_arrays(spark):
    visa = spark.createDataFrame(
        [("VISA-1", False, json.dumps([{"type": "", "persons": 2, "rate": 5, "total": 0}, {"type": "Visit", "persons": 1, "total": "9"}]), D(70)),
         ("VISA-2", False, None, D(70)), ("VISA-3", False, "{}", D(70)), ("VISA-4", False, "[broken", D(70)), ("VISA-5", False, "[]", D(70))],
        "ref_no string, is_deleted boolean, rows string, pkr_rate decimal(18,2)",
    )
    got = sorted((r.item, r.sale_sar) for r in lines.lines_visa(Books(visa=visa)).collect())
    assert got == [("Visa (2 Persons)", 10), ("Visa 2 - Visit (1 Person)", 9)]
    totals = {r.ref_no: (r.persons, r.total_sar, r.total_pkr) for r in lines.rows_totals(visa).collect()}
    assert totals.pop("VISA-1") == (3, 9, 630)
    assert set(totals.values()) == {(0, 0, 0)} and len(totals) == 4
    columns = [c for c in lines.STAY_COLUMNS.values()]
    row = {c: json.dumps(["x", "y"] if c == "hotel_name" else ["1"]) for c in columns}
    hotels = spark.createDataFrame(
        [("HOT-1", False, D(70), *row.values())],
        "ref_no string, is_deleted boolean, sar_rate decimal(18,2), " + ", ".join(f"{c} string" for c in columns),
    )
    assert sorted(r.item for r in lines.lines_hot(Books(hotels=hotels)).collect()) == [
        "Hotel 1 - x (1, 1 Room, 1 Night)",
        "Hotel 2 - y (0 Room, 0 Night)",
    ]
    stays = {r.stay_no: r for r in lines.hotel_stays(Books(hotels=hotels)).collect()}
    assert stays[2].hotel == "y" and stays[2].rooms is None and stays[1].checkIn == "1"


def test_worksheet_prefers_the_full_item(spark):
    asked = spark.createDataFrame(
        [("PKG-1", "Hotel 1 - A", D(10), D(2), D(20)), ("PKG-1", "Hotel 2 - B", D(10), D(2), D(20)),
         ("PKG-1", "Visa (1 Person)", D(10), D(2), D(20)), ("PKG-1", "Other", D(10), D(2), D(20))],
        "ref_no string, item string, sale_sar decimal(18,2), sale_rate decimal(18,2), sale_pkr decimal(20,2)",
    )
    b = make(
        spark,
        purchases=[
            purchase("PKG-1", "Hotel 1 - A", "4", "2"),
            purchase("PKG-1", "Hotel 1", "9", "9", id=2),
            purchase("PKG-1", "Hotel 2", "3", "2", id=3),
            purchase("PKG-1", "Visa (1 Person)", "0", "2", id=4),
        ],
    )
    got = {r.item: (r.purchase_sar, r.purchase_pkr, r.profit) for r in lines.purchase_worksheet(b, asked).collect()}
    assert got == {
        "Hotel 1 - A": (4, 8, 12),
        "Hotel 2 - B": (3, 6, 14),
        "Visa (1 Person)": (None, 0, 0),
        "Other": (None, None, None),
    }


@pytest.mark.parametrize("year, source", [(1995, "combined"), (1996, "combined"), (1998, "live")])
def test_year_source(books, year, source):
    assert profit.profit_year(books, year).collect()[0].source == source


def test_summary_is_the_sum_of_sections(books):
    from tallybook.plans import balance

    summary = balance.bs_summary(books).collect()[0]
    customers = [r.balance for f in (balance.bs_walkin, balance.bs_registered) for r in f(books).collect()]
    suppliers = [r.balance for r in balance.bs_suppliers(books).collect()]
    assert summary.total_receivable == sum(x for x in customers if x > 0)
    assert summary.total_extra_received == -sum(x for x in customers if x < 0)
    assert summary.total_payable == sum(x for x in suppliers if x > 0)
    assert summary.total_extra_paid == -sum(x for x in suppliers if x < 0)


def test_archived_and_live_equal_live_when_nothing_is_archived(books):
    bare = books.replace(profit_months=books.profit_months.where("false"))
    live = {r.report_month: r for r in profit.live_months(books, dt.date(1996, 1, 1), dt.date(1996, 12, 31)).collect()}
    for r in profit.combined_months(bare, 1996).collect():
        assert r.source == "live" and r.total_sales == live[r.report_month].total_sales


def test_repeated_edits_and_requests_change_a_row_once(spark):
    """The later edit wins, a key asked for twice stays one row, and a merge adds a repeated id once."""
    from tallybook.operators.keyed import upsert
    from tallybook.sources.csv_io import merge_import

    current = spark.createDataFrame([(1, 5), (2, 6)], "id long, amount long")
    changes = spark.createDataFrame([(1, 7, 1), (1, 9, 2), (3, 1, 1), (3, 2, 1), (None, 4, 1), (None, 4, 1)], "id long, amount long, edit_no long")
    got = upsert(current, changes, ["id"], update=["amount"], order=[F.desc("edit_no")])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 9), (2, 6), (3, 1), (None, 4), (None, 4)]
    merged = merge_import(current, spark.createDataFrame([(2, 9), (4, 1), (4, 3)], "id long, amount long"))
    assert sorted(map(tuple, merged.collect())) == [(1, 5), (2, 6), (4, 1)]


def test_undated_rows_count_while_nothing_is_closed(spark, books):
    open_books_ = books.replace(snapshots=books.snapshots.where("false"), supplier_payments=books.supplier_payments.withColumn("payment_date", F.lit(None).cast("date")))
    from tallybook.plans.outstanding import supplier_positions

    paid = supplier_positions(open_books_).agg(F.sum("paid")).first()[0]
    want = books.supplier_payments.where("type <> 'opening_balance'").join(books.suppliers, F.col("supplier_id") == books.suppliers["id"]).where("not is_deleted").agg(F.sum("amount")).first()[0]
    assert paid == want and paid > 0


def test_ticket_routes_as_plain_text(spark):
    columns = "adult_qty int, child_qty int, infant_qty int, adult_rate double, child_rate double, infant_rate double, pkr_rate double"
    routes = [("Lahore", "Jeddah", "9 Air"), ('"Lahore"', '["Jeddah", "Medina"]', None), ("{}", "Jeddah", "null"), ("", "Jeddah", "PIA")]
    rows = [(f"TIC-{k}", False, 2, 0, 0, 1.0, 1.0, 1.0, 70.0, *r) for k, r in enumerate(routes)]
    schema = f"ref_no string, is_deleted boolean, {columns}, flight_from string, flight_to string, airline string"
    found = lines.lines_tic(Books({"ticketing": spark.createDataFrame(rows, schema)})).orderBy("ref_no").collect()
    assert [r["item"].partition(" - ")[2] for r in found] == ["9 Air | Lahore → Jeddah", "Lahore → Jeddah, Medina", "", "PIA"]

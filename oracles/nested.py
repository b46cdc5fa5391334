"""Nested sales, from the flat rules their fixtures follow."""

from tallybook.sources.fixtures import ref_sql

REF = ref_sql("o_orderkey")
RATE = "CAST(70 + o_custkey % 10 AS DECIMAL(18,2))"
PERSONS = "CAST((o_custkey + i) % 5 AS BIGINT)"
PRICE = "(100 + (o_orderkey * i) % 400)"
KIND = "CASE (o_orderkey + i) % 4 WHEN 1 THEN 'Umrah' WHEN 2 THEN 'Visit' END"


def elements(module: int, count: str = "1 + o_orderkey % 3", active: str = "o_orderkey % 17 <> 0") -> str:
    return f"(SELECT *, unnest(range(1, CAST({count} AS BIGINT) + 1)) AS i FROM orders WHERE o_orderkey % 8 = {module} AND {active}) o"


def counted(n: str, unit: str) -> str:
    return f"CAST({n} AS VARCHAR) || ' {unit}' || CASE WHEN {n} > 1 THEN 's' ELSE '' END"


def lines(item: str, sar: str, rate: str, source: str) -> str:
    return f"SELECT {REF} AS ref_no, {item} AS item, CAST({sar} AS DECIMAL(18,2)) AS sale_sar, CAST({rate} AS DECIMAL(18,2)) AS sale_rate FROM {source}"


def priced(name: str, module: int) -> str:
    item = f"CASE WHEN {KIND} IS NOT NULL THEN '{name} ' || i || ' - ' || {KIND} ELSE '{name}' END || ' (' || {counted(PERSONS, 'Person')} || ')'"
    return lines(item, f"{PERSONS} * {PRICE}", RATE, elements(module))


TEXT = {
    "description": "CASE WHEN o_orderkey % 3 = 0 THEN 'D' || i END",
    "text": "CASE WHEN (o_orderkey + i) % 2 = 0 THEN 'T' || i END",
    "route": "CASE WHEN o_custkey % 4 <> 0 THEN 'R' || i END",
}


def labelled(name: str, order: str, rate: str, source: str) -> str:
    label = "COALESCE(" + ", ".join(TEXT[o] for o in order.split()) + ")"
    item = f"'{name} ' || i || COALESCE(' - ' || {label}, '')"
    return lines(item, "CASE WHEN o_custkey % 6 = 0 THEN 0 ELSE 50 + (o_custkey * i) % 90 END", rate, source)


ROOMS, NIGHTS = "((o_orderkey + i) % 3)", "((o_custkey + i) % 4)"
STAY_KIND = "CASE WHEN (o_orderkey + i) % 3 = 0 THEN '' ELSE 'quad' END"
STAY = f"'Hotel ' || i || ' - Hotel ' || ((o_custkey + i) % 9) || ' (' || CASE WHEN {STAY_KIND} = '' THEN '' ELSE 'QUAD, ' END || {counted(ROOMS, 'Room')} || ', ' || {counted(NIGHTS, 'Night')} || ')'"


def airline(i: str) -> str:
    return f"CASE WHEN (o_custkey + {i}) % 3 = 0 THEN '' ELSE 'PK' || ((o_custkey + {i}) % 7) END"


def start(i: str) -> str:
    return f"CASE WHEN (o_orderkey + {i}) % 5 = 0 THEN '' ELSE 'LHE' END"


def goal(i: str) -> str:
    return f"CASE WHEN (o_custkey + {i}) % 2 = 0 THEN 'JED' ELSE 'MED' END"


def tickets(module: int, flights: str) -> str:
    classes = " UNION ALL ".join(
        f"SELECT *, '{name}' AS cls, o_custkey % {n} AS cnt, {price} AS price FROM orders WHERE o_orderkey % 8 = {module} AND o_orderkey % 17 <> 0"
        for name, n, price in (("Adult", 4, 900), ("Child", 3, 700), ("Infant", 2, 200))
    )
    info = "concat_ws(' | ', NULLIF(al, ''), CASE WHEN fr <> '' AND go <> '' THEN fr || ' → ' || go END)"
    item = f"'Ticket – ' || cls || ' (' || {counted('cnt', 'Person')} || ')' || CASE WHEN {info} <> '' THEN ' - ' || {info} ELSE '' END"
    return lines(item, "cnt * price", RATE, f"(SELECT *, {flights} FROM ({classes}) c WHERE cnt > 0) o")


FIRST_FLIGHT = ", ".join(
    f"CASE WHEN o_custkey % 5 = 0 THEN '' ELSE {f('1')} END AS {a}" for f, a in ((airline, "al"), (start, "fr"), (goal, "go"))
)
ALL_FLIGHTS = ", ".join(
    f"array_to_string(list_transform(range(1, CAST(2 + o_orderkey % 3 AS BIGINT)), lambda i: {f('i')}), ', ') AS {a}"
    for f, a in ((airline, "al"), (start, "fr"), (goal, "go"))
)
PKG_VISA = lines(
    f"'Visa ' || i || COALESCE(' - ' || {KIND}, '') || ' (' || {counted(PERSONS, 'Person')} || ')'",
    f"CASE WHEN (o_orderkey + i) % 5 = 0 THEN 0 ELSE {PERSONS} * {PRICE} END",
    RATE,
    elements(0, active="o_orderkey % 17 <> 0 AND o_custkey % 9 <> 0"),
)
LINES = {
    "pkg": " UNION ALL ".join(
        (
            tickets(0, FIRST_FLIGHT),
            lines(STAY, f"{ROOMS} * {NIGHTS} * 55", RATE, elements(0)),
            PKG_VISA,
            labelled("Transport", "text route description", RATE, elements(0)),
            labelled("Ziyarat", "text route description", f"CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE {RATE} END", elements(0, "1 + o_custkey % 2")),
        )
    ),
    "hot": lines(STAY, f"{ROOMS} * {NIGHTS} * 55", RATE, elements(1)),
    "visa": priced("Visa", 2),
    "card": priced("Card", 3),
    "grp": priced("Groups", 4),
    "tic": tickets(5, ALL_FLIGHTS),
    "trn": labelled("Transport", "description text route", RATE, elements(6)),
    "ziy": labelled("Ziyarat", "description text route", RATE, elements(7)),
}
PKR = "CAST(sale_sar * sale_rate AS DECIMAL(20,2)) AS sale_pkr"
BASE = "split_part(item, ' - ', 1)"


def stays(active: str, deleted: bool) -> str:
    late = "CASE WHEN i <= o_orderkey % 3 THEN CAST(CAST(o_orderdate AS DATE) + CAST(i + 2 AS INT) AS VARCHAR) END"
    if deleted:
        late = f"COALESCE({late}, '')"
    return f"""
SELECT {REF} AS ref_no, CAST(i AS INT) AS stay_no, 'Hotel ' || ((o_custkey + i) % 9) AS hotel, 'Makkah' AS location, CAST(CAST(o_orderdate AS DATE) + CAST(i AS INT) AS VARCHAR) AS "checkIn", {late} AS "checkOut",
 CAST({NIGHTS} AS VARCHAR) AS nights, CAST({ROOMS} AS VARCHAR) AS rooms, {STAY_KIND} AS type, '55' AS rate, CAST({ROOMS} * {NIGHTS} * 55 AS VARCHAR) AS total FROM {elements(1, active=active)}"""


def totals(module: int) -> str:
    sar = f"sum(CASE WHEN (o_orderkey + i) % 5 < 2 THEN 0 ELSE {PERSONS} * {PRICE} END)"
    return f"""SELECT {REF} AS ref_no, CAST(sum({PERSONS}) AS BIGINT) AS persons, CAST({sar} AS DECIMAL(20,2)) AS total_sar, CAST({sar} * any_value({RATE}) AS DECIMAL(20,2)) AS total_pkr
FROM {elements(module, active="true")} GROUP BY o_orderkey"""


SQL = {
    "export_reopened": f"SELECT *, {PKR} FROM ({' UNION ALL '.join(LINES.values())}) l",
    **{f"purchase_lines_{m}": f"SELECT *, {PKR} FROM ({text}) l" for m, text in LINES.items()},
    "purchase_worksheet": f"""
WITH l AS (SELECT *, {PKR} FROM ({" UNION ALL ".join(LINES.values())}) u),
 c AS (SELECT * FROM (SELECT ref_no, item, purchase_sar AS sar, purchase_rate AS rate, supplier_code AS code, supplier_name AS name,
  row_number() OVER (PARTITION BY ref_no, item ORDER BY purchase_sar NULLS FIRST, purchase_rate NULLS FIRST, supplier_code NULLS FIRST, supplier_name NULLS FIRST) AS n FROM fx_purchases WHERE NOT is_deleted) p WHERE n = 1),
 m AS (SELECT l.*, CASE WHEN f.item IS NOT NULL THEN f.sar ELSE b.sar END AS psar, CASE WHEN f.item IS NOT NULL THEN f.rate ELSE b.rate END AS prate,
  CASE WHEN f.item IS NOT NULL THEN f.code ELSE b.code END AS code, CASE WHEN f.item IS NOT NULL THEN f.name ELSE b.name END AS name
  FROM l LEFT JOIN c f ON f.ref_no = l.ref_no AND f.item = l.item LEFT JOIN c b ON b.ref_no = l.ref_no AND b.item = {BASE.replace('item', 'l.item')})
SELECT ref_no, item, sale_sar, sale_rate, sale_pkr, CAST(CASE WHEN psar <> 0 AND prate <> 0 THEN psar END AS DECIMAL(18,2)) AS purchase_sar, CAST(CASE WHEN psar <> 0 AND prate <> 0 THEN prate END AS DECIMAL(18,2)) AS purchase_rate,
 CAST(CASE WHEN psar IS NULL THEN NULL WHEN psar = 0 OR prate = 0 THEN 0 ELSE psar * prate END AS DECIMAL(20,2)) AS purchase_pkr,
 CAST(CASE WHEN psar IS NULL THEN NULL WHEN psar = 0 OR prate = 0 THEN 0 ELSE sale_pkr - psar * prate END AS DECIMAL(20,2)) AS profit,
 COALESCE(code, '') AS supplier_code, COALESCE(name, '') AS supplier_name FROM m""",
    "hotel_stays": stays("o_orderkey % 17 <> 0", False),
    "hotel_stays_deleted": stays("o_orderkey % 17 = 0", True),
    "hotel_voucher": f"""
SELECT {REF} AS ref_no, c_name AS customer_name, CAST(o_orderdate AS DATE) AS booking_date, CAST(i AS INT) AS stay_no, 'Hotel ' || ((o_custkey + i) % 9) AS hotel, {STAY_KIND} AS type, CAST({ROOMS} AS VARCHAR) AS rooms,
 CAST({NIGHTS} AS VARCHAR) AS nights, CAST({ROOMS} * {NIGHTS} * 55 AS VARCHAR) AS total FROM {elements(0, active="true")} JOIN customer ON c_custkey = o_custkey""",
    "rows_totals": " UNION ALL ".join(totals(m) for m in (2, 3, 4)),
}

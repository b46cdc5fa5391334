"""Purchase lines: nested sales exploded to one priced line per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.books import Books
from tallybook.functions.coerce import MONEY, join_texts, number, or_text, or_zero
from tallybook.plans.sales import active

# numbers are read as text: a form may have stored either
PRICED = "array<struct<type:string,persons:string,rate:string,total:string>>"
LABELLED = "array<struct<description:string,text:string,route:string,amount:string,sar:string>>"
STAY = "array<struct<hotel:string,type:string,rooms:string,nights:string,total:string>>"
FLIGHT = "array<struct<airline:string,airline_name:string,`from`:string,flight_from:string,`to`:string,flight_to:string>>"
TEXTS = "array<string>"
# one shape for the elements of every kind in a package
ELEMENTS = "array<struct<kind:string,no:int,label:string,type:string,a:string,b:string,total:string>>"

STAY_COLUMNS = {
    "hotel": "hotel_name",
    "location": "hotel_location",
    "checkIn": "hotel_checkin",
    "checkOut": "hotel_checkout",
    "nights": "hotel_nights",
    "rooms": "hotel_rooms",
    "type": "hotel_type",
    "rate": "hotel_rate",
    "total": "hotel_total",
}


def listed(column: str, schema: str) -> Column:
    """The elements of a JSON list; NULL for anything else, such as an empty object."""
    return F.when(F.ltrim(column).startswith("["), F.from_json(column, schema))


def _count_of(n: Column, unit: str) -> Column:
    """``1 Person``, ``2 Persons``, ``0 Person``."""
    return F.concat(_plain(n), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""))


def _plain(n: Column) -> Column:
    """A number as text without a trailing fraction of zeros."""
    return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(
        F.regexp_replace(n.cast("string"), "0+$", "")
    )


def _line(ref: str, item: Column, sar: Column, rate: Column) -> list[Column]:
    return [F.col(ref), item.alias("item"), sar.cast(MONEY).alias("sale_sar"), or_zero(rate).cast(MONEY).alias("sale_rate")]


def _exploded(rows: DataFrame, column: str, schema: str, *keep: str) -> DataFrame:
    """One row per element with its position from 1; no array, no rows."""
    return rows.select("ref_no", *keep, F.posexplode(listed(column, schema)).alias("_pos", "e")).withColumn(
        "n", (F.col("_pos") + 1).cast("string")
    )


def _stay_item(n: Column, hotel: Column, kind: Column, rooms: Column, nights: Column) -> Column:
    kind = F.upper(F.coalesce(kind, F.lit("")))
    return F.concat(
        F.lit("Hotel "),
        n,
        F.lit(" - "),
        hotel,
        F.lit(" ("),
        kind,
        F.when(kind != "", ", ").otherwise(""),
        _count_of(rooms, "Room"),
        F.lit(", "),
        _count_of(nights, "Night"),
        F.lit(")"),
    )


def _ticket_lines(rows: DataFrame, suffix: str, info: Column, rate: str) -> DataFrame:
    """Up to three lines, one per traveller class with a count above 0."""
    classes = [
        F.struct(
            F.lit(label).alias("label"),
            F.col(f"{c}_{suffix}").cast(MONEY).alias("count"),
            F.col(f"{c}_rate").cast(MONEY).alias("price"),
        )
        for c, label in (("adult", "Adult"), ("child", "Child"), ("infant", "Infant"))
    ]
    lines = rows.select("ref_no", info.alias("info"), F.col(rate).alias("rate"), F.inline(F.array(*classes))).where(
        "count > 0"
    )
    item = _ticket_item(F.col("label"), F.col("count"), F.col("info"))
    return lines.select(*_line("ref_no", item, F.col("count") * F.col("price"), F.col("rate")))


def _ticket_item(traveller: Column, count: Column, info: Column) -> Column:
    return F.concat(
        F.lit("Ticket – "),
        traveller,
        F.lit(" ("),
        _count_of(count, "Person"),
        F.lit(")"),
        F.when(info != "", F.concat(F.lit(" - "), info)).otherwise(""),
    )


def _flight_info(airline: Column, start: Column, end: Column) -> Column:
    route = F.when((start != "") & (end != ""), F.concat(start, F.lit(" → "), end)).otherwise("")
    return join_texts(" | ", airline, route)


def _labelled_lines(rows: DataFrame, column: str, name: str, order: tuple[str, ...], value: str, rate: str) -> DataFrame:
    exploded = _exploded(rows, column, LABELLED, rate)
    label = F.coalesce(*[F.nullif(F.col(f"e.{o}"), F.lit("")) for o in order])
    base = F.concat(F.lit(f"{name} "), F.col("n"))
    item = F.when(label.isNotNull(), F.concat(base, F.lit(" - "), label)).otherwise(base)
    return exploded.select(*_line("ref_no", item, number(f"e.{value}"), F.col(rate)))


def _priced_lines(rows: DataFrame, name: str) -> DataFrame:
    """Visa, card and group sales: a line without a type carries no index."""
    exploded = _exploded(rows, "rows", PRICED, "pkr_rate")
    persons = number("e.persons")
    count = F.concat(F.lit(" ("), _count_of(persons, "Person"), F.lit(")"))
    kind = F.nullif(F.col("e.type"), F.lit(""))
    item = F.when(
        kind.isNotNull(), F.concat(F.lit(f"{name} "), F.col("n"), F.lit(" - "), kind, count)
    ).otherwise(F.concat(F.lit(name), count))
    sar = F.coalesce(F.nullif(number("e.total"), F.lit(0).cast(MONEY)), persons * number("e.rate"))
    return exploded.select(*_line("ref_no", item, sar, F.col("pkr_rate")))


def lines_pkg(books: Books) -> DataFrame:
    """All five kinds of package lines from one read and one explode.

    The elements of every kind are first brought to one shape; the item text
    is built after the explode, by kind.
    """
    rows = active(books.bookings).withColumn("first", F.get(listed("flights", FLIGHT), F.lit(0)))

    def either(a: str, b: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"first.{a}"), F.lit("")), F.col(f"first.{b}"), F.lit(""))

    # the flight text belongs to the sale, so it is made before the lines multiply it
    info = _flight_info(
        either("airline", "airline_name"), either("from", "flight_from"), either("to", "flight_to")
    )
    rows = rows.withColumn("info", info)

    def element(kind: str, i: Column | None, label=None, type_=None, a=None, b=None, total=None) -> Column:
        texts = {"label": label, "type": type_, "a": a, "b": b, "total": total}
        return F.struct(
            F.lit(kind).alias("kind"),
            (F.lit(0) if i is None else i + 1).alias("no"),
            *[(F.lit(None) if v is None else v).cast("string").alias(k) for k, v in texts.items()],
        )

    def elements(column: str, schema: str, shape) -> Column:
        shaped = F.transform(listed(column, schema), shape)
        return F.coalesce(shaped, F.array().cast(ELEMENTS))

    def label(x: Column) -> Column:
        return F.coalesce(*[F.nullif(x[o], F.lit("")) for o in ("text", "route", "description")])

    travellers = F.array(
        *[
            element("ticket", None, label=F.lit(name), a=F.col(f"{c}_count"), b=F.col(f"{c}_rate"))
            for c, name in (("adult", "Adult"), ("child", "Child"), ("infant", "Infant"))
        ]
    )
    together = F.concat(
        travellers,
        elements("hotels", STAY, lambda x, i: element("hotel", i, x["hotel"], x["type"], x["rooms"], x["nights"], x["total"])),
        elements("visa", PRICED, lambda x, i: element("visa", i, None, x["type"], x["persons"], x["rate"], x["total"])),
        elements("transport", LABELLED, lambda x, i: element("transport", i, label(x), total=x["amount"])),
        elements("ziyarat", LABELLED, lambda x, i: element("ziyarat", i, label(x), total=x["amount"])),
    )
    exploded = rows.select(
        "ref_no",
        "info",
        *[f"{k}_sar_rate" for k in ("flight", "hotel", "visa", "transport", "ziyarat")],
        F.inline(together),
    )
    # numbers are read once, ahead of the texts that repeat them
    exploded = exploded.withColumns(
        {"a": number("a"), "b": number("b"), "priced": F.col("total").isNull(), "total": number("total")}
    ).where("kind <> 'ticket' or a > 0")

    kind, n = F.col("kind"), F.col("no").cast("string")
    a, b, total = F.col("a"), F.col("b"), F.col("total")
    of_type = F.nullif(F.col("type"), F.lit(""))
    visa = F.concat(
        F.lit("Visa "),
        n,
        F.when(of_type.isNotNull(), F.concat(F.lit(" - "), of_type)).otherwise(""),
        F.lit(" ("),
        _count_of(a, "Person"),
        F.lit(")"),
    )
    named = F.concat(
        F.initcap(kind),
        F.lit(" "),
        n,
        F.when(F.col("label").isNotNull(), F.concat(F.lit(" - "), F.col("label"))).otherwise(""),
    )
    item = (
        F.when(kind == "ticket", _ticket_item(F.col("label"), a, F.col("info")))
        .when(kind == "hotel", _stay_item(n, F.coalesce("label", F.lit("")), F.col("type"), a, b))
        .when(kind == "visa", visa)
        .otherwise(named)
    )
    # a visa total of 0 stands here; only a missing one is priced
    priced_here = (kind == "ticket") | ((kind == "visa") & F.col("priced"))
    rate = F.when(kind == "ticket", F.col("flight_sar_rate"))
    for k in ("hotel", "visa", "transport", "ziyarat"):
        rate = rate.when(kind == k, F.col(f"{k}_sar_rate"))
    return exploded.select(*_line("ref_no", item, F.when(priced_here, a * b).otherwise(total), rate))


def lines_hot(books: Books) -> DataFrame:
    """The hotel name array sets the number of lines; other arrays may be shorter."""
    rows = active(books.hotels).select(
        "ref_no",
        "sar_rate",
        *[listed(c, TEXTS).alias(c) for c in ("hotel_name", "hotel_type", "hotel_rooms", "hotel_nights", "hotel_total")],
    )
    zipped = F.transform(
        "hotel_name",
        lambda name, i: F.struct(
            name.alias("hotel"),
            *[F.get(f"hotel_{f}", i).alias(f) for f in ("type", "rooms", "nights", "total")],
        ),
    )
    exploded = rows.select("ref_no", "sar_rate", F.posexplode(zipped).alias("_pos", "e")).withColumn(
        "n", (F.col("_pos") + 1).cast("string")
    )
    item = _stay_item(
        F.col("n"), F.coalesce("e.hotel", F.lit("null")), F.col("e.type"), number("e.rooms"), number("e.nights")
    )
    return exploded.select(*_line("ref_no", item, number("e.total"), F.col("sar_rate")))


def lines_visa(books: Books) -> DataFrame:
    return _priced_lines(active(books.visa), "Visa")


def lines_card(books: Books) -> DataFrame:
    return _priced_lines(active(books.card), "Card")


def lines_grp(books: Books) -> DataFrame:
    return _priced_lines(active(books.groups), "Groups")


def lines_tic(books: Books) -> DataFrame:
    def joined(column: str) -> Column:
        # a NULL element prints as an empty text between its separators
        texts = F.transform(listed(column, TEXTS), lambda x: F.coalesce(x, F.lit("")))
        start = F.ltrim(column)
        # what is no list prints as it is, a JSON text without its quotes
        quoted = F.when(start.startswith('"'), F.get_json_object(column, "$"))
        plain = F.when(~start.startswith("{") & (start != "null"), F.coalesce(quoted, F.col(column)))
        return F.coalesce(F.when(start.startswith("["), F.array_join(texts, ", ")).otherwise(plain), F.lit(""))

    info = _flight_info(joined("airline"), joined("flight_from"), joined("flight_to"))
    return _ticket_lines(active(books.ticketing), "qty", info, "pkr_rate")


def lines_trn(books: Books) -> DataFrame:
    return _labelled_lines(
        active(books.transport), "rows", "Transport", ("description", "text", "route"), "sar", "pkr_rate"
    )


def lines_ziy(books: Books) -> DataFrame:
    return _labelled_lines(
        active(books.ziyarat), "rows", "Ziyarat", ("description", "text", "route"), "sar", "pkr_rate"
    )


LINES = {
    "pkg": lines_pkg,
    "hot": lines_hot,
    "visa": lines_visa,
    "card": lines_card,
    "grp": lines_grp,
    "tic": lines_tic,
    "trn": lines_trn,
    "ziy": lines_ziy,
}


def priced(lines: DataFrame) -> DataFrame:
    return lines.withColumn("sale_pkr", (F.col("sale_sar") * F.col("sale_rate")).cast("decimal(20,2)"))


def purchase_lines(books: Books, module: str) -> DataFrame:
    return priced(LINES[module](books))


def all_lines(books: Books) -> DataFrame:
    return priced(reduce(DataFrame.unionByName, [f(books) for f in LINES.values()]))


def purchase_worksheet(books: Books, lines: DataFrame | None = None) -> DataFrame:
    """Lines with the purchase of the same item, or of its part before `` - ``.

    A line whose purchase has no amount or no rate costs 0 and earns 0; one
    with no purchase at all has unknown (NULL) cost and profit.
    """
    lines = all_lines(books) if lines is None else lines
    base = F.split_part("item", F.lit(" - "), F.lit(1))
    # the purchases of one base item of a sale are few, whatever the sale has
    found = F.struct("purchase_sar", "purchase_rate", "supplier_code", "supplier_name")
    bought = active(books.purchases).groupBy("ref_no", base.alias("base")).agg(F.collect_list(F.struct("item", found.alias("x"))).alias("bought"))

    def of(item: str) -> Column:
        """The least purchase of this very item."""
        return F.array_min(F.transform(F.filter("bought", lambda p: p["item"] == F.col(item)), lambda p: p["x"]))

    looked_up = lines.withColumn("base", base).join(bought, ["ref_no", "base"], "left").withColumn("x", F.coalesce(of("item"), of("base")))
    sar, rate = F.col("x.purchase_sar"), F.col("x.purchase_rate")
    cleared = (or_zero(sar) == 0) | (or_zero(rate) == 0)
    unknown = F.col("x").isNull()
    zero = F.lit(0).cast("decimal(20,2)")
    cost = (sar * rate).cast("decimal(20,2)")

    def when_costed(value: Column, if_cleared: Column | None) -> Column:
        return F.when(unknown, F.lit(None)).when(cleared, if_cleared).otherwise(value)

    none = F.lit(None)
    return looked_up.select(
        "ref_no",
        "item",
        "sale_sar",
        "sale_rate",
        "sale_pkr",
        when_costed(sar, none).cast(MONEY).alias("purchase_sar"),
        when_costed(rate, none).cast(MONEY).alias("purchase_rate"),
        when_costed(cost, zero).cast("decimal(20,2)").alias("purchase_pkr"),
        when_costed(F.col("sale_pkr") - cost, zero).cast("decimal(20,2)").alias("profit"),
        or_text("x.supplier_code", "").alias("supplier_code"),
        or_text("x.supplier_name", "").alias("supplier_name"),
    )


# views of nested rows


def hotel_stays(books: Books, deleted: bool = False) -> DataFrame:
    """One row per stay of a hotel sale; in the deleted view blanks read as '' and 0."""
    rows = books.hotels.where(F.col("is_deleted") == deleted)
    arrays = {c: listed(c, TEXTS) for c in STAY_COLUMNS.values()}
    parsed = rows.select("ref_no", *[a.alias(c) for c, a in arrays.items()])
    counted = ("nights", "rooms", "rate", "total")

    def field(name: str, column: str, i: Column) -> Column:
        value = F.get(column, i)
        if deleted:
            value = or_text(value, "0" if name in counted else "")
        return value.alias(name)

    stays = F.transform("hotel_name", lambda _, i: F.struct(*[field(n, c, i) for n, c in STAY_COLUMNS.items()]))
    return parsed.select("ref_no", F.posexplode(stays).alias("_pos", "s")).select(
        "ref_no", (F.col("_pos") + 1).alias("stay_no"), "s.*"
    )


def hotel_voucher(books: Books) -> DataFrame:
    """Hotel stays of package bookings, deleted ones included."""
    return _exploded(books.bookings, "hotels", STAY, "customer_name", "booking_date").select(
        "ref_no",
        "customer_name",
        "booking_date",
        (F.col("_pos") + 1).alias("stay_no"),
        "e.hotel",
        "e.type",
        "e.rooms",
        "e.nights",
        "e.total",
    )


def with_totals(rows: DataFrame) -> DataFrame:
    """Persons, SAR and PKR of a sale from its own lines, without exploding them."""
    parsed = listed("rows", PRICED)
    start = F.lit(0).cast("decimal(28,2)")

    def summed(field: str) -> Column:
        add = lambda acc, x: (acc + number(x[field])).cast("decimal(28,2)")
        return F.coalesce(F.aggregate(parsed, start, add), start)

    sar = summed("total").cast("decimal(20,2)")
    return rows.withColumns({"persons": summed("persons").cast("bigint"), "total_sar": sar}).withColumn(
        "total_pkr",
        (F.col("total_sar").cast(MONEY) * number(F.col("pkr_rate").cast("string"))).cast("decimal(20,2)"),
    )


def rows_totals(rows: DataFrame) -> DataFrame:
    return with_totals(rows).select("ref_no", "persons", "total_sar", "total_pkr")

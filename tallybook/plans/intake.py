"""Checks and defaults for incoming payments, expenses and manual entries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.coerce import MONEY, half_up, is_blank, or_text
from tallybook.operators.keyed import first_per_key, upsert

# A request is all text: party (ref, code or title), amount, entry_date,
# payment_method, bank_profile_id, type, note.


def _amount() -> Column:
    return F.col("amount").try_cast(MONEY)


def _no_amount() -> Column:
    """Missing, unreadable or zero."""
    return F.coalesce(_amount(), F.lit(0)) == 0


def _not_positive() -> Column:
    return F.coalesce(_amount(), F.lit(0)) <= 0


@dataclass(frozen=True)
class Rules:
    """Checks in order with the reason each gives, and the defaults of accepted rows."""

    checks: tuple[tuple[Callable[[], Column], str], ...] = ()
    method: str | None = None  # None: as sent
    type: str | None = None
    note: str | None = None
    whole_amount: bool = False
    bank_if_method: bool = True  # keep the bank only for method 'Bank'
    known_party: bool = False


def _blank(name: str) -> Callable[[], Column]:
    return lambda: is_blank(name)


def _any(*tests: Callable[[], Column]) -> Callable[[], Column]:
    def test() -> Column:
        out = tests[0]()
        for t in tests[1:]:
            out = out | t()
        return out

    return test


# fixed values: kinds, reasons and defaults
INTAKE = {
    "customer": Rules(
        ((_blank("party"), "Ref No required"), (_not_positive, "Invalid amount"), (_blank("entry_date"), "Date required")),
        method="cash",
        type="payment",
    ),
    "registered": Rules(
        (
            (_blank("party"), "Customer Code is required"),
            (_not_positive, "Amount must be greater than zero"),
            (_blank("entry_date"), "Payment Date is required"),
        ),
        method="Cash",
        type="payment",
    ),
    "supplier": Rules(known_party=True),
    "purchase": Rules(
        ((_any(_blank("party"), _blank("entry_date"), _no_amount), "Amount & Date required"),),
        method="Cash",
        type="payment",
        whole_amount=True,
    ),
    "expense": Rules(
        (
            (
                _any(_blank("entry_date"), _blank("party"), _no_amount, _blank("payment_method")),
                "Missing required fields",
            ),
        ),
        note="",
    ),
    "cash": Rules(((_any(_blank("entry_date"), _no_amount, _blank("type")), "Missing fields"),), note=""),
    "bank": Rules(
        (
            (
                _any(_blank("entry_date"), _no_amount, _blank("type"), _blank("bank_profile_id")),
                "Date, Amount, Type, & Bank Profile required",
            ),
        ),
        note="",
        bank_if_method=False,
    ),
}
EDITS = {
    "customer": Rules(
        ((_not_positive, "Amount must be greater than zero"), (_blank("entry_date"), "Payment date is required")),
        method="Bank",
        type="payment",
    ),
    "registered": Rules(((_not_positive, "Amount must be greater than zero"),), method="Bank", type="payment"),
    "supplier": Rules(((_not_positive, "Invalid amount"),), method="Bank"),
    "expense": INTAKE["expense"],
    "cash": Rules(
        (
            (_any(_blank("entry_date"), _no_amount, _blank("type")), "Missing required fields"),
            (_not_positive, "Amount must be greater than zero"),
        ),
        note="",
    ),
    "bank": Rules(note="", bank_if_method=False),
}


def _by_kind(rules: dict[str, Rules], value: Callable[[Rules], Column | None], otherwise: Column) -> Column:
    out = F.lit(None)
    for kind, rule in rules.items():
        v = value(rule)
        out = F.when(F.col("kind") == kind, otherwise if v is None else v).otherwise(out)
    return out


def _reason(rule: Rules) -> Column | None:
    reasons = [F.when(test(), F.lit(text)) for test, text in rule.checks]
    if rule.known_party:
        reasons.append(F.when(F.col("_known").isNull(), F.lit("Supplier not found")))
    # the store takes numbers and dates only
    reasons.append(F.when(_amount().isNull(), F.lit("Invalid amount")))
    reasons.append(F.when(F.col("entry_date").isNotNull() & _day().isNull(), F.lit("Invalid date")))
    return F.coalesce(*reasons)


def _day() -> Column:
    return F.col("entry_date").try_cast("date")


def checked(requests: DataFrame, suppliers: DataFrame | None = None, rules: dict[str, Rules] | None = None) -> DataFrame:
    """The requests with typed, defaulted fields and a ``reason``; NULL reason means accepted."""
    rules = INTAKE if rules is None else rules
    if suppliers is not None:
        known = suppliers.select(F.col("supplier_code").alias("party"), F.lit(True).alias("_known")).distinct()
        requests = requests.join(known, "party", "left")
    elif "_known" not in requests.columns:
        requests = requests.withColumn("_known", F.lit(True))
    as_sent = lambda c: F.col(c)
    bank = F.col("bank_profile_id").try_cast("bigint")

    def default(name: str) -> Callable[[Rules], Column | None]:
        def value(rule: Rules) -> Column | None:
            text = getattr(rule, name)
            return None if text is None else or_text({"method": "payment_method"}.get(name, name), text)

        return value

    return requests.select(
        "request_id",
        "kind",
        "party",
        _by_kind(
            rules, lambda r: half_up(_amount()).cast(MONEY) if r.whole_amount else _amount(), F.lit(None)
        ).alias("amount"),
        _day().alias("entry_date"),
        _by_kind(rules, default("method"), as_sent("payment_method")).alias("payment_method"),
        _by_kind(
            rules,
            lambda r: F.when(F.col("payment_method") == "Bank", bank) if r.bank_if_method else bank,
            F.lit(None).cast("bigint"),
        ).alias("bank_profile_id"),
        _by_kind(rules, default("type"), as_sent("type")).alias("type"),
        _by_kind(rules, default("note"), as_sent("note")).alias("note"),
        _by_kind(rules, _reason, F.lit(None)).alias("reason"),
        *[c for c in ("edit_no",) if c in requests.columns],
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNull()).drop("reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNotNull()).select("request_id", "kind", "reason")


def apply_edits(
    current: DataFrame, edits: DataFrame, day: str, fields: tuple[str, ...], note: str | None = None
) -> DataFrame:
    """Accepted edits applied by id; an unknown id changes nothing.

    ``edits`` is ``checked`` output whose request_id is the edited id. If an id
    is edited twice in a batch, the later ``edit_no`` wins; without that column, one of the edits.
    """
    rows = accepted(edits)
    renames = {"request_id": "id", "entry_date": day, **({"note": note} if note else {}), "party": "title"}
    changes = rows.withColumnsRenamed({a: b for a, b in renames.items() if a in rows.columns})
    latest = [F.desc("edit_no")] if "edit_no" in changes.columns else []
    return upsert(current, changes, ["id"], update=list(fields), insert=False, order=latest)

"""DuckDB SQL for every query that SQL can express.

``fx_<name>`` is a ledger table derived from the test tables; the text of each
one used is put in front of the query as a CTE.
"""

from oracles import changes, ledgers, lists, nested, reports
from tallybook.sources.fixtures import with_prefix

TEXTS = {**lists.SQL, **ledgers.SQL, **reports.SQL, **nested.SQL, **changes.SQL}


def sql() -> dict[str, str]:
    return {name: with_prefix(text) for name, text in TEXTS.items()}

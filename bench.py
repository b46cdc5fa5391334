"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select
input and cores; BENCH_QUERIES may name queries separated by commas, or ``all``.
Each query runs once to warm up and then BENCH_RUNS times (default 1), into the
no-op sink so that every row is produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallybook.queries import QUERIES  # noqa: E402
from tallybook.session import local_session  # noqa: E402

HEADLINE = """
cash_ledger bank_ledger walkin_ledger registered_ledger supplier_ledger purchase_ledger
walkin_payment_status registered_pending supplier_pending purchase_payables_pending
bs_walkin bs_registered bs_suppliers bs_summary monthly_profit profit_year
sale_adjustments purchase_list missing_supplier deleted_report purchase_worksheet purchase_lines_pkg
opening_cash customer_outstanding supplier_outstanding snapshot_header purge_counts
purchase_upsert payment_status_rollup purchase_status_rollup ref_allocate sales_all
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    named = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if named == "all" else named.split(",") if named else HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt and (best is None or took < best):
                best = took
        timings[name] = round(best, 3)
        print(f"{name} {timings[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

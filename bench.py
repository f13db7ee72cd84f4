"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run once to warm up and then three times; the median wall time
of a full evaluation (``noop`` sink: every row computed, nothing collected)
is reported.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tapestry.plans import queries as Q  # noqa: E402
from tapestry.session import local_session  # noqa: E402

HEADLINE = [
    "profile",             # flagship: nested entity profile + DQ (B, D, E, I, J, L)
    "nest_list_salted",    # two-phase (salted) nesting
    "nest_many",           # many nested aggregates in one pass
    "lookup_chain",        # star join to code tables
    "attach_satellites",   # aggregate-then-join satellites
    "weekly_schedule",     # unpivot + nested collect
    "cross_apply_codes",   # nested higher-order functions
    "dq_flatten",          # rule evaluation
    "dedupe_first",        # keep-first per key
    "score_confidence",    # reconcile -> classify -> resolve -> score
    "classify_matches",    # native similarity on matched pairs
    "split_cells",         # whole-text cell split
    "extract_patterns",    # regex extraction over html
    "lineage_closure",     # doubling closure
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tapestry-bench")
    qs = Q.queries()
    times = {}
    for n in names:
        def run():
            t0 = time.perf_counter()
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        run()
        times[n] = round(statistics.median(run() for _ in range(3)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

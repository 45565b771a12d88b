"""Headline timings: one JSON line on stdout.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores. ``base``
entries are the derived tables the queries share (each is written once per session); every
other entry is one query run to completion over them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections import Counter

from foretally import catalog
from foretally.workspace import start_session

HEADLINE = (
    "contests_canonical",
    "row_quality",
    "unique_fixtures",
    "total_walkforward",
    "total_metrics",
    "team_walkforward",
    "team_metrics_by_venue",
    "prior_sensitivity",
    "paired_deltas",
    "iid_bootstrap",
    "iid_bootstrap_poisson",
    "decay_predictions",
    "decay_metrics",
    "block_bootstrap",
    "goal_forecasts",
    "goal_metrics",
    "window_metrics",
    "seasonal_metrics",
    "calibration_bins",
    "goal_block_bootstrap",
)
#: Shared base tables in the order they are built, with the ones that each is built from.
BASE = {
    "log": (),
    "fixtures": ("log",),
    "ledger": ("log",),
    "fixture_ledger": ("fixtures",),
    "goal_rates": ("fixtures", "fixture_ledger"),
    "rho": ("goal_rates",),
}


def watch_base_tables() -> set[str]:
    """The set that gathers the names of base tables as queries ask for them."""
    used: set[str] = set()
    plain = catalog.Derived.__getattribute__

    def asked(self, name):
        if name in BASE or name == "raw":
            used.add("log" if name == "raw" else name)
        return plain(self, name)

    catalog.Derived.__getattribute__ = asked
    return used


def with_sources(names: set[str]) -> set[str]:
    out = set(names)
    for name in names:
        out |= with_sources(set(BASE[name]))
    return out


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = start_session("bench", f"local[{cores}]", int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def clock(name: str, run) -> None:
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    # JVM and reader start-up is not query time
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    base = catalog.derived(spark, folder)
    for name in BASE:
        clock(f"base_{name}", lambda: getattr(base, name))
    queries, used, needs = catalog.queries(), watch_base_tables(), {}
    for name in names or HEADLINE:
        used.clear()
        clock(name, lambda: queries[name](spark, folder).write.format("noop").mode("overwrite").save())
        needs[name] = with_sources(used)
    readers = Counter(table for tables in needs.values() for table in tables)
    # a query's own seconds and its share of the tables it reads, each split among its readers
    shared = {q: round(seconds[q] + sum(seconds[f"base_{t}"] / readers[t] for t in sorted(tables)), 3) for q, tables in needs.items()}
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "with_base_share": shared, "sf": scale}))


if __name__ == "__main__":
    main(sys.argv[1:])

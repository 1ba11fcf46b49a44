"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

CPUS = os.environ.get("BENCH_CPUS", "8")
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from revlake.operators import compact, validate, visibility
    from revlake.operators.ranges import KeyRange
    from revlake.operators.txn import Condition, Operation, Transaction
    from revlake.plans.logs import events_log, orders_log, top_revision
    from revlake.plans.registry import QUERIES, _folder
    from revlake.session import reach
    from revlake.sources.store import Store

    reach(spark)
    events, orders = events_log(spark, SF_DIR), orders_log(spark, SF_DIR)
    keys = orders.select("key").distinct().orderBy("key").limit(1000).cache()
    half = top_revision(events) // 2
    rows = {"events": events.count(), "orders": orders.count()}
    frames = {
        "visible_scan_events": lambda: visibility.scan(events),
        "visible_scan_orders": lambda: visibility.scan(orders),
        "latest_row_number": lambda: visibility.latest_entries(orders),
        "latest_max_by": lambda: visibility.latest_by_aggregate(orders),
        "latest_semi_join": lambda: visibility.latest_by_join(orders),
        "multi_get_1000": lambda: visibility.multi_get(orders, keys),
        "range_scan_1000": lambda: visibility.scan(orders, KeyRange.between("cust/00001000", "cust/00002000")),
        "read_view_half": lambda: visibility.visible(events, half),
        "validate_classify": lambda: validate.classify(events, visibility.latest_entries(events, half)),
        "compact_latest": lambda: compact.retain(events, None, True),
        "compact_snapshot": lambda: compact.retain(events, half, True),
        "txn_fold": lambda: QUERIES["txn_value_equals"](spark, SF_DIR),
    }
    times = {}
    for name, make in frames.items():
        best = []
        for _ in range(1 + REPEATS):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        times[name] = round(min(best[1:]), 4)
    root = _folder(spark)

    def ask(store: Store) -> None:
        """1,000 keys of a store of several segments."""
        with store.read_view() as view:
            view.multi_get(keys).write.format("noop").mode("overwrite").save()

    with Store.open(spark, f"{root}/live") as store:
        for name, act in (
            ("batch_apply", lambda: store.apply(orders)),
            ("store_scan", lambda: store.scan().write.format("noop").mode("overwrite").save()),
            ("store_get", lambda: store.get("cust/00000042")),
            ("transact", lambda: store.transact(Transaction([Operation.put("bench/1", "x")], [Condition.missing("bench/1"), Condition.exists("bench/none")]))),
            ("put", lambda: store.put("bench/2", "x")),
            ("multi_get_segments", lambda: ask(store)),
            ("checkpoint", lambda: store.checkpoint(f"{root}/copy")),
            ("restore", lambda: store.restore(f"{root}/copy")),
            ("store_compact", store.compact),
        ):
            began = time.perf_counter()
            act()
            times[name] = round(time.perf_counter() - began, 4)
    rate = {k: round(rows["events" if k in ("visible_scan_events", "read_view_half", "validate_classify", "compact_latest", "compact_snapshot") else "orders"] / v) for k, v in times.items()}
    print(json.dumps({"metric": "key-value queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "log_rows_per_sec": rate, "sf": SF_DIR.rstrip("/").split("sf")[-1], "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()

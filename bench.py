"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "flow_counters", "flow_features", "destination_series", "trailing_destination_totals", "trailing_distinct_sources",
    "dns_pairing", "tls_fingerprints", "confusion_matrix", "curve_areas", "threshold_sweep", "stage_latency", "document_entropy",
)
#: Timed as well, but not part of the sum, which stays comparable between rounds.
MORE = ("flow_windows", "dns_signals", "investigations")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from quietwire.plans import bindings, catalogue
    from quietwire.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # one run on the smallest sample beside the folder, so that JVM start-up is not measured
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    warm = small if os.path.isdir(small) else folder
    for name in ("flow_features", "trailing_distinct_sources", "curve_areas"):
        catalogue.PLANS[name](spark, warm).write.format("noop").mode("overwrite").save()
    packets = bindings.packets(spark, folder).count()
    times: dict[str, float] = {}
    for name in HEADLINE + MORE:
        bindings._STORED.clear()  # every query pays for all of its own inputs
        start = time.perf_counter()
        catalogue.PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "sum of headline query times", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "packets": packets,
        "packets_per_sec": {n: round(packets / times[n], 1) for n in ("flow_counters", "flow_features")}}))


if __name__ == "__main__":
    sys.exit(main())

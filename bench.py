"""Times headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowmine.queries import registry  # noqa: E402
from flowmine.session import build_session  # noqa: E402

HEADLINE = [
    "session_timeout", "session_cap_block", "session_table", "time_blocked_split", "split_distribution",
    "exact_dedup", "timestamp_repair", "numeric_repair", "median_imputer", "stratified_sample", "session_windows",
    "event_sequences", "frequent_itemsets", "transition_graph", "session_edges", "rank_mean_median",
    "rank_information_binned", "vote_fusion", "random_oversample", "classification_scores", "ranking_areas",
    "fused_risk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.log.level": "ERROR"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["session_key_host_pair"](spark, sf_dir).count()   # start the engine
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

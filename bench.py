"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
`index` extracts and stores all entity tables of the corpus once; the code queries read that
index. The others run once to warm up, then the median of three counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codelake.plans import registered  # noqa: E402
from codelake.session import build_session  # noqa: E402

HEADLINE = ["v1_latest_by_key", "v3_version_history", "i4_diff_files", "d1_index_documents",
            "d5_search_documents", "c1_find_symbols", "c7_index_stats", "g1_page_fan_in",
            "g2_resolve_imports", "g3_resolve_references", "g4_assign_scope", "s2_session_rollup"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus})
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    begin = time.time()
    registered.index(spark, sf)
    times["index"] = round(time.time() - begin, 3)
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            begin = time.time()
            df = registered.QUERIES[name](spark, sf)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.time() - begin)
        times[name] = round(statistics.median(runs[1:]), 3)
        rows[name] = df.count()
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "rows": rows,
                      "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()

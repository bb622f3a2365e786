"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import time

from ledgerloom.plans import catalog
from ledgerloom.session import build_session

HEADLINE = [
    "c03_table_match_prior_value", "c04_table_match_fingerprint", "c12_rows_similar_label", "i03_longest_contained", "i12_glossary_by_signature",
    "v01_check_cells", "j07_replace_once", "e22_statement_compare", "t03_throttled_states",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{path}/nation.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = re.search(r"sf([0-9.]+)", path)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()

"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores. Every
query runs to the last row and column into a no-op sink: one warm-up, then
one timed run.
"""

from __future__ import annotations

import json
import os
import time

from wovengraph.plans import catalog
from wovengraph.session import build_session

HEADLINE = [
    "pattern_date_overlap_page",
    "p02_basic_graph_pattern",
    "p04_sub_property",
    "p19_construct",
    "p20_subselect_limit",
    "j03_nested_optional",
    "j07_theta_dates",
    "j07_period_overlap",
    "a02_group_concat",
    "f06_date_overlap",
    "f12_list_subtree",
    "f19_all_criteria",
    "o03_third_page",
    "x02_all_terms",
    "x02_all_terms_index",
    "x09_grouped_hits",
    "h03_codes_for_requests",
    "h08_least_code",
    "h09_fully_visible",
    "g11_neighbourhood_edges",
    "g13_incoming_references",
    "g17_chain_heads",
    "r_infer_all",
    "v09_several_live",
    "v12_ingest_problems",
    "e02_new_versions",
    "e06_reference_counts",
    "c01_parse_period",
    "m01_xml_ranges",
    "m05_text_diffs",
    "n03_string_forms",
    "s07_subject_view",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(runs[-1], 3)
    total = round(sum(times.values()), 3)
    scale = path.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": scale, "cpus": int(cpus), "n": len(times)}))


if __name__ == "__main__":
    main()

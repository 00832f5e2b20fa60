"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shoalmark.catalog import QUERIES  # noqa: E402
from shoalmark.session import local_session  # noqa: E402

HEADLINE = [
    "cwm", "cwm_by_area", "cwm_by_tow", "cwm_crosscheck", "point_in_polygon", "polygon_overlap_join",
    "bottom_temp_by_area", "area_model_table", "trait_gap_fill", "rank_fallback_join", "species_list",
    "fishbase_stock_traits", "posterior_median_qi", "five_number_summary", "autocorrelation", "complete_grid",
    "pivot_wider_fill0", "ols_interaction", "gls_ar1", "lmm_random_effects", "cell_random_effect_field",
    "predict_on_grid", "trait_pca", "sort_multi", "standardize", "pairwise_correlation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["cwm"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    times = {}
    for name in only:
        best = None
        for _ in range(2):  # the first run pays for code generation
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t0
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opinara.session import local_session  # noqa: E402
from opinara.workload import QUERIES  # noqa: E402

HEADLINE = [
    "a1_w3_item_endorsement_table", "s1_s2_s5_export_scan", "p10_recode_dictionary", "p16_dense_index", "p17_z_score",
    "f5_keep_unique", "f6_w4_first_submission", "f9_f10_exclusions", "j1_attach_dimension", "r2_to_long_one_group",
    "a4_count_wide", "a5_prop_wide", "a9_median_interval_large_groups", "a15_correlation_matrix", "a18_describe",
    "a19_cohens_d", "a20_prob_superiority", "t2_top_n_ties", "w1_draw_z", "w5_index_within", "m1_response_probability",
    "m3_effect_z", "m4_a7_predicted_counts", "m5_covariate_sweep", "m6_curve_by_cause", "m7_simple_slopes",
    "m8_standardised_coefficients", "m10_ordinal_predictions", "m11_a13_planned_contrasts", "m14_item_information_curve",
    "m15_integrated_information", "m16_scale_curves", "m18_factor_scores", "m20_calibrate_2pl", "m21_calibrate_graded",
    "m22_person_scores", "m23_precision_by_run",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    only = sys.argv[1:]
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in HEADLINE:
        if only and not any(o in name for o in only):
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

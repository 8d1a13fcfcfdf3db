"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402
from checks.vectors import full_spectra  # noqa: E402
from spectraloom.session import local_session  # noqa: E402

HEADLINE = (
    "luminosity_from_line_flux",
    "quality_flag_counts",
    "type1_candidates",
    "type2_candidates",
    "best_row_per_object",
    "attached_metadata",
    "preprocessed_spectra",
    "preprocessed_spectra_full_grid",
    "preprocessing_run",
    "mad_normalized",
    "pair_diagnosis",
    "pair_diagnosis_all_fields",
    "real_pairs_vectors",
    "merged_in_place",
    "best_vector_per_object_in_buckets",
    "clean_spectra",
    "class_profiles",
    "stratified_split_sizes",
    "nearest_partner_other_class",
    "nearest_20_partners_same_class",
    "sampled_training_pairs",
    "threshold_sweep",
    "rank_metrics",
    "classification_report",
    "evaluated_pairs",
    "change_detector_threshold",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=8)
    # start executors and Python workers before anything is timed
    QUERIES["edge_taper"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["median_and_mad"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rows = full_spectra(spark, sf_dir).count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                # raw spectra to vectors of 1,024 pixels
                "spectra_per_second": round(rows / times["preprocessed_spectra_full_grid"], 1),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

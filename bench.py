"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from duoframe import local_session
from duoframe.queries import QUERIES

# one query per family: ratio statistics, histograms, masks, filters, warps, registration, reports
HEADLINE = [
    "pair_pixels", "percentile_linear", "uniform_histogram", "match_histograms", "rgb_overlay",
    "dilate_cross", "connected_components", "fill_holes", "gaussian_blur", "box_mean", "area_downsample",
    "warp_bilinear", "ratio_histogram", "moffat_scale", "scale_set", "difference", "least_squares_scale",
    "histogram_mode_scale", "signal_only_scale", "density_grid", "excess_grid", "difference_histogram",
    "nearest_neighbours", "affine_from_matches", "descriptor_matches", "classify_files", "resolve_request",
    "build_suffix", "plan_stages", "output_size", "robust_homography", "boundary_ring", "coarse_search",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in [n for n in HEADLINE if n in QUERIES]:
        t0 = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(folder).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

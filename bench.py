"""Seconds per headline query, one JSON line.

Each query runs twice in one warm session and the faster run counts. The
result is computed in full and thrown away (``noop`` sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scalefold import build_session
from scalefold.plans.catalogue import QUERIES

HEADLINE = [
    "mfdfa_df",
    "mfdfa_linear_detrend",
    "quantile_trim",
    "downsample_uniform",
    "smooth_quad11",
    "wavelet_denoise",
    "bandpass",
    "welch_psd",
    "hex_bits",
    "subset_samples",
    "subset_mfdfa",
    "subset_mfdfa_grids",
    "dataset_summary",
    "tci",
    "mci",
    "tmci_folds",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        app="bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(f"{name} {runs}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

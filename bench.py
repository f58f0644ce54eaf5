"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from check import session
from eigenloom import (
    exact_pca,
    kth_singular_value,
    project_rows,
    read_matrix,
    residual_spectral_norm,
    sketch_pca,
    write_matrix_rows,
)
from eigenloom.session import scratch_path
from eigenloom.workload import fixtures as fx
from eigenloom.workload.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
K, OVERSAMPLE, PASSES = 10, 10, 2

# Queries timed as they stand, down to a full evaluation of their result.
WHOLE = (
    "coo_text_ingest sparse_rows column_means project_rows_join project_rows_salted cross_product "
    "mean_correction gram tsqr_r total_variation gaussian_seed fit_until_tolerance"
).split()


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session(CPUS)
    times: dict[str, float] = {}

    def timed(name, job):
        began = time.perf_counter()
        result = job()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name:32} {times[name]:8.3f}s", file=sys.stderr, flush=True)
        return result

    run(QUERIES["project_rows"](spark, SF_DIR))  # start the Python workers before the clock
    items = fx.lineitem5(spark, SF_DIR)
    n_rows, n_cols = fx.order_part_dims(spark, SF_DIR)
    dims = {"n_rows": n_rows, "n_cols": n_cols}
    path = scratch_path(spark, "order_part")
    timed("order_part_rows", lambda: write_matrix_rows(fx.order_part(spark, SF_DIR), path))
    sparse = read_matrix(spark, path)

    keep, passes = {"cache": True, "partitions": CPUS}, {}
    sketch_pca(items, 2, oversample=1, max_iter=1, **keep)  # the first fit pays for compiling
    for method in ("fused", "two_pass", "tsqr"):
        options = {"oversample": OVERSAMPLE, "max_iter": PASSES, "method": method, **keep}
        fit = timed(f"order_part_{method}", lambda: sketch_pca(sparse, K, **options, **dims))
        passes[f"order_part_{method}"] = round(statistics.mean(fit.pass_seconds), 3)
        options["oversample"] = 1
        fit = timed(f"lineitem5_{method}", lambda: sketch_pca(items, 2, **options))
        passes[f"lineitem5_{method}"] = round(statistics.mean(fit.pass_seconds), 3)
    options = {"oversample": OVERSAMPLE, "max_iter": PASSES, "limit": 0}
    fit = timed("order_part_tables", lambda: sketch_pca(sparse, K, **options, **dims))
    passes["order_part_tables"] = round(statistics.mean(fit.pass_seconds), 3)
    fit = sketch_pca(items, 2, oversample=1, max_iter=PASSES, **keep)
    timed("lineitem5_exact", lambda: exact_pca(items, 2))
    timed("lineitem5_singular_value", lambda: kth_singular_value(items, 3, **keep))
    timed("lineitem5_residual", lambda: residual_spectral_norm(items, fit.components, 2, **keep))
    for name in WHOLE:
        timed(name, lambda: run(QUERIES[name](spark, SF_DIR)))
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sec_per_pass": passes,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()

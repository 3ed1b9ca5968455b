"""Times headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the data and the cores."""

from __future__ import annotations

import json
import os
import statistics
import time

QUERIES = ["ct_cluster_summary", "ct_join_counts", "cp_edges", "cp_chains", "cs_windows", "fusions", "repair_class", "recurrent_regions", "km_curve", "merge_segments", "cn_oscillation", "vcf_delly_parse"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    from karyoflux.plans import registry
    from karyoflux.runtime import session

    spark = session(cpus, 2 * int(cpus))
    found, times = registry.queries(), {}
    for name in QUERIES:
        runs = []
        for _ in range(3):
            began = time.time()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(statistics.median(runs), 3)
    samples = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "sum of median seconds", "value": total, "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus), "samples": samples, "sec_per_sample": round(total / max(1, samples), 5), "spark": spark.version}))


if __name__ == "__main__":
    main()

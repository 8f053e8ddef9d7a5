"""Time the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from meshlake import registry
from meshlake.session import local_session

HEADLINE = ["knn_cosine", "knn_batch_topk", "bq_two_stage", "search_expand2", "search_advanced", "cypher_two_hop", "cypher_three_hop", "bm25_topk", "filter_range", "filter_all", "diffuse_2", "log_replay_edges"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        run = lambda n=name: registry.QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save()
        run()  # warm
        start = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

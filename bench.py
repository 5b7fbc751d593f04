"""Timings of the headline queries: one JSON line.

Each query runs in full into the no-op sink, after one short warm-up of the session
and its Python workers.
"""

import json
import os
import sys
import time

from semisketch.plans import catalog, inputs
from semisketch.session import local_session

QUERIES = [
    "statement_count",
    "triples",
    "token_dim",
    "vec_str_decay",
    "fingerprint",
    "fingerprint_v1",
    "fingerprint_texts",
    "multi_length",
    "normalize_fp",
    "fingerprint_rows",
    "rank_fp",
    "corr_histogram",
    "pairs_self",
    "topk_pairs",
    "stream_json_lines",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    small = inputs.order_docs(spark, folder).limit(100)
    catalog.fpr.fingerprint(small, 13).write.format("noop").mode("overwrite").save()
    taken = {}
    for name in QUERIES:
        start = time.time()
        result = catalog.QUERIES[name](spark, folder)
        result.write.format("noop").mode("overwrite").save()
        taken[name] = round(time.time() - start, 3)
        print(name, taken[name], file=sys.stderr, flush=True)
    orders = inputs.table(spark, folder, "orders").count()
    vectors = inputs.table(spark, folder, "embeddings").count()
    line = {
        "metric": "total_query_time",
        "value": round(sum(taken.values()), 3),
        "unit": "sec",
        "queries": taken,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "documents_per_sec": round(orders / taken["fingerprint"]),
        "pairs_per_sec": round(vectors * (vectors - 1) / 2 / taken["corr_histogram"]),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()

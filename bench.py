"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import local_spark  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = """
operator_stats rating_vs_sentiment sentiment_distribution rating_mix_by_year rating_by_sentiment
list_operators clean_documents collapse_duplicates running_max_date propagate_labels
candidates_overall candidates_phrase score_reviews score_reviews_batched score_documents
score_documents_batched validate_scores writeback_overall writeback_phrase venue_inputs
top_aspects summarise_group summarise_venues summarise_all
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_spark(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a session pays for starting it; leave that out.
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

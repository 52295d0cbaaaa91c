"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from themeloom.session import build_session  # noqa: E402
from workloads.queries import REGISTRY  # noqa: E402

HEADLINE = [
    "clean_text", "corpus_prepare", "corpus_lemmatised", "corpus_sample", "top_words", "corpus_summary", "vocabulary",
    "tfidf_vectors", "top_terms", "window_counts", "coherence_cv", "topic_distribution", "distribution_summary",
    "representative_docs", "rating_by_topic", "rating_by_model", "topic_map_prevalence", "topic_map_distance",
    "nmf_topics", "score_upload", "lda_topics", "score_transcripts", "topic_sweep",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

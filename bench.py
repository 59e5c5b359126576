"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from themeloom.plans.registered import QUERIES  # noqa: E402
from themeloom.session import build_session  # noqa: E402

HEADLINE = [
    "corpus_profile", "clean_html", "clean_markdown", "clean_latex", "clean_text", "tokens", "lemma_lookup",
    "stopword_union", "vocabulary", "doc_term_counts", "ctfidf_topic_words", "topic_keywords", "topic_info",
    "doc_keywords", "doc_embedding", "topic_centroids", "doc_topic_affinity", "topic_words_cosine",
    "doc_topic_report", "doc_topic_softmax", "dominant_topic", "doc_topic_wide", "ot_topic_words",
    "doc_confidence_report", "coherence_npmi", "topic_agreement", "topic_search", "topic_trend",
    "density_cluster_exact", "embedding_pca", "word2vec_embedding", "lda_fit", "top2vec_fit", "bertopic_fit",
    "ot_topics_fit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cores=os.environ.get("BENCH_CPUS", str(os.cpu_count())))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # Start the Python workers and load the planner's classes before the clock runs.
    QUERIES["doc_topic_affinity"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name:28} {seconds[name]:8.2f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds_all_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline queries: one warm-up run, then the median of three, in seconds."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docsieve.plans import catalog
from docsieve.session import build_session

HEADLINE = (
    "training_documents", "predict_candidates", "arity_parse", "factor_terms", "tokens", "ngrams_1_3", "stemmed_tokens",
    "doc_freq", "vocabulary_pruned", "tfidf_l2", "std_scaled", "split_exact", "stratified_folds",
    "nb_multinomial_predict", "prediction_rows", "prediction_tags", "classification_report", "reconcile_metrics",
    "metric_means", "logistic_score", "linear_svc_score",
)
# Iterative trainings are timed once: their own steps already repeat.
ONCE = ("logistic_score", "linear_svc_score")


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            # The tables have one row group each, which no scan setting splits.
            "docsieve.spread": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        query = catalog.QUERIES[name]
        first = seconds(lambda: query(spark, folder))
        runs = [first] if name in ONCE else [seconds(lambda: query(spark, folder)) for _ in range(3)]
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total of medians", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

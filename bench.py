"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from quillrank.queries import load
from quillrank.session import build_session

HEADLINE = [
    "recommend_baseline_topk", "als_fit_rmse", "als_recommend_all", "logistic_hashed_tol",
    "logistic_quadratic", "passengers_indexed", "passengers_trees", "latest_rating", "top_k_per_user",
    "rank_per_user", "unseen_pairs", "pair_space", "split_exact_count", "uniq_adjacent",
    "median_of_lines", "impute_table", "string_index", "eval_auc_continuous", "eval_rmse",
    "scan_ratings_delimited", "scan_clicks_tsv", "click_features", "clean_text", "score_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    names = sys.argv[1:] or HEADLINE
    # The first query of a session pays for starting it; a scan takes that cost.
    queries["profile_counts"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1]}))


if __name__ == "__main__":
    main()

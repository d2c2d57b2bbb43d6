"""Times the headline queries on one machine and prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; its figure is the
median. Results go to the ``noop`` sink, so that every column is computed and
nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parley.catalog import QUERIES  # noqa: E402
from parley.session import local_session  # noqa: E402

HEADLINE = [
    "d2t_offsets",
    "token_freq_all",
    "text_token_freq",
    "token_freq_supervised",
    "draft_coverage",
    "supervised_in_draft",
    "decode_tokens",
    "norm_sharegpt",
    "mixed_corpus",
    "cap_sample",
    "shuffled_position",
    "global_position",
    "train_val_split",
    "train_val_split_stored",
    "next_valid",
    "epoch_plan",
    "epoch_plan_keyed",
    "limit_samples",
    "length_report",
    "length_histogram",
    "length_sketch",
    "chat_examples",
    "chat_token_freq",
    "supervised_chat_freq",
    "write_chat_examples",
    "length_cap_written",
    "training_batches",
    "training_batches_substituted",
    "training_batches_keyed",
    "first_per_source",
    "extract_text",
    "corpus_sizes",
    "vocab_map_diff",
    "prediction_views",
    "loss_mask_llama",
    "integrity_check",
    "check_files",
    "skip_done",
    "skip_many_done",
    "topk_accuracy",
    "epoch_rollup",
    "concat_layers",
    "pluggable_tokeniser",
]


def timed(fn, spark, folder) -> float:
    start = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "parley-bench")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    seconds, spread = {}, {}
    for name in names:
        timed(QUERIES[name], spark, folder)
        times = [timed(QUERIES[name], spark, folder) for _ in range(runs)]
        seconds[name] = round(statistics.median(times), 3)
        spread[name] = round(max(times) - min(times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "spread": spread,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

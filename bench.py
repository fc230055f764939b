"""Headline queries, timed warm on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from redpencil.plans import REGISTRY  # noqa: E402
from redpencil.session import SPREAD, build_session  # noqa: E402

HEADLINE = [
    "b1_sft_text", "c1_changed_pairs", "c2_seeded_sample_sft", "d12_sft_answer_llama", "d12_sft_answer_mpt",
    "e1_whitespace_tokens", "e2_ptb_tokens", "f2_token_distance", "f3_extract_edits", "f8_edit_count",
    "g4_sentence_counts", "g5_score_single", "g6_score", "g13_gold_profile", "h4_reward_table", "i1_uniq",
    "i8_pairs", "i9_softmax", "j1_correct",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, SPREAD: "true", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    # start the JVM's code paths and Python workers outside the timings
    REGISTRY["f8_edit_count"][0](spark, os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")).count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

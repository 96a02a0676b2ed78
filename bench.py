"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from gausstide.plans import catalogue
from gausstide.session import local_session

HEADLINE = ["hourly_grid_filled", "key_scores", "hopping_covariances", "block_states_shrunk", "w2_d2", "bures_d2", "encode_transport_d2", "var_diag_ridge_argmin", "rolling_reference", "recursive_scores", "panel_records", "panel_effects", "origin_block_intervals", "target_panel", "local_chart_tuning", "reference_library_run", "raw_model_d2", "paired_inference", "holm_adjust"]
LLM = ["op1_toxicity", "op2_decontamination", "op3_order_minhash", "op4_sharding", "op6_line_dedup", "op7_ngram_jaccard_join", "op8_token_counts", "op9_mixture", "op10_licences", "op11_fill_in_middle", "op12_suffix_dedup", "op13_collocations"]


def calibration(spark) -> float:
    """Seconds for work that no change of this repository touches, so that rounds on other machines can be compared."""
    began = time.time()
    spark.range(0, 300_000_000, 1, 8).selectExpr("sum(xxhash64(id) % 1000) as s").collect()
    return round(time.time() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus))
    todo = {k: catalogue.queries()[k] for k in HEADLINE}
    try:
        from gausstide.llm import queries as llm_queries  # absent where only the engine is installed

        todo |= {k: llm_queries.queries()[k] for k in LLM}
    except ModuleNotFoundError:
        pass
    catalogue.flagship(spark, sf_dir).collect()  # starts Python workers and compiles
    took, machine = {}, calibration(spark)
    for name, f in todo.items():
        began = time.time()
        f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "calibration_sec": machine, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

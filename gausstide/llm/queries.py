"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from gausstide.llm import collocations, decontaminate, fill_in_middle, licences, line_dedup, mixture, ngram_join, order_minhash, sharding, suffix_dedup, token_counts, toxicity, url_filter

MODULES = {
    "op1_toxicity": toxicity,
    "op2_decontamination": decontaminate,
    "op3_order_minhash": order_minhash,
    "op4_sharding": sharding,
    "op5_url_filter": url_filter,
    "op6_line_dedup": line_dedup,
    "op7_ngram_jaccard_join": ngram_join,
    "op8_token_counts": token_counts,
    "op9_mixture": mixture,
    "op10_licences": licences,
    "op11_fill_in_middle": fill_in_middle,
    "op12_suffix_dedup": suffix_dedup,
    "op13_collocations": collocations,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in MODULES.items() if getattr(module, "SQL", None)}

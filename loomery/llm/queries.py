"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from loomery.llm import ann_search, chat_format, exact_dedup, jaccard_join, language_id, packing, periodic_runs, pii, quality_rules, sharding, source_mix, vector_codes, warc

_MODULES = {
    "op1_quality_rules": quality_rules,
    "op2_packing": packing,
    "op3_warc": warc,
    "op4_sharding": sharding,
    "op5_language_id": language_id,
    "op6_chat_format": chat_format,
    "op7_jaccard_join": jaccard_join,
    "op8_source_mix": source_mix,
    "op9_pii": pii,
    "op10_exact_dedup": exact_dedup,
    "op11_periodic_runs": periodic_runs,
    "op12_vector_codes": vector_codes,
    "op13_ann_search": ann_search,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}

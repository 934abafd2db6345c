"""The queries of this subpackage, by name, and the SQL that DuckDB can check them with."""

from __future__ import annotations

import importlib

from tessella.llm import oracles

#: One query for each operator: (module, function).
_QUERIES = [
    ("sharding", "op1_hilbert_sharding"),
    ("toxicity", "op2_toxicity"),
    ("tool_calls", "op3_tool_call_linking"),
    ("decontamination", "op4_benchmark_decontamination"),
    ("packing", "op5_best_fit_packing"),
    ("simhash", "op6_simhash_near_dedup"),
    ("quality_classifier", "op7_quality_classifier"),
    ("suffix_dedup", "op8_suffix_array_dedup"),
    ("html_extraction", "op9_html_extraction"),
    ("quality_rules", "op10_quality_rules"),
    ("conversation_repair", "op11_conversation_repair"),
    ("token_counts", "op12_token_counts"),
    ("whitening", "op13_embedding_whitening"),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tessella.llm.{module}"), name) for module, name in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL

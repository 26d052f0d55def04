"""The contract queries of the operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontam, langid, lm, mixing, neardup, quality, rules, tokens, urls

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_language": langid.op2_language,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_quality": quality.op4_quality,
    "op5_context_tree": lm.op5_context_tree,
    "op6_host_rules": rules.op6_host_rules,
    "op7_url_templates": urls.op7_url_templates,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_chat_events": chat.op10_chat_events,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op6_host_rules": rules.OP6_SQL,
    "op10_chat_events": chat.OP10_SQL,
}

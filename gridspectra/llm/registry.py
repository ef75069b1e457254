"""Queries of the subpackage and the SQL they are compared with."""

from __future__ import annotations

from . import archives, bpe_codec, chat, hyperminhash, jaccard_join, mixing, quality_model, quality_rules, spelling, substring_dedup, tiered_index, token_counts, topk

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_arc_to_warc": archives.op4_arc_to_warc,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_quality_classifier": quality_model.op6_quality_classifier,
    "op7_bpe_codec": bpe_codec.op7_bpe_codec,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_suffix_array_dedup": substring_dedup.op9_suffix_array_dedup,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_ranked_search": tiered_index.op12_ranked_search,
    "op13_hyperminhash": hyperminhash.op13_hyperminhash,
}
ORACLE_SQL = {
    "op2_quality_rules": quality_rules.SQL,
    "op3_jaccard_join": jaccard_join.SQL,
    "op4_arc_to_warc": archives.SQL,
    "op5_exact_topk": topk.SQL,
    "op8_source_mixing": mixing.SQL,
    "op10_chat_formatting": chat.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_ranked_search": tiered_index.SQL,
    "op13_hyperminhash": hyperminhash.SQL,
}

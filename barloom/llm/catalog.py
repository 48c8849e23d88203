"""The queries of this package, and their SQL where SQL can express them."""

from . import arc, classifier, counts, decontaminate, jaccard, mixing, packing, pitman_yor, rules, sharding

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_suffix_decontamination": decontaminate.op2_suffix_decontamination,
    "op3_minimax_shards": sharding.op3_minimax_shards,
    "op4_packed_tokens": packing.op4_packed_tokens,
    "op5_arc_to_warc": arc.op5_arc_to_warc,
    "op6_prefix_jaccard": jaccard.op6_prefix_jaccard,
    "op7_pitman_yor_scores": pitman_yor.op7_pitman_yor_scores,
    "op8_factorisation_quality": classifier.op8_factorisation_quality,
    "op9_trie_token_counts": counts.op9_trie_token_counts,
    "op10_quality_rules": rules.op10_quality_rules,
}
SQL = {
    "op1_source_mixing": mixing.SQL1,
    "op2_suffix_decontamination": decontaminate.SQL2,
    "op6_prefix_jaccard": jaccard.SQL6,
    "op5_arc_to_warc": arc.SQL5,
    "op10_quality_rules": rules.SQL10,
}

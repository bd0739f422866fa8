"""The queries of this subpackage, as the entry module registers them."""

from __future__ import annotations

from . import class_lm, conversations, embedding_dedup, language_id, lexical_search, licenses, minhash_dedup, mixing, packing, pii, quality_rules, rule_ensemble, token_counts

QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "op2_rule_ensemble": rule_ensemble.op2,
    "op3_class_lm": class_lm.op3,
    "op4_minhash_dedup": minhash_dedup.op4,
    "op5_mixing": mixing.op5,
    "op6_packing": packing.op6,
    "op7_token_counts": token_counts.op7,
    "op8_pii": pii.op8,
    "op9_license_scan": licenses.op9,
    "op10_embedding_dedup": embedding_dedup.op10,
    "op11_language_id": language_id.op11,
    "op12_conversation_repair": conversations.op12,
    "op13_lexical_search": lexical_search.op13,
}

ORACLES = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op9_license_scan": licenses.OP9_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}

"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from tidemark.llm import bpe, mixing, neardup, quality, quotes, resampling, substring, telephony, tokencount, toxicity

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_telephony": telephony.op2_telephony,
    "op2_payloads": telephony.op2_payloads,
    "op3_token_counts": tokencount.op3_token_counts,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_quotation_links": quotes.op6_quotation_links,
    "op6_reply_order": quotes.op6_reply_order,
    "op6_mailed_replies": quotes.op6_mailed_replies,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_quality_rules": quality.op8_quality_rules,
    "op8_counts": quality.op8_counts,
    "op9_importance_resampling": resampling.op9_importance_resampling,
    "op10_mixing": mixing.op10_mixing,
    "op10_targets": mixing.op10_targets,
}

ORACLES = {
    "op1_substring_dedup": substring.OP1_SQL,
    "op2_payloads": telephony.OP2_SQL,
    "op6_quotation_links": quotes.OP6_SQL,
    "op8_counts": quality.OP8_SQL,
    "op10_targets": mixing.OP10_SQL,
    "op6_reply_order": quotes.OP6_ORDER_SQL,
    "op6_mailed_replies": quotes.OP6_MAILED_SQL,
}

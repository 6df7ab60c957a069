"""The queries of this subpackage and, where SQL can express them on whole tables, their DuckDB counterparts."""

from hearthline.llm import chat_format, decontaminate, line_dedup, ngram_jaccard, packing, pii, quality_rules, token_counts, toxicity, warc

QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard.op1_ngram_jaccard,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_pii": pii.op6_pii,
    "op7_warc": warc.op7_warc,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLE_SQL = {
    "op1_ngram_jaccard": ngram_jaccard.OP1_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
}

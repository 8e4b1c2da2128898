"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from tidemark.llm import alignment, bpe, chat, decontaminate, exact_dedup, html_main, jaccard, kneser_ney, packing, repair, stupid_backoff, suffix_dedup, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_html_extraction": html_main.op4_html_extraction,
    "op5_warc": warc.op5_warc,
    "op6_lm_scoring": stupid_backoff.op6_lm_scoring,
    "op7_bpe": bpe.op7_bpe,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_chat_format": chat.op9_chat_format,
    "op10_quality_classifier": kneser_ney.op10_quality_classifier,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_best_fit_packing": packing.op12_best_fit_packing,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op5_warc": warc.SQL,
    "op8_ngram_jaccard": jaccard.SQL,
    "op9_chat_format": chat.SQL,
    "op13_conversation_repair": repair.SQL,
}

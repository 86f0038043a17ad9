"""Queries of this subpackage, and their twins in SQL where SQL can express them."""

from __future__ import annotations

from newsdesk.llm import chat_format, conversation_repair, curriculum, exact_dedup, hard_negatives, language_id, line_dedup, media, near_dedup, packing, sentencepieces, substring_dedup, token_files

QUERIES = {
    "op1_sentencepiece": sentencepieces.op1_sentencepiece,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_media_columns": media.op8_media_columns,
    "op9_chat_formatting": chat_format.op9_chat_formatting,
    "op10_token_files": token_files.op10_token_files,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_source_mix": curriculum.op13_source_mix,
}
ORACLE_SQL = {
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op9_chat_formatting": chat_format.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_source_mix": curriculum.ORACLE,
}

"""The queries of the corpus operators over the given tables."""

from __future__ import annotations

from tickloom.llm import bpe, checks, conversations, decontaminate, language, length_hist, lexical, lm_score, mixing, phrase_print, simhash, token_files, toxicity, url_filter

QUERIES = {
    "op5_decontaminate": decontaminate.op5,
    "op2_lm_score": lm_score.op2,
    "op7_length_hist": length_hist.op7,
    "op9_bpe": bpe.op9,
    "op4_token_files": token_files.op4,
    "op3_phrase_print": phrase_print.op3,
    "op1_url_filter": url_filter.op1,
    "op6_simhash": simhash.op6,
    "op8_toxicity": toxicity.op8,
    "op10_language": language.op10,
    "op11_repair": conversations.op11,
    "op12_search": lexical.op12,
    "op13_mix": mixing.op13,
} | checks.QUERIES
ORACLE_SQL: dict[str, str] = {"op12_search": lexical.SQL, "op13_mix": mixing.SQL} | checks.ORACLE_SQL

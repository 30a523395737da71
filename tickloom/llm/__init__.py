"""Operators for building training corpora, one module each.

Modules: url_filter, lm_score, phrase_print, token_files, decontaminate, simhash,
length_hist, toxicity, bpe, language, conversations, lexical, mixing. ``queries`` registers them over the given tables.
"""

"""The queries of this package's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from quarterlight.llm import decontaminate, html_text, language_id, lm_score, mixing, near_dup, nearest, phrases, spelling, token_files, url_filter, vector_dups, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_html_text": html_text.op2_html_text,
    "op3_language_id": language_id.op3_language_id,
    "op4_warc": warc.op4_warc,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_token_files": token_files.op6_token_files,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_nearest": nearest.op8_nearest,
    "op9_lm_score": lm_score.op9_lm_score,
    "op10_near_dup": near_dup.op10_near_dup,
    "op11_phrases": phrases.op11_phrases,
    "op12_spelling": spelling.op12_spelling,
    "op13_vector_dups": vector_dups.op13_vector_dups,
}
ORACLES = {
    "op4_warc": warc.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op11_phrases": phrases.OP11_SQL,
}

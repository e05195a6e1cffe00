"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import chat, decontam, htmltext, licenses, linededup, packing, quality, repair, simhash, simple8b, toxicity, urlrules, variants

QUERIES = {
    "op1_decontaminate": decontam.q_decontaminate,
    "op2_token_files": simple8b.q_token_files,
    "op3_licenses": licenses.q_licenses,
    "op4_packing": packing.q_packing,
    "op5_quality": quality.q_quality,
    "op6_url_rules": urlrules.q_url_rules,
    "op7_toxicity": toxicity.q_toxicity,
    "op8_chat": chat.q_chat,
    "op9_simhash": simhash.q_simhash,
    "op10_line_dedup": linededup.q_line_dedup,
    "op11_main_text": htmltext.q_main_text,
    "op12_conversation_repair": repair.q_repair,
    "op13_spelling_variants": variants.q_variants,
}
ORACLE = {
    "op1_decontaminate": decontam.SQL,
    "op5_quality": quality.SQL,
    "op6_url_rules": urlrules.SQL,
    "op8_chat": chat.SQL,
    "op10_line_dedup": linededup.SQL,
    "op12_conversation_repair": repair.SQL,
    "op13_spelling_variants": variants.SQL,
}

"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, divergence, html, language, mixing, pieces, pii, quality, runs, simhash, substrings, vafile, warc

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_mix_sources,
        warc.op2_warc_fixity,
        substrings.op3_substring_dedup,
        html.op4_html_extraction,
        simhash.op5_simhash_near_dedup,
        vafile.op6_exact_top_k,
        pii.op7_pii_pseudonyms,
        language.op8_language_id,
        quality.op9_quality_rules,
        pieces.op10_sentencepiece,
        runs.op11_run_detection,
        chat.op12_chat_formatting,
        divergence.op13_source_divergence,
    )
}

ORACLE_SQL = {"op2_warc_fixity": warc.OP2_SQL, "op3_substring_dedup": substrings.OP3_SQL, "op6_exact_top_k": vafile.OP6_SQL, "op12_chat_formatting": chat.OP12_SQL, "op13_source_divergence": divergence.OP13_SQL}

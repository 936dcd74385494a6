"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from fraudloom.llm import align, ann, conversations, forest, html_text, lines, mixing, quality, secrets, simhash, spm, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_line_dedup": lines.query,
    "op3_quality_rules": quality.query,
    "op4_simhash": simhash.query,
    "op5_mixing": mixing.query,
    "op6_ann": ann.query,
    "op7_sentencepiece": spm.query,
    "op8_warc": warc.query,
    "op9_secrets": secrets.query,
    "op10_html_text": html_text.query,
    "op11_alignment": align.query,
    "op12_minhash_forest": forest.query,
    "op13_conversations": conversations.query,
}

ORACLE_SQL = {
    "op3_quality_rules": quality.SQL,
    "op8_warc": warc.SQL,
    "op12_minhash_forest": forest.SQL,
    "op13_conversations": conversations.SQL,
}

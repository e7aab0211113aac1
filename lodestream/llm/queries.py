"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lodestream.llm import decontaminate, embedding_dedup, html_text, language, license_scan, line_dedup, merkle, near_dedup, pieces, secret_scan, spelling, token_files, url_filter

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_html_text": html_text.op2_html_text,
    "op3_token_files": token_files.op3_token_files,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_language_id": language.op8_language_id,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

SQL = {
    "op2_html_text": html_text.OP2_SQL,
    "op5_near_dedup": near_dedup.OP5_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_license_scan": license_scan.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}

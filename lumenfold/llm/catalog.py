"""Queries of this subpackage, each over its whole table."""

from . import alignment, bpe, collocation, html_text, licenses, line_dedup, mixing, passages, quality, recount, simhash, token_store, topk

QUERIES = {
    "op11_license_scan": licenses.op11_license_scan,
    "op12_phrase_collocations": collocation.op12_phrase_collocations,
    "op13_token_alignment": alignment.op13_token_alignment,
    "op5_edited_counts": recount.op5_edited_counts,
    "op3_substring_dedup": passages.op3_substring_dedup,
    "op9_top_k": topk.op9_top_k,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_quality_rules": quality.op7_quality_rules,
    "op4_token_store": token_store.op4_token_store,
    "op1_html_text": html_text.op1_html_text,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op8_simhash": simhash.op8_simhash,
}

ORACLES: dict[str, str] = {
    "op11_license_scan": licenses.OP11_SQL,
    "op12_phrase_collocations": collocation.OP12_SQL,
    "op9_top_k": topk.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op7_quality_rules": quality.OP7_SQL,
}

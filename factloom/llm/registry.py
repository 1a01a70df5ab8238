"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from factloom.llm import bpe_lexicon, html_extract, knn, license_scan, mixing, near_dup, progressive_jpeg, token_count, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_progressive_jpeg": progressive_jpeg.op2_progressive_jpeg,
    "op3_mixing": mixing.op3_mixing,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_kdtree_topk": knn.op5_kdtree_topk,
    "op6_token_count": token_count.op6_token_count,
    "op7_bpe_lexicon": bpe_lexicon.op7_bpe_lexicon,
    "op8_minhash_near_dup": near_dup.op8_minhash_near_dup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_html_extract": html_extract.op10_html_extract,
}
ORACLE_SQL = {
    "op5_kdtree_topk": knn.ORACLE_SQL,
    "op8_minhash_near_dup": near_dup.ORACLE_SQL,
    "op9_url_filter": url_filter.ORACLE_SQL,
}

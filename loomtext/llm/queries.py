"""The queries of the training-data operators, and the SQL that gives their rows where there is any."""

from __future__ import annotations

from loomtext.llm import embedding_dedup, mixing, packing, pii, simhash, token_counts, token_ids, topk, toxicity, url_filter

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_embedding_near_duplicates": embedding_dedup.query,
    "op3_mixture": mixing.query,
    "op4_toxicity": toxicity.query,
    "op5_packing": packing.query,
    "op6_private_identifiers": pii.query,
    "op7_simhash_near_duplicates": simhash.query,
    "op8_top_products": topk.query,
    "op9_token_ids": token_ids.query,
    "op10_url_filter": url_filter.query,
    "embedding_copies_near_duplicates": embedding_dedup.query_with_copies,
}

ORACLES: dict[str, str] = {
    "op2_embedding_near_duplicates": embedding_dedup.SQL,
    "op3_mixture": mixing.SQL,
    "embedding_copies_near_duplicates": embedding_dedup.SQL_WITH_COPIES,
    "op8_top_products": topk.SQL,
}

"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from crestline.llm import embeddings, exact_dedup, jaccard, langid, mixing, packing, rules, secrets, tokens, urls

QUERIES = {
    "op1_pack": packing.op1_query,
    "op2_secrets": secrets.op2_query,
    "op3_ngram_jaccard": jaccard.op3_query,
    "op4_embedding_near_dedup": embeddings.op4_query,
    "op5_mix": mixing.op5_query,
    "op6_token_counts": tokens.op6_query,
    "op7_url_filter": urls.op7_query,
    "op8_exact_dedup": exact_dedup.op8_query,
    "op9_quality": rules.op9_query,
    "op10_language_id": langid.op10_query,
}

ORACLES = {
    "op2_secrets": secrets.OP2_SQL,
    "op3_ngram_jaccard": jaccard.OP3_SQL,
    "op4_embedding_near_dedup": embeddings.OP4_SQL,
    "op5_mix": mixing.OP5_SQL,
    "op7_url_filter": urls.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}

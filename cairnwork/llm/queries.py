"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from cairnwork.llm import centroids, exact_dedup, jaccard_join, licences, mainhtml, mergerounds, merkle, packing, pieces, quality, secretscan, tokenstore, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_fingerprints": merkle.op4_fingerprints,
    "op5_license_scan": licences.op5_license_scan,
    "op6_ngram_jaccard": jaccard_join.op6_ngram_jaccard,
    "op7_html_extract": mainhtml.op7_html_extract,
    "op8_secret_scan": secretscan.op8_secret_scan,
    "op9_quality": quality.op9_quality,
    "op10_token_store": tokenstore.op10_token_store,
    "op11_bpe_rounds": mergerounds.op11_bpe_rounds,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op4_fingerprints": merkle.ORACLE_SQL,
    "op6_ngram_jaccard": jaccard_join.ORACLE_SQL,
    "op13_centroid_clustering": centroids.ORACLE_SQL,
}

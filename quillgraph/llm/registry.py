"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from quillgraph.llm import balltree, bpe_tree, extendible, impacts, jaccard, langid, maxscore, media, packing, pii, quality, secrets, wavelet


def queries() -> dict:
    return {
        "op1_token_files": wavelet.op1_token_files,
        "op2_maxscore": maxscore.op2_maxscore,
        "op3_extendible_hashing": extendible.op3_extendible_hashing,
        "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_bpe_tree": bpe_tree.op6_bpe_tree,
        "op7_language_id": langid.op7_language_id,
        "op8_pii": pii.op8_pii,
        "op9_media": media.op9_media,
        "op10_secrets": secrets.op10_secrets,
        "op11_ball_tree": balltree.op11_ball_tree,
        "op12_compression_bands": quality.op12_compression_bands,
        "op13_impact_search": impacts.op13_impact_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_maxscore": maxscore.OP2_SQL,
        "op3_extendible_hashing": extendible.OP3_SQL,
        "op4_ngram_jaccard": jaccard.OP4_SQL,
        "op11_ball_tree": balltree.OP11_SQL,
        "op13_impact_search": impacts.OP13_SQL,
    }

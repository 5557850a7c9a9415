"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline

from . import embeddings, langid, lm, materialize, minhash, packing, pieces, quality, sharding, spans

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_packing": packing.op4_packing,
    "op5_lm_scoring": lm.op5_lm_scoring,
    "op6_substring_dedup": spans.op6_substring_dedup,
    "op7_language_id": langid.op7_language_id,
    "op8_minhash": minhash.op8_minhash,
    "op9_embedding_dedup": embeddings.op9_embedding_dedup,
    "op10_training_order": materialize.op10_training_order,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_sharding": sharding.op1_sql(),
    "op6_substring_dedup": spans.op6_sql(),
    "op8_minhash": minhash.op8_sql(),
    "op9_embedding_dedup": embeddings.op9_sql(),
}

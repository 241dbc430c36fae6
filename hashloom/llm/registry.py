"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from hashloom.llm import bpe, chat, embedding_dedup, exact_dedup, near_dedup, packing, pii, quality, suffix_dedup, toxicity


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline, "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup, "op2_toxicity": toxicity.op2_toxicity, "op3_near_dedup": near_dedup.op3_near_dedup, "op4_quality": quality.op4_quality, "op5_packing": packing.op5_packing, "op6_exact_dedup": exact_dedup.op6_exact_dedup, "op7_bpe": bpe.op7_bpe, "op8_chat": chat.op8_chat, "op9_pii": pii.op9_pii, "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup}


def oracles() -> dict[str, str]:
    return {"op1_suffix_dedup": suffix_dedup.ORACLE, "op10_embedding_dedup": embedding_dedup.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op8_chat": chat.ORACLE}

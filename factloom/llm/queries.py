"""The operators' queries, by name. Each takes (spark, sf_dir)."""

from __future__ import annotations

from factloom.llm import bpe, chat, decontaminate, embedding_join, jaccard, language, lm, periodic, pii, quality, substring, toxicity, whitening

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_decontaminate": decontaminate.query,
    "op3_chat": chat.query,
    "op4_pii": pii.query,
    "op5_language": language.query,
    "op6_toxicity": toxicity.query,
    "op7_jaccard_join": jaccard.query,
    "op8_lm_score": lm.query,
    "op9_substring_dedup": substring.query,
    "op10_quality_rules": quality.query,
    "op11_whitening": whitening.query,
    "op12_embedding_join": embedding_join.query,
    "op13_periodic_runs": periodic.query,
}
ORACLE = {
    "op2_decontaminate": decontaminate.SQL,
    "op7_jaccard_join": jaccard.SQL,
    "op9_substring_dedup": substring.SQL,
    "op12_embedding_join": embedding_join.SQL,
}

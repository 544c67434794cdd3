"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from strikeflow.llm import alignment, language_id, line_dedup, lm_score, media, mixing, packing, pieces, pii, quality, simhash, spelling, toxicity

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_media_columns": media.op5_media_columns,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_language_id": language_id.op7_language_id,
    "op8_simhash_dedup": simhash.op8_simhash_dedup,
    "op9_pii": pii.op9_pii,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_mixing": mixing.op13_mixing,
}
ORACLE_SQL: dict[str, str] = {"op13_mixing": mixing.ORACLE}

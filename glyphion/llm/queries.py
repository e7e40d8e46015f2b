"""The registered queries of this subpackage: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from glyphion.llm import decontaminate, ecoc_language, jaccard_join, kd_sharding, line_dedup, maxscore, pii_disclosure, sentencepiece_viterbi, substring_dedup, token_counts

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_ecoc_language": ecoc_language.op2_ecoc_language,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_pii_disclosure": pii_disclosure.op4_pii_disclosure,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_maxscore": maxscore.op6_maxscore,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_sentencepiece_viterbi": sentencepiece_viterbi.op8_sentencepiece_viterbi,
    "op9_kd_sharding": kd_sharding.op9_kd_sharding,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLE_SQL = {
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op6_maxscore": maxscore.ORACLE_SQL,
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op10_substring_dedup": substring_dedup.ORACLE_SQL,
}

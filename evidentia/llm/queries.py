"""Registered queries of this subpackage, by name, and their SQL where it can express them."""

from evidentia.llm import fingerprints, jaccard_join, language_id, line_dedup, mixing, packing, preferences, quality_classifier, quality_rules, sharding

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_sharding": sharding.op2_sharding,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_preferences": preferences.op6_preferences,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_language_id": language_id.op10_language_id,
    "language_id_pages": language_id.language_id_pages,
}

ORACLE_SQL = {
    "op4_quality_rules": quality_rules.ORACLE,
    "op6_preferences": preferences.ORACLE,
    "op7_jaccard_join": jaccard_join.ORACLE,
    "op9_mixing": mixing.ORACLE,
}

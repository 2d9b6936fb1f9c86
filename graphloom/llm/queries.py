"""The text operators' queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from graphloom.llm import fingerprints, jaccard_join, language_id, license_scan, mixing, packing, quality_classifier, quality_rules, token_files, warc

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_packing": packing.query,
    "op3_language_id": language_id.query,
    "op4_warc": warc.query,
    "op5_token_files": token_files.query,
    "op6_mixing": mixing.query,
    "op7_quality_rules": quality_rules.query,
    "op8_fingerprints": fingerprints.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_jaccard_join": jaccard_join.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": warc.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
}

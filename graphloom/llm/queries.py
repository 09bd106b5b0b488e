"""Registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from . import decontamination, embedding_dedup, filter_audit, importance, language_id, licenses, mixing, near_dedup, packing, pii, quality_rules, substring_dedup, token_counts

QUERIES = {
    "op1_mixing": mixing.run,
    "op2_language_id": language_id.run,
    "op3_near_dedup": near_dedup.run,
    "op4_packing": packing.run,
    "op5_licenses": licenses.run,
    "op6_quality_rules": quality_rules.run,
    "op7_substring_dedup": substring_dedup.run,
    "op8_token_counts": token_counts.run,
    "op9_embedding_dedup": embedding_dedup.run,
    "op10_pii": pii.run,
    "op11_importance": importance.run,
    "op12_filter_audit": filter_audit.run,
    "op13_decontamination": decontamination.run,
}

SQL = {"op4_packing": packing.ORACLE_SQL, "op9_embedding_dedup": embedding_dedup.ORACLE_SQL, "op11_importance": importance.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL}

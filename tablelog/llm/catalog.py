"""Queries of the subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from tablelog.llm import decontamination, license_scan, line_dedup, packing, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_simhash": simhash.op2_simhash,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_warc": warc.op10_warc,
}

ORACLE_SQL = {
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op4_decontamination": decontamination.ORACLE_SQL,
    "op6_substring_dedup": substring_dedup.ORACLE_SQL,
    "op8_secret_scan": secret_scan.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
}

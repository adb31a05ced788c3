"""Queries of the text operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

#: module of this package and its query; each module has the SQL, if any, as ORACLE.
_MODULES = {
    "op1_toxicity": "toxicity",
    "op2_quality_rules": "quality_rules",
    "op3_mix_sources": "mixing",
    "op4_byte_bpe": "bpe",
    "op5_kneser_ney": "kneser_ney",
    "op6_exact_dedup": "exact_dedup",
    "op7_simhash": "simhash",
    "op8_token_counts": "token_counts",
    "op9_license_scan": "license_scan",
    "op10_secret_scan": "secrets_scan",
}


def queries() -> dict:
    return {name: getattr(import_module(f"quillframe.llm.{m}"), name) for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"quillframe.llm.{m}"), "ORACLE", None) for name, m in _MODULES.items()}
    return {k: v for k, v in found.items() if v}

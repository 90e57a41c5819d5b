"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib

#: query -> module; each module has query(spark, sf_dir) and may have SQL
MODULES = {
    "op1_main_text": "extract",
    "op2_jaccard_join": "jaccard",
    "op3_suffix_dedup": "suffix_dedup",
    "op4_language_id": "langid",
    "op5_warc": "warc",
    "op6_decontamination": "decontaminate",
    "op7_license_scan": "licenses",
    "op8_chat_format": "chat",
    "op9_transport_streams": "media",
    "op10_mix_sources": "mixing",
    "op11_vector_codes": "vector_codes",
    "op12_ball_tree": "ball_tree",
    "op13_token_files": "token_files",
}


def queries() -> dict:
    return {name: importlib.import_module(f".{m}", __package__).query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f".{m}", __package__), "SQL", None) for name, m in MODULES.items()}
    return {k: v for k, v in found.items() if v}

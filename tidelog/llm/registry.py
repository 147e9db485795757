"""The corpus operators' queries and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "op1_quality",
    "op2_language",
    "op3_decontamination",
    "op4_simhash",
    "op5_neighbours",
    "op6_warc",
    "op7_sharding",
    "op8_sentencepiece",
    "op9_token_counts",
    "op10_substrings",
]

QUERIES = {}
ORACLES = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES[_module.NAME] = _module.query
    if _module.ORACLE_SQL:
        ORACLES[_module.NAME] = _module.ORACLE_SQL

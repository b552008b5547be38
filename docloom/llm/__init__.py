"""Training-data operators: licence scans, personal data, archives, de-duplication, mixing, quality,
language-model scoring, subword encoding, source divergence, main text of pages and ranked search. Nothing else in the package imports this subpackage.

``queries()`` and ``oracle_sql()`` gather what the operator modules register.
"""

from __future__ import annotations

from importlib import import_module

#: Operator modules, each with QUERIES and ORACLES.
MODULES = ("substring_dedup", "lm_score", "sentencepiece", "licenses", "warc", "pii", "near_dedup", "mixing", "quality", "exact_dedup", "divergence", "wrappers", "search")


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").ORACLES
    return found

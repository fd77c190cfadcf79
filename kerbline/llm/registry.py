"""Queries and oracle SQL of the training-data operators, in the order of their numbers."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("decontaminate", "sentencepiece_codec", "quality_rules", "language_id", "license_scan", "toxicity", "near_dedup", "html_extract", "sharding", "secret_scan", "conversation_repair", "warc", "vector_codes")


def _gathered(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        out.update(getattr(import_module(f"{__package__}.{module}"), name))
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("ORACLES")

"""Operators for training-data pipelines. Each module has its operator, a thin query and, where SQL can express it, that SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["decontaminate", "embeddings", "language", "packing", "html_text", "gram_join", "url_rules", "sharding", "line_dedup", "token_files", "bpe", "middle", "whitening"]


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f".{name}", __name__).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(f".{name}", __name__).ORACLE_SQL
    return out

"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (and ORACLES).
MODULES = ("lm_scoring", "suffix_dedup", "piece_codec", "simhash_dedup", "decontaminate", "chat_tree", "line_quality", "toxicity", "language_mix", "kk_shards",)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"{__package__}.{m}").ORACLES.items()}

"""Operators of a training-data pipeline.  Nothing outside this folder imports them but the driver's entry."""

from __future__ import annotations

MODULES = [
    "line_dedup", "near_dup", "decontaminate", "toxicity", "mixing", "hamming_search", "warc", "page_text", "surrogates", "language_model",
    "token_shards", "importance", "vector_codes",
]


def _load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"crewframe.llm.{name}")


def queries() -> dict:
    from crewframe.llm import base

    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    from crewframe.llm import base

    _load()
    return dict(base.ORACLE)

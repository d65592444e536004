"""Queries of the text operators and the SQL for those that SQL can express."""

from importlib import import_module

MODULES = ("langid", "quality", "chat", "html", "packing", "sentencepiece_bpe", "vectors", "jaccard", "suffix", "url")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"framewright.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL

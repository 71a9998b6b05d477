"""The queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

import importlib

_MODULES = ("flac", "pseudo_lm", "huffman", "packing", "line_crf", "set_join", "exact_dedup", "mixing", "warc", "sharding")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in _MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)

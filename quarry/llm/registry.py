"""Collects the named queries of this subpackage."""

from __future__ import annotations

from importlib import import_module

_NAMES = ("pieces", "neardup", "leaks", "residue", "subjects", "pairs", "scans", "packing")
#: Imported here, so that this module can't be imported where one of them can't.
_PARTS = [import_module(f"quarry.llm.{n}_queries") for n in _NAMES]


def queries() -> dict:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.SQL.items()}

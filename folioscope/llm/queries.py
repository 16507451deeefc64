"""All queries of the subpackage by name."""

from __future__ import annotations

import importlib

MODULES = [importlib.import_module(f"folioscope.llm.p{n}") for n in range(1, 10) if n != 3]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}

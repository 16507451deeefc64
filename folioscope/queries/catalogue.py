"""All queries of the core library by name."""

from __future__ import annotations

from folioscope.queries import agreement, extraction, inputs, networks, p3, profiles, scalars, segments, statistics, stores, vectors

MODULES = [p3, statistics, stores, agreement, networks, profiles, scalars, segments, vectors, extraction, inputs]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}

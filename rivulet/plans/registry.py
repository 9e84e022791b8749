"""Queries and their oracle SQL by name; filled by the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


from . import checks, drainage, files, forcing, junctions, network, product, records, solver, spatial, stitch, streets, terrain, validation  # noqa: E402, F401

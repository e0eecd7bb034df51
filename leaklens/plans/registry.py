"""Registry of named queries: a Spark builder and the DuckDB oracle text.

Each query names the SURVEY operator ids it exercises.  Builders take a
``Tables`` (adapter views of one test-data folder) and return a lazy
DataFrame.  ``oracle`` is ANSI SQL over the driver's pre-registered base
tables with the adapter views inlined as CTEs; ``None`` marks operators
that are checked against brute force in tests instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from leaklens.sources.tables import Tables


@dataclass
class Query:
    name: str
    ids: list[str]
    build: Callable[[Tables], DataFrame]
    oracle: str | None
    doc: str = ""
    tags: list[str] = field(default_factory=list)


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, oracle: str | None):
    """Decorator registering ``fn(tables) -> DataFrame`` under ``name``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, ids.split(), fn, oracle, (fn.__doc__ or "").strip())
        return fn

    return deco

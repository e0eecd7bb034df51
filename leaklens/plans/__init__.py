"""Named queries (Spark builder + DuckDB oracle text) per SURVEY operator."""

from leaklens.plans import (  # noqa: F401  (register queries)
    attribution,
    hook_change_reports,
    ingest,
    matrix,
    static_reports,
    static_scan,
    streaming,
)
from leaklens.plans.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]

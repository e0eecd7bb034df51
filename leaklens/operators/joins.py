"""Reference checks between tables.

No join here is hinted: the planner and AQE broadcast what they know to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent (what a FOREIGN KEY rejects)."""
    p = parent.select(F.col(parent_key).alias("__pk")).distinct()
    return child.join(p, child[child_key] == p["__pk"], "left_anti")


def with_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows that do have a parent."""
    p = parent.select(F.col(parent_key).alias("__pk")).distinct()
    return child.join(p, child[child_key] == p["__pk"], "left_semi")

"""Access to the driver's parquet tables and the adapter views over them."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from leaklens.sources.adapters import ADAPTERS, BASE_TABLES, DERIVED, DERIVED_DEPS


class Tables:
    """Adapter views of one test-data folder.

    ``spark.sql`` analyses its plan when called, so each adapter DataFrame
    keeps the parquet scans of *this* folder even if another ``Tables``
    re-registers the base view names later.  Scans stay lazy: column pruning
    and filter pushdown reach parquet through the view.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    def _register_base(self, sql: str) -> None:
        # Register only the base tables this adapter text reads.
        words = set(re.findall(r"[a-z_]+", sql))
        for name in BASE_TABLES:
            if name in words:
                self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet")) \
                    .createOrReplaceTempView(name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in DERIVED:
                for dep in DERIVED_DEPS[name]:
                    self[dep].createOrReplaceTempView(dep)
                df = self.spark.sql(DERIVED[name])
            else:
                self._register_base(ADAPTERS[name])
                df = self.spark.sql(ADAPTERS[name])
            self._cache[name] = df
        return self._cache[name]

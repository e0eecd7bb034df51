"""Hooked file-function records: baseline subtraction and log-path reports.

Input rows: (plugin_slug, function, params array<string>, error).  The
reports test the canonical params *text* ``[a, b]`` (P16) with the F3
log-path predicate, which is built once and shared by every report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaklens.functions.predicates import log_path, name_contains_ci
from leaklens.functions.scalar import params_text

HOOK_SCHEMA = T.StructType([
    T.StructField("function", T.StringType()),
    T.StructField("params", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])

HOOK_SCHEMA_WITH_SLUG = T.StructType([T.StructField("plugin_slug", T.StringType())] + HOOK_SCHEMA.fields)



def parse_hook_lines(lines: DataFrame, col: str = "value", schema: T.StructType = HOOK_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """One JSON text per row -> (its typed fields, the rows whose text is
    no such record)."""
    keep = [c for c in lines.columns if c != col]
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.withColumn("h", F.from_json(F.col(col), full))
    bad = F.col("h").isNull() | F.col("h._corrupt_record").isNotNull()
    return parsed.filter(~bad).select(*keep, *[f"h.{f.name}" for f in schema.fields]), parsed.filter(bad).drop("h")


def subtract_baseline(hooks: DataFrame, baseline: DataFrame, path_col: str = "path") -> DataFrame:
    """Drop hook rows whose first param is a path of a clean instance.

    Anti-join on ``params[0]``, unhinted: the planner broadcasts the baseline
    only if it knows it to be small.
    """
    b = baseline.select(F.col(path_col).alias("__bp")).distinct()
    h = hooks.withColumn("__p0", F.element_at("params", 1))
    return h.join(b, h["__p0"] == b["__bp"], "left_anti").drop("__p0")


def with_params_text(hooks: DataFrame) -> DataFrame:
    """Add the canonical text form of params."""
    return hooks.withColumn("params_text", params_text("params"))


def log_like(hooks: DataFrame) -> DataFrame:
    """F3 applied: hook rows whose params text names a log-like path."""
    return hooks.filter(log_path("params_text"))


def log_path_counts(hooks: DataFrame) -> DataFrame:
    """Count and distinct count of log-like paths."""
    return log_like(hooks).agg(
        F.count("params_text").alias("n_log_paths"),
        F.countDistinct("params_text").alias("n_distinct_log_paths"),
    )


def log_path_counts_per_plugin(hooks: DataFrame) -> DataFrame:
    """A13 per plugin (slug kept in the output)."""
    return log_like(hooks).groupBy("plugin_slug").agg(
        F.count("params_text").alias("n_log_paths"),
        F.countDistinct("params_text").alias("n_distinct_log_paths"),
    )


def log_path_frequency(hooks: DataFrame) -> DataFrame:
    """A15 + T4: how often each log-like path was used, most frequent first."""
    return (log_like(hooks).groupBy(F.col("params_text").alias("filepath"))
            .agg(F.count(F.lit(1)).alias("num_of_times"))
            .orderBy(F.desc("num_of_times"), "filepath"))


def hook_overview(hooks: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """Distinct functions, distinct paths, total hooks.

    Exact distinct counts expand the input once per distinct column; for
    very large inputs ``approx_rsd`` (e.g. 0.01) switches to HyperLogLog++
    sketches merged map-side, one pass, bounded memory.
    """
    if approx_rsd is None:
        nf, npaths = F.countDistinct("function"), F.countDistinct("params_text")
    else:
        nf = F.approx_count_distinct("function", approx_rsd)
        npaths = F.approx_count_distinct("params_text", approx_rsd)
    return hooks.agg(nf.alias("n_functions"), npaths.alias("n_paths"), F.count(F.lit(1)).alias("n_hooks"))


def calls_per_function(hooks: DataFrame) -> DataFrame:
    """A17 + T4: calls per hooked function, descending."""
    return (hooks.groupBy("function").agg(F.count(F.lit(1)).alias("total_called"))
            .orderBy(F.desc("total_called"), "function"))


def baseline_paths(fresh_hooks: DataFrame) -> DataFrame:
    """Sorted distinct first params of a clean instance's hook records."""
    return (fresh_hooks.select(F.element_at("params", 1).alias("path"))
            .filter(F.col("path").isNotNull()).distinct().orderBy("path"))


def distinct_log_paths(hooks: DataFrame) -> DataFrame:
    """L1: the distinct log-like params (the report's view)."""
    return log_like(hooks).select(F.col("params_text").alias("params")).distinct()


def log_paths_naming(hooks: DataFrame) -> DataFrame:
    """L2: distinct log-like params naming ``error`` or ``debug`` (F10),
    one row per (params, word): one scan and one distinct serve both words."""
    words = F.array(*[F.when(name_contains_ci("params", w), F.lit(w)) for w in ("error", "debug")])
    return (distinct_log_paths(hooks).select("params", F.explode(words).alias("word"))
            .filter(F.col("word").isNotNull()))

"""File-change findings by interface (REST / AJAX / WP-CLI) and their reports.

F4-F6 decide whether a changed file is a written log file; A18-A22 and
L3-L4 count and list them; P5/P10/S12 shape the routed warehouse tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaklens.functions.predicates import log_file, name_contains_ci
from leaklens.functions.scalar import url_faithful, url_fixed

NAME = "name_of_changed_file"


def log_files(findings: DataFrame, interface: str) -> DataFrame:
    """F4/F5/F6 applied for the interface's variant."""
    return findings.filter(log_file(NAME, interface))


def cli_log_files(cli: DataFrame) -> DataFrame:
    """L3: (plugin, file) of log files written by CLI commands."""
    return log_files(cli, "WP_CLI").select("plugin_slug", NAME)


def log_files_per_plugin(findings: DataFrame, interface: str) -> DataFrame:
    """A18 + T4: log files per plugin, descending."""
    return (log_files(findings, interface).groupBy("plugin_slug")
            .agg(F.count(F.lit(1)).alias("num_of_files"))
            .orderBy(F.desc("num_of_files"), "plugin_slug"))


def log_file_frequency(findings: DataFrame, interface: str) -> DataFrame:
    """A19/A20 + T4: how often each log-file name was written."""
    return (log_files(findings, interface).groupBy(NAME)
            .agg(F.count(F.lit(1)).alias("num_of_times"))
            .orderBy(F.desc("num_of_times"), NAME))


def findings_counts(findings: DataFrame, interface: str) -> DataFrame:
    """All findings and log-like findings, one pass."""
    return findings.agg(
        F.count(F.lit(1)).alias("num_of_findings"),
        F.count_if(log_file(NAME, interface)).alias("num_of_log_findings"),
    )


def debug_error_files(findings: DataFrame, interface: str) -> DataFrame:
    """Distinct debug-named and error-named log files (one pass; the
    reference labels both outputs ``num_of_debug_logs``)."""
    lf = log_file(NAME, interface)
    return findings.agg(
        F.countDistinct(F.when(lf & name_contains_ci(NAME, "debug"), F.col(NAME))).alias("num_of_debug_logs"),
        F.countDistinct(F.when(lf & name_contains_ci(NAME, "error"), F.col(NAME))).alias("num_of_error_logs"),
    )


def ajax_log_files(ajax: DataFrame) -> DataFrame:
    """L4: distinct log files written by AJAX calls."""
    return log_files(ajax, "AJAX").select(NAME).distinct()


def normalise_urls(changes: DataFrame) -> DataFrame:
    """P5: URL without the site part for non-CLI rows, faithful and fixed."""
    cli = F.col("interface") == "WP_CLI"
    return changes.select(
        "event_id", "interface", "url",
        F.when(cli, F.col("url")).otherwise(url_faithful("url")).alias("url_faithful"),
        F.when(cli, F.col("url")).otherwise(url_fixed("url")).alias("url_fixed"),
    )


def route_changes(changes: DataFrame, *keys: str) -> DataFrame:
    """P10 + S12 shape: one routed table; CLI rows carry a ``command`` and no
    URL/method, the others a normalised URL, the HTTP method and data.

    Written with ``partitionBy("interface")`` (sinks.write_routed) the
    three warehouse tables are the three partitions, pruned on read.
    """
    cli = F.col("interface") == "WP_CLI"
    cols = [
        *keys, "plugin_slug",
        F.when(~cli, url_faithful("url")).alias("url"),
        F.when(~cli, F.col("method")).alias("http_method"),
        F.when(~cli, F.col("data")).alias("data"),
        F.when(cli, F.col("url")).alias("command"),
        NAME, "type_of_operation", "interface",
    ]
    if "zip_file_number" in changes.columns:
        cols.insert(-1, "zip_file_number")
    return changes.select(*cols)

"""Write every report of the study from a parquet warehouse.

    python -m leaklens.report [--cluster] <warehouse_root> <out_dir>

``--cluster`` fills the session's unset SQL options with
``session.CLUSTER_CONF`` (sizing for a very large warehouse).

The warehouse holds one parquet folder per table, as ``sources.sinks``
writes it (S9): plugins, rules, semgrep_runs, findings_semgrep,
ajax_routes, ajax_route_arguments, dynamic_analysis,
findings_function_hooks, and the routed change table ``findings_changes``
partitioned by interface (or the three tables findings_rest / _ajax /
_wp_cli).  Each report is written as one CSV file under ``out_dir`` (S11).
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leaklens.operators.reports import all_reports
from leaklens.session import apply_cluster_conf
from leaklens.sources import sinks

TABLES = ["plugins", "rules", "semgrep_runs", "findings_semgrep", "ajax_routes", "ajax_route_arguments",
          "dynamic_analysis", "findings_function_hooks"]
ROUTED = {"findings_rest": "REST", "findings_ajax": "AJAX", "findings_wp_cli": "WP_CLI"}
#: Reports of one row, or one per rule.
BOUNDED = {"route_counts", "argument_count", "plugin_count", "downloads_range", "installs_range", "findings_per_rule",
           "scanner_errors", "log_name_classes", "dynamic_summary", "log_path_counts", "hook_overview", "rest_findings_counts"}


def load_warehouse(spark: SparkSession, root: str) -> dict:
    w = {name: sinks.read_table(spark, f"{root}/{name}") for name in TABLES}
    routed = f"{root}/findings_changes"
    if _exists(spark, routed):
        changes = sinks.read_table(spark, routed)
        for name, iface in ROUTED.items():
            w[name] = changes.filter(F.col("interface") == iface)     # partition pruning
    else:
        for name in ROUTED:
            w[name] = sinks.read_table(spark, f"{root}/{name}")
    return w


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema   # lists the folder only
        return True
    except Exception:  # noqa: BLE001 - a missing folder raises an analysis error
        return False


def write_reports(spark: SparkSession, root: str, out_dir: str) -> list[str]:
    reports = all_reports(load_warehouse(spark, root))
    for name, df in reports.items():
        sinks.write_report_csv(df, os.path.join(out_dir, name), name in BOUNDED)
    return sorted(reports)


def main(argv: list[str]) -> None:
    cluster = "--cluster" in argv
    args = [a for a in argv if a != "--cluster"]
    if len(args) != 2:
        raise SystemExit("usage: python -m leaklens.report [--cluster] <warehouse_root> <out_dir>")
    spark = SparkSession.builder.appName("leaklens-report").getOrCreate()
    if cluster:   # large warehouses: fill unset options with the 100 TB settings
        apply_cluster_conf(spark)
    for name in write_reports(spark, args[0], args[1]):
        print(name)


if __name__ == "__main__":
    main(sys.argv[1:])

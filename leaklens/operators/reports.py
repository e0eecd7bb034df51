"""Static-analysis reports: counts, ranges, zero-filled rule counts, joins.

A1-A12, A5 with U1/U2, J1, L5.  Each function takes the warehouse
DataFrames it needs and returns a DataFrame; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaklens.functions import classify
from leaklens.functions.predicates import debug_enabling_rule, errors_without_3



def route_counts(ajax_routes: DataFrame) -> DataFrame:
    """A1: number of routes and of plugins that have routes."""
    return ajax_routes.agg(
        F.count(F.lit(1)).alias("n_routes"),
        F.countDistinct("plugin_slug").alias("n_plugins_with_routes"),
    )


def row_count(df: DataFrame, alias: str) -> DataFrame:
    """A2: plain row count (arguments, plugins)."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def value_range(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """A3/A4: max, min and ceil(avg) of a column (avg ceiling as double)."""
    return df.agg(
        F.max(col).alias(f"max_{prefix}"),
        F.min(col).alias(f"min_{prefix}"),
        F.ceil(F.avg(col)).cast("double").alias(f"avg_{prefix}"),
    )


def findings_per_rule(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """A5: findings per rule with a 0 row for every rule that never fired.

    The reference writes ``counts UNION (rules EXCEPT fired)``; that is a
    full outer join of the (partially aggregated) counts with the rule
    dimension: rules found but missing from the dimension keep their row
    (the UNION's first branch), silent rules get 0.
    """
    counts = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_findings"))
    dim = rules.select("rule_id").distinct()
    return (counts.join(dim, "rule_id", "full")
            .select("rule_id", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
            .orderBy(F.desc("n_findings"), "rule_id"))


def findings_per_rule_setops(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """The same result written with the set operators themselves."""
    counts = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_findings"))
    fired = findings.select("rule_id").distinct().select("rule_id", F.lit(0).cast("bigint").alias("n_findings"))
    silent = rules.select("rule_id", F.lit(0).cast("bigint").alias("n_findings")).subtract(fired)
    return counts.union(silent).distinct()


def debug_enabling_plugins(runs: DataFrame, findings: DataFrame, plugins: DataFrame) -> DataFrame:
    """J1 + F7: plugins whose scan found a debug-enabling rule, by downloads.

    Filter on the fact side first (pushed into the scan), then join on run
    and slug; the planner/AQE pick broadcast for a small side.
    """
    f = findings.filter(debug_enabling_rule("rule_id")).select("run_id", "rule_id")
    r = runs.select("run_id", "plugin_slug")
    p = plugins.select(F.col("slug").alias("plugin_slug"), "num_downloads")
    return (f.join(r, "run_id").join(p, "plugin_slug")
            .select("plugin_slug", "rule_id", "num_downloads")
            .orderBy(F.desc("num_downloads"), "plugin_slug", "rule_id"))


def scanner_errors(runs: DataFrame) -> DataFrame:
    """Plugins with scanner errors and their average error count."""
    return runs.filter(F.col("error_count") > 0).agg(
        F.count(F.lit(1)).alias("n_plugins_with_errors"),
        F.avg("error_count").alias("avg_errors"),
    )


def errors_not_type_3(runs: DataFrame) -> DataFrame:
    """L5 + F9: error text of runs whose errors do not mention ``3``."""
    return runs.filter(errors_without_3()).select("errors")


def log_name_classes(findings: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """A7-A11 in one pass: per classified rule, total and category counts,
    with faithful and fixed residuals."""
    rules = rules or classify.CLASSIFIED_RULES
    f = findings.filter(F.col("rule_id").isin(rules)).select("rule_id", "lines")
    counts = f.groupBy("rule_id").agg(*classify.category_columns())
    return classify.add_residuals(counts)


def dynamic_summary(dyn: DataFrame, setup_seconds: int = 60) -> DataFrame:
    """Totals, REST/AJAX success ratios (NULL when nothing was called),
    total time including a fixed set-up cost per plugin."""
    return dyn.agg(
        F.sum("num_rest_endpoints_called").alias("total_rest_called"),
        F.sum("num_rest_endpoints_http_ok").alias("total_rest_ok"),
        F.try_divide(F.sum("num_rest_endpoints_http_ok").cast("double"),
                     F.sum("num_rest_endpoints_called").cast("double")).alias("rest_success_ratio"),
        F.sum("num_ajax_endpoints_called").alias("total_ajax_called"),
        F.sum("num_ajax_endpoints_http_ok").alias("total_ajax_ok"),
        F.try_divide(F.sum("num_ajax_endpoints_http_ok").cast("double"),
                     F.sum("num_ajax_endpoints_called").cast("double")).alias("ajax_success_ratio"),
        (F.sum("time_spend") + F.count(F.lit(1)) * F.lit(setup_seconds)).alias("total_time_spent"),
    )


def plugin_classification(findings: DataFrame, runs: DataFrame, plugins: DataFrame) -> DataFrame:
    """Flagship: the A7-A11 log-name classification restricted to findings
    whose run belongs to a catalogued plugin (J1's join path), per rule,
    with the number of affected plugins.

    The scan turns each finding's text into booleans, so a finding is a few
    bytes when it meets its run, the only join of all findings (a run holds a
    few of each rule: a count before it would save nothing).  Counts per rule
    and plugin, combined map-side, then meet the catalogue.
    """
    flags = classify.category_flags()
    f = findings.filter(classify.any_rule()).select("run_id", "rule_id", *[x.alias(c) for c, x in flags.items()])
    r = runs.select("run_id", "plugin_slug")
    per_plugin = f.join(r, "run_id").groupBy("plugin_slug", "rule_id").agg(
        F.count(F.lit(1)).alias("n_total"), *[F.count_if(F.col(c)).alias(f"n_{c}") for c in flags])
    p = plugins.select(F.col("slug").alias("plugin_slug"))
    joined = per_plugin.join(p, "plugin_slug", "left_semi")
    counts = [c for c in per_plugin.columns if c.startswith("n_")]
    out = joined.groupBy("rule_id").agg(
        F.countDistinct("plugin_slug").alias("n_plugins"),
        *[F.sum(c).alias(c) for c in counts])
    return classify.add_residuals(out)


def all_reports(w: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every report of the study over one warehouse, as lazy DataFrames.

    ``w`` maps warehouse table names to DataFrames: plugins, rules,
    semgrep_runs, findings_semgrep, ajax_routes, ajax_route_arguments,
    dynamic_analysis, findings_function_hooks (params as array), and the
    routed change tables findings_rest / findings_ajax / findings_wp_cli.
    Nothing runs until a report is written or collected.
    """
    from leaklens.operators import changes, hooks

    h = hooks.with_params_text(w["findings_function_hooks"])
    rest, ajax, cli = w["findings_rest"], w["findings_ajax"], w["findings_wp_cli"]
    return {
        "route_counts": route_counts(w["ajax_routes"]),
        "argument_count": row_count(w["ajax_route_arguments"], "n_arguments"),
        "plugin_count": row_count(w["plugins"], "n_plugins"),
        "downloads_range": value_range(w["plugins"], "num_downloads", "downloads"),
        "installs_range": value_range(w["plugins"], "active_installations", "installs"),
        "findings_per_rule": findings_per_rule(w["rules"], w["findings_semgrep"]),
        "debug_enabling_plugins": debug_enabling_plugins(w["semgrep_runs"], w["findings_semgrep"], w["plugins"]),
        "scanner_errors": scanner_errors(w["semgrep_runs"]),
        "errors_not_type_3": errors_not_type_3(w["semgrep_runs"]),
        "log_name_classes": log_name_classes(w["findings_semgrep"]),
        "dynamic_summary": dynamic_summary(w["dynamic_analysis"]),
        "log_path_counts": hooks.log_path_counts(h),
        "log_path_counts_per_plugin": hooks.log_path_counts_per_plugin(h),
        "log_path_frequency": hooks.log_path_frequency(h),
        "hook_overview": hooks.hook_overview(h),
        "calls_per_function": hooks.calls_per_function(h),
        "log_paths_naming": hooks.log_paths_naming(h),
        "cli_log_files": changes.cli_log_files(cli),
        "cli_log_files_per_plugin": changes.log_files_per_plugin(cli, "WP_CLI"),
        "cli_log_file_frequency": changes.log_file_frequency(cli, "WP_CLI"),
        "rest_findings_counts": changes.findings_counts(rest, "REST"),
        "rest_log_file_frequency": changes.log_file_frequency(rest, "REST"),
        "rest_debug_error_files": changes.debug_error_files(rest, "REST"),
        "ajax_log_files": changes.ajax_log_files(ajax),
    }

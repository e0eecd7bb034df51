"""Queries over hook records and file-change findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaklens.functions.predicates import log_file_sql, log_path_sql, name_contains_ci_sql
from leaklens.operators import changes, hooks
from leaklens.plans.registry import query
from leaklens.sources.adapters import cte


def hook_table(t):
    """hook_records as the loader stores them: params array, baseline removed."""
    h = t["hook_records"].withColumn("params", F.array("path0")).drop("path0")
    return hooks.with_params_text(hooks.subtract_baseline(h, t["baseline_paths"]))


# Oracle: the stored hook table = records whose first param is not a baseline path.
_HOOKS = cte("hook_records", "baseline_paths") + """, function_hooks AS (
 SELECT event_id, plugin_slug, function, '[' || path0 || ']' AS params_text, error FROM hook_records h
 WHERE NOT EXISTS (SELECT 1 FROM baseline_paths b WHERE b.path = h.path0))
"""
_LP = log_path_sql("params_text")


@query("j3_baseline_subtraction", "J3 P16", _HOOKS + "SELECT * FROM function_hooks")
def j3(t):
    """Hook rows minus clean-instance paths, with canonical params text."""
    return hook_table(t).select("event_id", "plugin_slug", "function", "params_text", "error")


@query("a13_log_path_counts", "A13 F3",
       _HOOKS + f"SELECT count(params_text) AS n_log_paths, count(DISTINCT params_text) AS n_distinct_log_paths "
       f"FROM function_hooks WHERE {_LP}")
def a13(t):
    """Count and distinct count of log-like paths."""
    return hooks.log_path_counts(hook_table(t))


@query("a14_log_path_counts_per_plugin", "A14 F3",
       _HOOKS + f"SELECT plugin_slug, count(params_text) AS n_log_paths, count(DISTINCT params_text) AS n_distinct_log_paths "
       f"FROM function_hooks WHERE {_LP} GROUP BY plugin_slug")
def a14(t):
    """A13 per plugin."""
    return hooks.log_path_counts_per_plugin(hook_table(t))


@query("a15_log_path_frequency", "A15 F3 T4",
       _HOOKS + f"SELECT params_text AS filepath, count(*) AS num_of_times FROM function_hooks WHERE {_LP} "
       f"GROUP BY params_text")
def a15(t):
    """Frequency of each log-like path."""
    return hooks.log_path_frequency(hook_table(t))


@query("a16_hook_overview", "A16",
       _HOOKS + "SELECT count(DISTINCT function) AS n_functions, count(DISTINCT params_text) AS n_paths, "
       "count(*) AS n_hooks FROM function_hooks")
def a16(t):
    """Distinct functions, distinct paths, total hooks."""
    return hooks.hook_overview(hook_table(t))


@query("a17_calls_per_function", "A17 T4",
       _HOOKS + "SELECT function, count(*) AS total_called FROM function_hooks GROUP BY function")
def a17(t):
    """Calls per hooked function."""
    return hooks.calls_per_function(hook_table(t))


@query("a25_baseline_paths", "A25",
       cte("hook_records") + "SELECT DISTINCT path0 AS path FROM hook_records WHERE path0 IS NOT NULL")
def a25(t):
    """The sorted baseline path set from hook records."""
    h = t["hook_records"].withColumn("params", F.array("path0"))
    return hooks.baseline_paths(h)


@query("l1_distinct_log_paths", "L1 U3 F3",
       _HOOKS + f"SELECT DISTINCT params_text AS params FROM function_hooks WHERE {_LP}")
def l1(t):
    """L1: distinct log-like paths."""
    return hooks.distinct_log_paths(hook_table(t))


@query("l2_error_debug_log_paths", "L2 F10",
       _HOOKS + f""", distinct_path AS (SELECT DISTINCT params_text AS params FROM function_hooks WHERE {_LP})
SELECT params, 'error' AS word FROM distinct_path WHERE {name_contains_ci_sql('params', 'error')}
UNION ALL
SELECT params, 'debug' AS word FROM distinct_path WHERE {name_contains_ci_sql('params', 'debug')}""")
def l2(t):
    """L2: distinct log-like paths naming error or debug."""
    return hooks.log_paths_naming(hook_table(t))


# ---- change findings -------------------------------------------------------

def _lf(interface: str) -> str:
    return log_file_sql("name_of_changed_file", interface)


@query("l3_cli_log_files", "L3 F4",
       cte("findings_wp_cli") + f"SELECT plugin_slug, name_of_changed_file FROM findings_wp_cli WHERE {_lf('WP_CLI')}")
def l3(t):
    """L3: log files written by CLI commands."""
    return changes.cli_log_files(t["findings_wp_cli"])


@query("a18_cli_log_files_per_plugin", "A18 F4 T4",
       cte("findings_wp_cli") + f"SELECT plugin_slug, count(*) AS num_of_files FROM findings_wp_cli "
       f"WHERE {_lf('WP_CLI')} GROUP BY plugin_slug")
def a18(t):
    """CLI log files per plugin."""
    return changes.log_files_per_plugin(t["findings_wp_cli"], "WP_CLI")


@query("a19_cli_log_file_frequency", "A19 F4 T4",
       cte("findings_wp_cli") + f"SELECT name_of_changed_file, count(*) AS num_of_times FROM findings_wp_cli "
       f"WHERE {_lf('WP_CLI')} GROUP BY name_of_changed_file")
def a19(t):
    """CLI log-file name frequency."""
    return changes.log_file_frequency(t["findings_wp_cli"], "WP_CLI")


@query("a20_rest_log_file_frequency", "A20 F5 T4",
       cte("findings_rest") + f"SELECT name_of_changed_file, count(*) AS num_of_times FROM findings_rest "
       f"WHERE {_lf('REST')} GROUP BY name_of_changed_file")
def a20(t):
    """REST log-file name frequency."""
    return changes.log_file_frequency(t["findings_rest"], "REST")


@query("a21_rest_findings_counts", "A21 F5",
       cte("findings_rest") + f"SELECT count(*) AS num_of_findings, count(*) FILTER (WHERE {_lf('REST')}) "
       f"AS num_of_log_findings FROM findings_rest")
def a21(t):
    """REST findings, all and log-like."""
    return changes.findings_counts(t["findings_rest"], "REST")


@query("a22_rest_debug_error_files", "A22 F5 F10",
       cte("findings_rest") + f"""SELECT
 count(DISTINCT CASE WHEN {_lf('REST')} AND {name_contains_ci_sql('name_of_changed_file', 'debug')} THEN name_of_changed_file END) AS num_of_debug_logs,
 count(DISTINCT CASE WHEN {_lf('REST')} AND {name_contains_ci_sql('name_of_changed_file', 'error')} THEN name_of_changed_file END) AS num_of_error_logs
FROM findings_rest""")
def a22(t):
    """Distinct debug-named and error-named REST log files."""
    return changes.debug_error_files(t["findings_rest"], "REST")


@query("l4_ajax_log_files", "L4 F6 U3",
       cte("findings_ajax") + f"SELECT DISTINCT name_of_changed_file FROM findings_ajax WHERE {_lf('AJAX')}")
def l4(t):
    """L4: distinct log files written by AJAX calls."""
    return changes.ajax_log_files(t["findings_ajax"])


@query("p5_url_normalisation", "P5",
       cte("change_records") + """SELECT event_id, interface, url,
 CASE WHEN interface = 'WP_CLI' THEN url ELSE trim(url, 'http://localhost:8080') END AS url_faithful,
 CASE WHEN interface = 'WP_CLI' THEN url ELSE regexp_replace(url, '^http://localhost:8080', '') END AS url_fixed
FROM change_records""")
def p5(t):
    """P5: URL normalisation, faithful character-set trim and fixed prefix cut."""
    return changes.normalise_urls(t["change_records"])


@query("p10_routed_changes", "P10 P5 S12",
       cte("change_records") + """SELECT plugin_slug,
 CASE WHEN interface <> 'WP_CLI' THEN trim(url, 'http://localhost:8080') END AS url,
 CASE WHEN interface <> 'WP_CLI' THEN method END AS http_method,
 CASE WHEN interface <> 'WP_CLI' THEN data END AS data,
 CASE WHEN interface = 'WP_CLI' THEN url END AS command,
 name_of_changed_file, type_of_operation, interface
FROM change_records""")
def p10(t):
    """Change rows shaped for the three routed warehouse tables."""
    return changes.route_changes(t["change_records"])

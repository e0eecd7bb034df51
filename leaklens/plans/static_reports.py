"""Queries over the static-analysis warehouse tables (reports)."""

from __future__ import annotations

from leaklens.functions import classify
from leaklens.functions.predicates import DEBUG_ENABLING_RULES
from leaklens.operators import reports
from leaklens.plans.registry import query
from leaklens.sources.adapters import cte


@query("a1_route_counts", "A1",
       cte("ajax_routes") + "SELECT count(*) AS n_routes, count(DISTINCT plugin_slug) AS n_plugins_with_routes FROM ajax_routes")
def a1(t):
    """A1: routes and plugins with routes."""
    return reports.route_counts(t["ajax_routes"])


@query("a2_argument_count", "A2",
       cte("ajax_route_arguments") + "SELECT count(*) AS n_arguments FROM ajax_route_arguments")
def a2a(t):
    """A2: number of route arguments."""
    return reports.row_count(t["ajax_route_arguments"], "n_arguments")


@query("a2_plugin_count", "A2",
       cte("plugins") + "SELECT count(*) AS n_plugins FROM plugins")
def a2b(t):
    """A2: number of plugins."""
    return reports.row_count(t["plugins"], "n_plugins")


@query("a3_downloads_range", "A3",
       cte("plugins") + "SELECT max(num_downloads) AS max_downloads, min(num_downloads) AS min_downloads, "
       "CAST(ceil(avg(num_downloads)) AS DOUBLE) AS avg_downloads FROM plugins")
def a3(t):
    """A3: max/min/ceil(avg) downloads."""
    return reports.value_range(t["plugins"], "num_downloads", "downloads")


@query("a4_installs_range", "A4",
       cte("plugins") + "SELECT max(active_installations) AS max_installs, min(active_installations) AS min_installs, "
       "CAST(ceil(avg(active_installations)) AS DOUBLE) AS avg_installs FROM plugins")
def a4(t):
    """A4: max/min/ceil(avg) active installations."""
    return reports.value_range(t["plugins"], "active_installations", "installs")


_A5_SQL = cte("rules", "findings_semgrep") + """
(SELECT rule_id, count(*) AS n_findings FROM findings_semgrep GROUP BY rule_id)
UNION
((SELECT rule_id, 0 AS n_findings FROM rules)
 EXCEPT
 (SELECT rule_id, 0 AS n_findings FROM findings_semgrep GROUP BY rule_id))
"""


@query("a5_findings_per_rule", "A5 T4", _A5_SQL)
def a5(t):
    """A5: findings per rule, zero rows for silent rules (full outer join)."""
    return reports.findings_per_rule(t["rules"], t["findings_semgrep"])


@query("u1_u2_findings_per_rule_setops", "U1 U2 U3", _A5_SQL)
def u1u2(t):
    """The same report with UNION (distinct) and EXCEPT."""
    return reports.findings_per_rule_setops(t["rules"], t["findings_semgrep"])


_rules_in = ", ".join(f"'{r}'" for r in DEBUG_ENABLING_RULES)


@query("j1_debug_enabling_plugins", "J1 F7 T4",
       cte("semgrep_runs", "findings_semgrep", "plugins") + f"""
SELECT plugin_slug, rule_id, num_downloads
FROM semgrep_runs s JOIN findings_semgrep f ON f.run_id = s.run_id JOIN plugins p ON s.plugin_slug = p.slug
WHERE rule_id IN ({_rules_in})""")
def j1(t):
    """Runs x findings x plugins for the debug-enabling rules."""
    return reports.debug_enabling_plugins(t["semgrep_runs"], t["findings_semgrep"], t["plugins"])


@query("a6_scanner_errors", "A6",
       cte("semgrep_runs") + "SELECT count(*) AS n_plugins_with_errors, avg(error_count) AS avg_errors "
       "FROM semgrep_runs WHERE error_count > 0")
def a6(t):
    """Runs with scanner errors and their average error count."""
    return reports.scanner_errors(t["semgrep_runs"])


@query("l5_errors_not_type_3", "L5 F9",
       cte("semgrep_runs") + "SELECT errors FROM semgrep_runs WHERE error_count > 0 AND errors NOT LIKE '%3%'")
def l5(t):
    """Error texts of runs with errors that do not mention 3."""
    return reports.errors_not_type_3(t["semgrep_runs"])


def _classes_sql(rules: list[str]) -> str:
    rl = ", ".join(f"'{r}'" for r in rules)
    return (cte("findings_semgrep") + "SELECT *, " + classify.residual_sql() + " FROM (SELECT rule_id,\n "
            + classify.category_sql() + f"\nFROM findings_semgrep WHERE rule_id IN ({rl}) GROUP BY rule_id) c")


@query("a7_a11_log_name_classes", "A7 A8 A9 A10 A11 F1 F2",
       _classes_sql(classify.CLASSIFIED_RULES))
def a7_a11(t):
    """Log-name classification of all four rules in one pass."""
    return reports.log_name_classes(t["findings_semgrep"])


@query("a7_file_put_contents_classes", "A7 A11 F1 F2", _classes_sql([classify.FPC]))
def a7(t):
    """Classification for file-put-contents_."""
    return reports.log_name_classes(t["findings_semgrep"], [classify.FPC])


@query("a8_fwrite_with_fopen_classes", "A8 A11 F2", _classes_sql([classify.FWRITE]))
def a8(t):
    """Classification for fwrite_with-fopen."""
    return reports.log_name_classes(t["findings_semgrep"], [classify.FWRITE])


@query("a9_fpc_var_assignment_classes", "A9 A11 F2", _classes_sql([classify.FPC_VAR]))
def a9(t):
    """Classification for file-put-contents_log-file-var-assignment."""
    return reports.log_name_classes(t["findings_semgrep"], [classify.FPC_VAR])


@query("a10_fopen_var_assignment_classes", "A10 A11 F2", _classes_sql([classify.FOPEN_VAR]))
def a10(t):
    """A10: classification for fopen_var-assignment."""
    return reports.log_name_classes(t["findings_semgrep"], [classify.FOPEN_VAR])


@query("a12_dynamic_summary", "A12 P9",
       cte("dynamic_analysis") + """
SELECT CAST(sum(num_rest_endpoints_called) AS BIGINT) AS total_rest_called, CAST(sum(num_rest_endpoints_http_ok) AS BIGINT) AS total_rest_ok,
 CAST(sum(num_rest_endpoints_http_ok) AS DOUBLE) / NULLIF(CAST(sum(num_rest_endpoints_called) AS DOUBLE), 0) AS rest_success_ratio,
 CAST(sum(num_ajax_endpoints_called) AS BIGINT) AS total_ajax_called, CAST(sum(num_ajax_endpoints_http_ok) AS BIGINT) AS total_ajax_ok,
 CAST(sum(num_ajax_endpoints_http_ok) AS DOUBLE) / NULLIF(CAST(sum(num_ajax_endpoints_called) AS DOUBLE), 0) AS ajax_success_ratio,
 sum(time_spend) + count(*) * 60 AS total_time_spent
FROM dynamic_analysis""")
def a12(t):
    """Dynamic-analysis summary row."""
    return reports.dynamic_summary(t["dynamic_analysis"])


@query("flagship_plugin_log_classes", "J1 A7 A8 A9 A10 A11",
       cte("findings_semgrep", "semgrep_runs", "plugins") + "SELECT *, " + classify.residual_sql()
       + " FROM (SELECT f.rule_id AS rule_id, count(DISTINCT s.plugin_slug) AS n_plugins,\n "
       + classify.category_sql("f.rule_id", "f.lines")
       + "\nFROM findings_semgrep f JOIN semgrep_runs s ON f.run_id = s.run_id JOIN plugins p ON s.plugin_slug = p.slug "
       + "WHERE f.rule_id IN (" + ", ".join(f"'{r}'" for r in classify.CLASSIFIED_RULES) + ") GROUP BY f.rule_id) c")
def flagship(t):
    """Flagship: classification of findings of catalogued plugins, per rule."""
    return reports.plugin_classification(t["findings_semgrep"], t["semgrep_runs"], t["plugins"])

"""Filter predicates F1-F13 as reusable Columns, each with its oracle SQL text.

Every predicate is a pure Column expression (JVM side, codegen'd, pushed
into the scan's filter where the optimiser can).  The ``*_sql`` twins build
the DuckDB text from the same lists so both engines test the same thing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leaklens.functions.regex import (
    full_match,
    like_none,
    sql_like_none,
    sql_str,
)

# ---------------------------------------------------------------------------
# Fixed values (as the reference's reports define them; order as written there)
# ---------------------------------------------------------------------------

# exclusions of the log-path test on hooked params (case-sensitive LIKE).
LOG_PATH_EXCLUDE = [
    "%logo%", "%login%", "%logged%", "%blog%", "%dialog%", "%.php]", "%.html%",
    "%.pid%", "%benchmark-log-plugin%", "%.css%", "%.js%", "%monolog%",
]

# written-log-file test, CLI variant.
LOG_FILE_EXCLUDE_CLI = [
    "%.htaccess", "%.php", "%.png", "%.svg", "%.jpg", "%.scss", "%.js", "%.html",
    "%.css", "%.webp", "%CHANGELOG%",
]
# REST variant (no .webp exclusion).
LOG_FILE_EXCLUDE_REST = [
    "%.htaccess", "%.php", "%.png", "%.svg", "%.jpg", "%.scss", "%.js", "%.html",
    "%.css", "%CHANGELOG%",
]
# AJAX variant (REST + temp-write-test).
LOG_FILE_EXCLUDE_AJAX = LOG_FILE_EXCLUDE_REST + ["%temp-write-test%"]

LOG_FILE_EXCLUDE = {
    "WP_CLI": LOG_FILE_EXCLUDE_CLI,
    "REST": LOG_FILE_EXCLUDE_REST,
    "AJAX": LOG_FILE_EXCLUDE_AJAX,
}
LOG_NAME_PATTERN = "(?si).*log.*"

# the two debug-enabling rules.
DEBUG_ENABLING_RULES = ["WP-DEBUG-LOG_enabling", "WP-DEBUG_enabling"]

# F8: WordPress' own REST namespaces, skipped by the runner.
STANDARD_NAMESPACES = ["wp/v2", "oembed/1.0", "wp-site-health/v1", "wp-block-editor/v1"]

# the line the runner prints at the end of a run.
FINISHED_MARKER = "Dynamic Analysis Finished"

# allowed severities.
SEVERITIES = ["INFO", "ERROR", "WARNING"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# F1 is the LIKE disjunction used by the classification (see classify.py).

# full match -> functions.regex.full_match


def log_path(params_text: Column | str) -> Column:
    """hooked params text names a log-like path."""
    c = _c(params_text)
    return c.like("%log%") & like_none(c, LOG_PATH_EXCLUDE)


def log_path_sql(expr: str = "params") -> str:
    return f"({expr} LIKE '%log%' AND {sql_like_none(expr, LOG_PATH_EXCLUDE)})"


def log_file(name: Column | str, interface: str) -> Column:
    """a changed file that looks like a written log file."""
    c = _c(name)
    return full_match(c, LOG_NAME_PATTERN) & like_none(c, LOG_FILE_EXCLUDE[interface])


def log_file_sql(expr: str, interface: str) -> str:
    return (f"({expr} SIMILAR TO {sql_str(LOG_NAME_PATTERN)} AND "
            f"{sql_like_none(expr, LOG_FILE_EXCLUDE[interface])})")


def debug_enabling_rule(rule_id: Column | str = "rule_id") -> Column:
    """F7."""
    return _c(rule_id).isin(DEBUG_ENABLING_RULES)


def non_default_namespace(ns: Column | str = "namespace") -> Column:
    """F8."""
    return ~_c(ns).isin(STANDARD_NAMESPACES)


def errors_without_3(error_count: Column | str = "error_count",
                     errors: Column | str = "errors") -> Column:
    """runs with errors whose text lacks a ``3``."""
    return (_c(error_count) > 0) & ~_c(errors).like("%3%")


def name_contains_ci(name: Column | str, word: str) -> Column:
    """case-insensitive contains, without dot-all (a newline blocks it)."""
    return full_match(name, f"(?i).*{word}.*")


def name_contains_ci_sql(expr: str, word: str) -> str:
    return f"{expr} SIMILAR TO {sql_str(f'(?i).*{word}.*')}"


def is_closure(text: Column | str) -> Column:
    """closure guard - text starts with ``function``."""
    return _c(text).startswith("function")


def finished_line(line: Column | str = "line") -> Column:
    """F12."""
    return _c(line).contains(FINISHED_MARKER)


def valid_severity(sev: Column | str = "severity") -> Column:
    """F13."""
    return _c(sev).isin(SEVERITIES)

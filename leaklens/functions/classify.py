"""Log-name classification of scanner findings.

For four sink rules the report sorts each finding's code snippet
(``lines``) into overlapping categories: error, debug, securing, htaccess,
name-from-variable; the residual is total minus categories.  All categories
of all rules are counted in ONE aggregation pass (``count_if`` per
category), instead of one scan per category and rule.

Counts of categories are ``count(lines)`` in the reference, i.e. NULL lines
never count; ``count_if`` of a NULL predicate does the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leaklens.functions.regex import (
    any_full_match,
    like_any,
    sql_like_any,
    sql_similar_any,
)

# ---------------------------------------------------------------------------
# Keyword sets and patterns exactly as the reference's report
# writes them (its order).  E = error keywords, G = debug keywords.
# ---------------------------------------------------------------------------
E = ["error", "fail", "exception", "fatal"]
G = ["debug", "dev", "trace", "verbose", "diagnostic"]

FPC = "file-put-contents_"
FWRITE = "fwrite_with-fopen"
FPC_VAR = "file-put-contents_log-file-var-assignment"
FOPEN_VAR = "fopen_var-assignment"
CLASSIFIED_RULES = [FPC, FWRITE, FPC_VAR, FOPEN_VAR]

# category -> (kind, patterns); kind "like" = LIKE disjunction (F1),
# "similar" = SIMILAR TO disjunction (F2).
RULE_CATEGORIES: dict[str, dict[str, tuple[str, list[str]]]] = {
    FPC: {
        "error": ("like", [f"%file_put_contents(%{k}%,%" for k in E]),
        "debug": ("like", [f"%file_put_contents(%{k}%,%" for k in G]),
        "securing": ("similar", [
            r"(?s).*file_put_contents\([^,]*htaccess\(.*",
            r"(?s).*file_put_contents\([^,]*/tmp/\(.*",
            r"(?s).*file_put_contents\([^,]*sys_get_temp_dir()\(.*",
            r"(?s).*file_put_contents\([^,]*time\(.*",
            r"(?s).*file_put_contents\([^,]*date\(.*",
            r"(?s).*file_put_contents\([^,]*md5\(.*",
        ]),
        "htaccess": ("similar", [r"(?s).*file_put_contents\(.*htaccess.*"]),
        "from_variable": ("similar", [r"(?s).*file_put_contents\([^,\.]*\$.*"]),
    },
    FWRITE: {
        "error": ("similar", [rf"(?i).*fopen\(.*{k}(?s).*" for k in E]),
        "debug": ("similar", [rf"(?i).*fopen\(.*{k}(?s).*" for k in G]),
        "securing": ("similar", [
            r"(?s).*fopen\([^,]*/tmp/\(.*",
            r"(?s).*fopen\([^,]*sys_get_temp_dir()\(.*",
            r"(?s).*fopen\([^,]*time\(.*",
            r"(?s).*fopen\([^,]*date\(.*",
            r"(?s).*fopen\([^,]*md5\(.*",
        ]),
        "htaccess": ("similar", [r"(?s).*fopen\(.*htaccess.*"]),
        "from_variable": ("similar", [r"(?s).*fopen\(.?\$.*"]),
    },
    FPC_VAR: {
        "error": ("similar", [rf"(?i).*{k}(?s).*" for k in E]),
        "debug": ("similar", [r"(?i).*debug(?s).*"]),
        "securing": ("similar", [
            r".*/tmp/(?s).*",
            r".*sys_get_temp_dir\((?s).*",
            r".*time\((?s).*",
            r".*date\((?s).*",
            r".*md5\((?s).*",
        ]),
        "htaccess": ("similar", [r".*htaccess(?s).*"]),
        "from_variable": ("similar", [r".*\$.*=.*\$(?s).*"]),
    },
    FOPEN_VAR: {
        "error": ("similar", [rf"(?i).*{k}(?s).*" for k in E]),
        "debug": ("similar", [rf"(?i).*{k}(?s).*" for k in G]),
        "securing": ("similar", [
            r"(?s).*fopen\([^,]*/tmp/\(.*",
            r"(?s).*fopen\([^,]*sys_get_temp_dir()\(.*",
            r"(?s).*fopen\([^,]*time\(.*",
            r"(?s).*fopen\([^,]*date\(.*",
            r"(?s).*fopen\([^,]*md5\(.*",
        ]),
        "htaccess": ("similar", [r"(?i).*htaccess(?s).*"]),
        "from_variable": ("similar", [r".*\$.*=.*\$(?s).*"]),
    },
}

CATEGORIES = ["error", "debug", "securing", "htaccess", "from_variable"]


def _fixed_securing(patterns: list[str]) -> list[str]:
    # ``/tmp/\(`` and ``htaccess\(`` need a literal bracket after the word and
    # practically never match; the fixed variant drops the bracket.
    return [p.replace(r"/tmp/\(", "/tmp/").replace(r"htaccess\(", "htaccess") for p in patterns]


def _pred(col: Column, kind: str, patterns: list[str]) -> Column:
    return like_any(col, patterns) if kind == "like" else any_full_match(col, patterns)


def _pred_sql(expr: str, kind: str, patterns: list[str]) -> str:
    return sql_like_any(expr, patterns) if kind == "like" else sql_similar_any(expr, patterns)


def category_flags(rule_col: str = "rule_id", lines_col: str = "lines") -> dict[str, Column]:
    """Category name -> predicate over rows of the 4 rules.

    Each category predicate is dispatched by rule with a CASE, so one
    pass over the rows tells everything.  Faithful and fixed variants
    differ only where the reference is clearly mistaken:

    * htaccess of ``file-put-contents_`` queries a misspelt rule id -> 0;
    * securing of every rule: fixed drops the literal bracket;
    * the residual of ``file-put-contents_log-file-var-assignment``
      subtracts error twice and debug never.
    """
    rule = F.col(rule_col)
    lines = F.col(lines_col)

    def per_rule(cat: str, fixed: bool = False) -> Column:
        expr = None
        for r, cats in RULE_CATEGORIES.items():
            kind, pats = cats[cat]
            if cat == "securing" and fixed:
                pats = _fixed_securing(pats)
            if cat == "htaccess" and r == FPC and not fixed:
                pred = F.lit(False)
            else:
                pred = _pred(lines, kind, pats)
            expr = F.when(rule == r, pred) if expr is None else expr.when(rule == r, pred)
        return expr

    flags = {cat: per_rule(cat) for cat in CATEGORIES}
    return flags | {f"{cat}_fixed": per_rule(cat, fixed=True) for cat in ("htaccess", "securing")}


def category_columns(rule_col: str = "rule_id", lines_col: str = "lines") -> list[Column]:
    """Aggregate columns ``n_total`` and ``n_<category>`` over rows of the 4 rules."""
    return [F.count(F.lit(1)).alias("n_total"),
            *[F.count_if(flag).alias(f"n_{cat}") for cat, flag in category_flags(rule_col, lines_col).items()]]


def add_residuals(df, rule_col: str = "rule_id"):
    """Residual ("other / access") columns on the per-rule counts row."""
    rule = F.col(rule_col)
    t, e, d, h = (F.col(c) for c in ("n_total", "n_error", "n_debug", "n_htaccess"))
    faithful = F.when(rule == FPC_VAR, t - e - e - h).otherwise(t - e - d - h)
    fixed = t - e - d - F.col("n_htaccess_fixed")
    return df.withColumn("n_other", faithful).withColumn("n_other_fixed", fixed)


# ---- oracle text ----------------------------------------------------------

def category_sql(rule_expr: str = "rule_id", lines_expr: str = "lines") -> str:
    def per_rule(cat: str, fixed: bool = False) -> str:
        whens = []
        for r, cats in RULE_CATEGORIES.items():
            kind, pats = cats[cat]
            if cat == "securing" and fixed:
                pats = _fixed_securing(pats)
            if cat == "htaccess" and r == FPC and not fixed:
                pred = "FALSE"
            else:
                pred = _pred_sql(lines_expr, kind, pats)
            whens.append(f"WHEN {rule_expr} = '{r}' THEN {pred}")
        return "CASE " + " ".join(whens) + " END"

    parts = ["count(*) AS n_total"]
    for cat in CATEGORIES:
        parts.append(f"count(*) FILTER (WHERE {per_rule(cat)}) AS n_{cat}")
    parts.append(f"count(*) FILTER (WHERE {per_rule('htaccess', True)}) AS n_htaccess_fixed")
    parts.append(f"count(*) FILTER (WHERE {per_rule('securing', True)}) AS n_securing_fixed")
    return ",\n ".join(parts)


def residual_sql(rule_expr: str = "rule_id") -> str:
    return (f"CASE WHEN {rule_expr} = '{FPC_VAR}' THEN n_total - n_error - n_error - n_htaccess "
            f"ELSE n_total - n_error - n_debug - n_htaccess END AS n_other, "
            f"n_total - n_error - n_debug - n_htaccess_fixed AS n_other_fixed")


def any_rule(rule_col: str = "rule_id") -> Column:
    return reduce(lambda a, b: a | b, [F.col(rule_col) == r for r in CLASSIFIED_RULES])

"""Queries over plugin source text: findings, routes, arguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaklens.functions import classify
from leaklens.functions.regex import sql_str
from leaklens.functions.scalar import request_args
from leaklens.operators import reports, routes, static_scan
from leaklens.operators.static_scan import ASSIGN_RE, LINE_RULES, QUALIFY, USE_RE, VAR_RULES, WS
from leaklens.plans.registry import query
from leaklens.sources.adapters import cte


def php_files(t):
    """The scanned source tree (php only, vendor/tests excluded)."""
    return static_scan.php_sources(t["source_files"])


# ---- oracle building blocks --------------------------------------------------

_F = cte("source_files") + """, f AS (
 SELECT path, content, regexp_extract(path, '^plugins/([^/]+)/', 1) AS plugin_slug FROM source_files
 WHERE path LIKE '%.php' AND NOT regexp_matches(path, '/(vendor|tests)/'))
, l AS (SELECT path, plugin_slug, unnest(string_split(content, chr(10))) AS line,
 CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line_no FROM f)
"""


def _line_hits_sql() -> str:
    parts = []
    for rid, (kind, expr) in LINE_RULES.items():
        pred = f"contains(line, {sql_str(expr)})" if kind == "contains" else f"regexp_matches(line, {sql_str(expr)})"
        parts.append(f"SELECT '{rid}' AS rule_id, plugin_slug, path, line_no, line FROM l WHERE {pred}")
    return (", hits AS (" + "\n UNION ALL ".join(parts) + ")\n"
            ", line_findings AS (SELECT rule_id, plugin_slug, replace(path, 'plugins/', '') AS file_path, "
            "line_no AS start_line, line_no AS end_line, line AS lines FROM hits)\n")


def _var_sql() -> str:
    fpc_like = [s for s, (_, q) in VAR_RULES.items() if q == "log"]
    rule_case = "CASE m.sink " + " ".join(f"WHEN '{s}' THEN '{r}'" for s, (r, _) in VAR_RULES.items()) + " END"
    return f""", a AS (SELECT path, plugin_slug, line_no, line, regexp_extract(line, {sql_str(ASSIGN_RE)}, 1) AS var,
 regexp_extract(line, {sql_str(ASSIGN_RE)}, 2) AS expr FROM l WHERE regexp_matches(line, {sql_str(ASSIGN_RE)}))
, u AS (SELECT path, plugin_slug, line_no, line, regexp_extract(line, {sql_str(USE_RE)}, 2) AS var,
 regexp_extract(line, {sql_str(USE_RE)}, 1) AS sink FROM l WHERE regexp_matches(line, {sql_str(USE_RE)}))
, m AS (SELECT u.path, u.plugin_slug, u.line_no, u.line, u.sink, max(a.line_no) AS aline
 FROM u JOIN a ON a.path = u.path AND a.var = u.var AND a.line_no < u.line_no
 AND (CASE WHEN u.sink IN ({", ".join(sql_str(s) for s in fpc_like)}) THEN regexp_matches(a.expr, {sql_str(QUALIFY['log'])})
      ELSE regexp_matches(a.expr, {sql_str(QUALIFY['fopen_log'])}) END)
 GROUP BY u.path, u.plugin_slug, u.line_no, u.line, u.sink)
, var_findings AS (SELECT {rule_case} AS rule_id, m.plugin_slug, replace(m.path, 'plugins/', '') AS file_path,
 m.aline AS start_line, m.line_no AS end_line, a.line || chr(10) || m.line AS lines
 FROM m JOIN a ON a.path = m.path AND a.line_no = m.aline)
"""


@query("d1_d10_line_rule_findings", "S8 D1 D7 D8 D9 D10 P4", _F + _line_hits_sql() + "SELECT * FROM line_findings")
def line_rules(t):
    """Line rules over the scanned tree, one pass."""
    return static_scan.line_rule_findings(static_scan.source_lines(php_files(t)))


@query("j6_d2_d6_var_assignment_findings", "J6 D2 D3 D4 D5 D6", _F + _var_sql() + "SELECT * FROM var_findings")
def var_rules(t):
    """D2-D6 via J6: assignment before use of the same variable."""
    return static_scan.var_rule_findings(static_scan.source_lines(php_files(t)))


@query("s8_scan_all_rules", "S8 D1 D2 D3 D4 D5 D6 D7 D8 D9 D10 J6",
       _F + _line_hits_sql() + _var_sql() + "SELECT * FROM line_findings UNION ALL SELECT * FROM var_findings")
def scan_all(t):
    """All ten scanner rules over the source tree in one scan of the text."""
    return static_scan.scan_sources(t["source_files"])


_MESSAGE = "CASE rule_id " + " ".join(f"WHEN {sql_str(r)} THEN {sql_str(m)}" for r, m in static_scan.MESSAGES.items()) + " END"
_SCAN_TABLES = _F + _line_hits_sql() + _var_sql() + f""", runs AS (
 SELECT row_number() OVER (ORDER BY plugin_slug) - 1 AS run_id, plugin_slug FROM (SELECT DISTINCT plugin_slug FROM f))
, scanned AS (SELECT row_number() OVER (ORDER BY run_id, file_path, start_line, end_line, rule_id, lines) - 1 AS finding_id,
 run_id, rule_id, file_path, start_line, end_line, {_MESSAGE} AS message, lines
 FROM (SELECT * FROM line_findings UNION ALL SELECT * FROM var_findings) JOIN runs USING (plugin_slug))
"""


@query("s8_s9_scan_tables", "S8 S9 W3 D1 D2 D3 D4 D5 D6 D7 D8 D9 D10 J6", _SCAN_TABLES + "SELECT * FROM scanned")
def scan_tables(t):
    """The scan of the source tree as the warehouse's findings: ids, runs and messages."""
    return static_scan.scan_tables(t["source_files"])[1]


@query("flagship_scanned_sources", "J1 A7 A8 A9 A10 A11 S8",
       _SCAN_TABLES + "SELECT *, " + classify.residual_sql()
       + " FROM (SELECT rule_id, count(DISTINCT run_id) AS n_plugins,\n " + classify.category_sql()
       + "\nFROM scanned WHERE rule_id IN (" + ", ".join(f"'{r}'" for r in classify.CLASSIFIED_RULES) + ") GROUP BY rule_id) c")
def flagship_scanned(t):
    """The flagship's classification of what the scan of the source tree finds,
    per rule, over the plugins that were scanned."""
    runs, findings = static_scan.scan_tables(t["source_files"])
    return reports.plugin_classification(findings, runs, runs.select(F.col("plugin_slug").alias("slug")))


# ---- routes ------------------------------------------------------------------

_CB = sql_str(routes.CALLBACK_RE)
_HEAD = routes.FUNC_HEAD_RE
_P8_CB = """trim(hook, '''".') AS h"""
_ROUTES = f""", regs AS (SELECT plugin_slug, path, unnest(regexp_extract_all(content, {_CB}, 1)) AS hook,
 unnest(regexp_extract_all(content, {_CB}, 2)) AS callback, generate_subscripts(regexp_extract_all(content, {_CB}, 1), 1) AS n FROM f)
, lastreg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plugin_slug, hook ORDER BY path DESC, n DESC) AS rn FROM regs) WHERE rn = 1)
, rt AS (SELECT plugin_slug, hook, callback,
 CASE WHEN starts_with(h, 'wp_ajax_nopriv_') THEN regexp_replace(h, '^wp_ajax_nopriv_', '')
      WHEN starts_with(h, 'wp_ajax_') THEN regexp_replace(h, '^wp_ajax_', '') END AS action,
 CASE WHEN starts_with(h, 'wp_ajax_nopriv_') THEN false WHEN starts_with(h, 'wp_ajax_') THEN true END AS priv
 FROM (SELECT *, {_P8_CB} FROM lastreg))
"""

# P14 for RE2 (no back-reference): alternation of the two quote styles.
_P14 = sql_str(r"""\$_(REQUEST|POST|FILES|GET)""" + WS + r"""*\[""" + WS
               + r"""*('([^'"]+)'|"([^'"]+)")""" + WS + r"""*\]""")


@query("d11_w4_p8_callback_routes", "D11 W4 P8 S8", _F + _ROUTES + "SELECT * FROM rt")
def d11(t):
    """Named-callback AJAX routes, last registration per hook wins."""
    return routes.callback_routes(php_files(t))


# Second arguments: tokens numbered, bracket depth as a running sum.  RE2 has no
# possessive repeats; the tokens are the same without them.
_REG = routes.REG_HEAD_RE
_TOKEN = sql_str(routes.TOKEN_RE.replace("*+", "*").replace("++", "+"))
_SECOND_ARGS = f""", pcs AS (SELECT plugin_slug, path, string_split(regexp_replace(content, {sql_str('(' + _REG + ')')}, chr(1) || '\\1', 'g'), chr(1)) AS p
 FROM f WHERE regexp_matches(content, {sql_str(_REG)}))
, tails AS (SELECT plugin_slug, path, n, array_to_string(p[n:], '') AS tail FROM (SELECT *, unnest(generate_series(1, len(p))) AS n FROM pcs))
, heads AS (SELECT plugin_slug, path, n, regexp_extract(tail, {sql_str('^' + _REG)}, 1) AS hook, regexp_replace(tail, {sql_str('^' + _REG)}, '') AS rest
 FROM tails WHERE regexp_matches(tail, {sql_str('^' + _REG)}))
, toks AS (SELECT plugin_slug, path, n, hook, unnest(t) AS tok, generate_subscripts(t, 1) AS i
 FROM (SELECT *, regexp_extract_all(rest, {_TOKEN}) AS t FROM heads))
, deep AS (SELECT *, coalesce(sum(CASE WHEN tok IN ('(', '{{', '[') THEN 1 WHEN tok IN (')', '}}', ']') THEN -1 ELSE 0 END)
 OVER (PARTITION BY path, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM toks)
, ends AS (SELECT path, n, min(i) AS stop FROM deep WHERE depth = 0 AND tok IN (',', ')') GROUP BY path, n)
, regs AS (SELECT deep.plugin_slug, deep.path, deep.hook, deep.n,
 regexp_replace(coalesce(string_agg(tok, '' ORDER BY i) FILTER (WHERE i < stop), ''), {sql_str(WS + '+$')}, '') AS closure
 FROM deep JOIN ends ON ends.path = deep.path AND ends.n = deep.n GROUP BY ALL)
"""


@query("d12_f11_closure_routes", "D12 F11 P8 P14",
       _F + _SECOND_ARGS + f""", lastreg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plugin_slug, hook ORDER BY path DESC, n DESC) AS rn FROM regs) WHERE rn = 1)
, c AS (SELECT plugin_slug, hook, closure, replace(trim(hook, '''"'), 'wp_ajax_', '') AS a0 FROM lastreg WHERE starts_with(closure, 'function'))
SELECT plugin_slug, hook, CASE WHEN starts_with(a0, 'nopriv_') THEN replace(a0, 'nopriv_', '') ELSE a0 END AS action,
 NOT starts_with(a0, 'nopriv_') AS priv, n_args FROM (SELECT *, CAST(len(regexp_extract_all(closure, {_P14}, 1)) AS INTEGER) AS n_args FROM c)""")
def d12(t):
    """Closure AJAX routes and how many request arguments they read."""
    return routes.closure_routes(php_files(t)).select(
        "plugin_slug", "hook", "action", "priv", F.size("args").alias("n_args"))


@query("d12_w4_second_arguments", "D12 W4 F11 P8",
       _F + _SECOND_ARGS + """, lastreg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plugin_slug, hook ORDER BY path DESC, n DESC) AS rn FROM regs) WHERE rn = 1)
, c AS (SELECT plugin_slug, hook, closure, replace(trim(hook, '''"'), 'wp_ajax_', '') AS a0 FROM lastreg)
SELECT plugin_slug, hook, closure, CASE WHEN starts_with(a0, 'nopriv_') THEN replace(a0, 'nopriv_', '') ELSE a0 END AS action,
 NOT starts_with(a0, 'nopriv_') AS priv, starts_with(closure, 'function') AS is_closure FROM c""")
def d12_all(t):
    """D12 before F11: every route registration's second argument (last per
    hook), with the closure flag and the closure-branch (action, priv)."""
    return routes.second_arguments(php_files(t))


_FN = f""", fn AS (SELECT plugin_slug, path, seg AS body, regexp_extract(seg, {sql_str('^' + _HEAD)}, 1) AS fname FROM (
 SELECT plugin_slug, path, unnest(string_split(regexp_replace(content, {sql_str('(' + _HEAD + ')')}, chr(1) || '\\1', 'g'), chr(1))) AS seg FROM f)
 WHERE regexp_matches(seg, {sql_str('^' + _HEAD)}))
"""


def _d13_sql(faithful: bool) -> str:
    cond = ("CASE WHEN regexp_matches(rt.callback, '[\\\\.^$|?*+()\\[\\]{}]') THEN regexp_matches(fn.fname, '^' || rt.callback) "
            "ELSE starts_with(fn.fname, rt.callback) END") if faithful else "fn.fname = rt.callback"
    return (_F + _ROUTES + _FN + f""", mt AS (SELECT rt.plugin_slug, rt.action, rt.priv, rt.callback, fn.fname, fn.body
 FROM rt JOIN fn ON fn.plugin_slug = rt.plugin_slug AND {cond})
SELECT plugin_slug, action, priv, callback, fname, method, coalesce(a1, a2) AS arg FROM (
 SELECT plugin_slug, action, priv, callback, fname, unnest(regexp_extract_all(body, {_P14}, 1)) AS method,
  unnest(regexp_extract_all(body, {_P14}, 3)) AS a1, unnest(regexp_extract_all(body, {_P14}, 4)) AS a2 FROM mt)""")


@query("d13_j9_callback_arguments", "D13 J9 P14", _d13_sql(True))
def d13(t):
    """D13/J9 faithful: arguments of functions whose name starts with the callback."""
    return routes.callback_arguments(php_files(t), faithful=True)


@query("d13_j9_callback_arguments_fixed", "D13 J9 P14", _d13_sql(False))
def d13_fixed(t):
    """D13/J9 fixed: arguments of the function named exactly like the callback."""
    return routes.callback_arguments(php_files(t), faithful=False)


@query("p14_request_arguments", "P14 S8",
       _F + f"""SELECT path, method, coalesce(a1, a2) AS arg FROM (
 SELECT path, unnest(regexp_extract_all(content, {_P14}, 1)) AS method,
 unnest(regexp_extract_all(content, {_P14}, 3)) AS a1, unnest(regexp_extract_all(content, {_P14}, 4)) AS a2 FROM f)""")
def p14(t):
    """Every $_POST/$_GET/$_REQUEST/$_FILES['x'] read in the scanned tree."""
    return (php_files(t).select("path", F.explode(request_args("content")).alias("a"))
            .select("path", F.col("a.method").alias("method"), F.col("a.arg").alias("arg")))


@query("j4_u6_route_argument_lookup", "J4 U6 W3 D13",
       _d13_sql(True).replace("SELECT plugin_slug, action, priv, callback, fname, method, coalesce(a1, a2) AS arg FROM (",
                              "SELECT DISTINCT plugin_slug, action, priv, method, coalesce(a1, a2) AS arg_name FROM (", 1))
def j4(t):
    """Argument rows keyed to their route (smallest id per key), deduplicated."""
    files = php_files(t)
    rts = routes.route_ids(routes.callback_routes(files))
    args = routes.callback_arguments(files, faithful=True)
    ok, _bad = routes.lookup_routes(args, rts)
    return ok.join(rts, "route_id").select("plugin_slug", "action", "priv", "method", "arg_name")


@query("p8_w4_hook_names", "P8 W4",
       cte("hook_names") + """, lastreg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug, hook ORDER BY pos DESC) AS rn
 FROM hook_names) WHERE rn = 1)
, x AS (SELECT slug, hook, callback, trim(hook, '''".') AS h, replace(trim(hook, '''"'), 'wp_ajax_', '') AS a0 FROM lastreg)
SELECT slug, hook, callback,
 CASE WHEN starts_with(h, 'wp_ajax_nopriv_') THEN regexp_replace(h, '^wp_ajax_nopriv_', '')
      WHEN starts_with(h, 'wp_ajax_') THEN regexp_replace(h, '^wp_ajax_', '') END AS action,
 CASE WHEN starts_with(h, 'wp_ajax_nopriv_') THEN false WHEN starts_with(h, 'wp_ajax_') THEN true END AS priv,
 CASE WHEN starts_with(a0, 'nopriv_') THEN replace(a0, 'nopriv_', '') ELSE a0 END AS closure_action,
 NOT starts_with(a0, 'nopriv_') AS closure_priv
FROM x""")
def p8w4(t):
    """P8+W4: last callback per (plugin, hook); hook -> (action, priv) in both
    of the reference's branches (callback: first prefix only; closure: all)."""
    from leaklens.functions.scalar import hook_to_route_callback, hook_to_route_closure

    last = routes.last_per_hook(t["hook_names"], ["pos"], ["callback"], key=["slug", "hook"])
    a1, p1 = hook_to_route_callback("hook")
    a2, p2 = hook_to_route_closure("hook")
    return last.select("slug", "hook", "callback", a1.alias("action"), p1.alias("priv"),
                       a2.alias("closure_action"), p2.alias("closure_priv"))

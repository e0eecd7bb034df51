"""Queries for the dynamic runner's case matrices, coverage and attempt metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaklens.functions import scalar
from leaklens.functions.predicates import STANDARD_NAMESPACES, non_default_namespace
from leaklens.functions.regex import sql_str
from leaklens.operators import matrix
from leaklens.plans.registry import query
from leaklens.session import scratch_path
from leaklens.sources.adapters import cte

NOW = "2024-01-01T00:00:00"  # the runner's clock, fixed for reproducible runs

_J5 = cte("ajax_routes", "ajax_route_arguments") + """, j5 AS (
 SELECT r.route_id, r.plugin_slug, r.action, a.method, a.arg_name FROM ajax_routes r LEFT JOIN ajax_route_arguments a ON a.route_id = r.route_id)
"""
_TPL = "(VALUES " + ", ".join(f"({sql_str(sfx)}, {sql_str(v)})" for sfx in matrix.AJAX_KEY_SUFFIXES
                              for v in matrix.AJAX_VALUES) + ") AS tpl(suffix, value)"
_M1 = _J5 + f""", m1 AS (
SELECT route_id, plugin_slug, method, arg_name || suffix AS payload_key, value AS payload_value, 'arg' AS case_kind
 FROM j5 CROSS JOIN {_TPL} WHERE arg_name IS NOT NULL
UNION ALL
SELECT route_id, plugin_slug, m AS method, '*' AS payload_key, {sql_str(matrix.string.printable)} AS payload_value, 'all' AS case_kind
 FROM (SELECT DISTINCT route_id, plugin_slug FROM j5 WHERE arg_name IS NOT NULL) CROSS JOIN (VALUES ('POST'), ('GET')) AS v(m)
UNION ALL
SELECT route_id, plugin_slug, 'POST', 'action', action, 'plain' FROM j5 WHERE arg_name IS NULL)
"""


def _routes(t):
    return t["ajax_routes"], t["ajax_route_arguments"]


@query("j5_routes_with_arguments", "J5", _J5 + "SELECT route_id, plugin_slug, action, priv, method, arg_name FROM j5 "
       "JOIN (SELECT route_id AS rid, priv FROM ajax_routes) p ON p.rid = j5.route_id")
def j5(t):
    """Routes with their arguments; routes without arguments kept."""
    r, a = _routes(t)
    return matrix.routes_with_arguments(r, a).select("route_id", "plugin_slug", "action", "priv", "method", "arg_name")


@query("m1_j8_ajax_case_matrix", "M1 J8 J5", _M1 + "SELECT * FROM m1")
def m1(t):
    """The AJAX case matrix (12 payloads per argument, 2 combined per
    route with arguments, 1 plain call per route without)."""
    r, a = _routes(t)
    return matrix.ajax_cases(r, a)


@query("m3_ajax_coverage", "M3 M1",
       _M1 + cte("http_attempts").replace("WITH ", ", ", 1) + f"""
SELECT e.plugin_slug, e.expected_calls, coalesce(a.n, 0) AS attempted_calls FROM
 (SELECT plugin_slug, count(*) * {matrix.CALLS_PER_AJAX_CASE} AS expected_calls FROM m1 GROUP BY plugin_slug) e
 LEFT JOIN (SELECT plugin_slug, count(*) AS n FROM http_attempts WHERE interface = 'AJAX' GROUP BY plugin_slug) a
 ON a.plugin_slug = e.plugin_slug""")
def m3(t):
    """M3: expected AJAX calls per plugin vs calls attempted."""
    r, a = _routes(t)
    return matrix.coverage(matrix.ajax_cases(r, a), t["http_attempts"])


def _valid_sql(t: str = "type", f: str = "format") -> str:
    fmt = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in scalar.FORMAT_SAMPLES.items())
    types = " ".join(f"WHEN {t} = {sql_str(k)} THEN {sql_str(v)}" for k, v in scalar.VALID_BY_TYPE.items())
    return (f"CASE WHEN {t} = 'string' THEN (CASE WHEN {f} IS NOT NULL THEN (CASE WHEN {f} = 'date-time' THEN {sql_str(NOW)} "
            f"ELSE (CASE {f} {fmt} ELSE 'test' END) END) ELSE {sql_str(scalar.PRINTABLE)} END) {types} "
            f"ELSE {sql_str(scalar.PRINTABLE)} END")


def _invalid_sql(t: str = "type") -> str:
    ins = ", ".join(sql_str(x) for x in scalar.INVALID_MAXSIZE_TYPES)
    return f"CASE WHEN {t} IN ({ins}) THEN {sql_str(str(scalar.MAXSIZE))} ELSE {sql_str(scalar.PRINTABLE)} END"


_SPECS = cte("arg_specs") + f", s AS (SELECT *, {_valid_sql()} AS valid, {_invalid_sql()} AS invalid FROM arg_specs)\n"


@query("p12_p13_sample_values", "P12 P13", _SPECS + "SELECT route_id, arg, type, format, valid, invalid FROM s")
def p12(t):
    """Valid and invalid sample values per declared argument type."""
    s = t["arg_specs"]
    return s.select("route_id", "arg", "type", "format",
                    scalar.valid_sample("type", "format", NOW).alias("valid"),
                    scalar.invalid_sample("type").alias("invalid"))


@query("m2_rest_case_matrix", "M2 P12 P13", _SPECS + """
SELECT route_id, method, 'valid' AS case_kind, arg, valid AS value FROM s
UNION ALL SELECT route_id, method, 'invalid', arg, invalid FROM s
UNION ALL SELECT route_id, method, 'all_valid', '*', string_agg(arg || '=' || valid, '&' ORDER BY arg || '=' || valid) FROM s GROUP BY route_id, method
UNION ALL SELECT route_id, method, 'all_invalid', '*', string_agg(arg || '=' || invalid, '&' ORDER BY arg || '=' || invalid) FROM s GROUP BY route_id, method
UNION ALL SELECT DISTINCT route_id, method, CASE WHEN method = 'GET' THEN 'plain' ELSE 'empty' END, '*', CAST(NULL AS VARCHAR) FROM s""")
def m2(t):
    """M2: REST cases per route and method from the argument specs."""
    return matrix.rest_cases(t["arg_specs"], NOW)


@query("p11_http_outcomes", "P11",
       cte("http_attempts") + """SELECT interface, CASE WHEN status = 200 THEN 'ok' WHEN status >= 500 THEN 'server_error'
 WHEN status IS NOT NULL THEN 'other' END AS outcome, count(*) AS n_calls FROM http_attempts GROUP BY ALL""")
def p11(t):
    """Calls per interface and HTTP outcome class."""
    return matrix.outcome_counts(t["http_attempts"])


@query("a23_attempt_metrics", "A23 P9",
       cte("http_attempts") + """SELECT plugin_slug,
 count(*) FILTER (WHERE interface = 'REST') AS num_rest_endpoints_called,
 count(*) FILTER (WHERE interface = 'REST' AND status < 400) AS num_rest_endpoints_http_ok,
 count(*) FILTER (WHERE interface = 'AJAX') AS num_ajax_endpoints_called,
 count(*) FILTER (WHERE interface = 'AJAX' AND status = 200) AS num_ajax_endpoints_http_ok,
 count(*) FILTER (WHERE interface = 'REST') - count(*) FILTER (WHERE interface = 'REST' AND status < 400) AS num_rest_endpoints_http_other
FROM http_attempts GROUP BY plugin_slug""")
def a23(t):
    """Per-plugin call and success counts from the attempt log."""
    return matrix.attempt_metrics(t["http_attempts"])


@query("a23_run_metrics", "A23",
       cte("request_log") + """, c AS (SELECT plugin_slug, interface, route, method, url, data, count(*) AS called,
 count(*) FILTER (WHERE interface = 'REST' AND status < 400 OR interface = 'AJAX' AND status = 200) AS ok,
 min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM request_log GROUP BY ALL)
, newest AS (SELECT plugin_slug, route FROM (SELECT *, row_number() OVER (PARTITION BY plugin_slug ORDER BY ts DESC, attempt_id DESC) AS rn
 FROM request_log WHERE interface = 'REST') WHERE rn = 1)
, tail AS (SELECT c.plugin_slug, count(*) AS n FROM c JOIN newest w ON w.plugin_slug = c.plugin_slug AND w.route = c.route
 WHERE c.interface = 'REST' GROUP BY c.plugin_slug)
SELECT c.plugin_slug, count(*) FILTER (WHERE interface = 'REST') AS num_unique_rest_endpoints, coalesce(max(tail.n), 0) AS last_route_cases,
 CAST(coalesce(sum(called) FILTER (WHERE interface = 'REST'), 0) AS BIGINT) AS num_rest_endpoints_called,
 CAST(coalesce(sum(ok) FILTER (WHERE interface = 'REST'), 0) AS BIGINT) AS num_rest_endpoints_http_ok,
 count(*) FILTER (WHERE interface = 'AJAX') AS num_ajax_endpoints,
 CAST(coalesce(sum(called) FILTER (WHERE interface = 'AJAX'), 0) AS BIGINT) AS num_ajax_endpoints_called,
 CAST(coalesce(sum(ok) FILTER (WHERE interface = 'AJAX'), 0) AS BIGINT) AS num_ajax_endpoints_http_ok,
 (max(last) - min(first)) / 1e6 AS time_spend
FROM c LEFT JOIN tail ON tail.plugin_slug = c.plugin_slug GROUP BY c.plugin_slug""")
def a23_full(t):
    """A23 in full: unique, called and ok endpoints and the time spent per plugin."""
    return matrix.run_metrics(t["request_log"])


_NS_RE = r"/wp-json/([^/]+/[^/]+)"


@query("f8_plugin_rest_namespaces", "F8",
       cte("change_records") + f"""SELECT namespace, count(*) AS n_changes FROM (
 SELECT regexp_extract(url, {sql_str(_NS_RE)}, 1) AS namespace FROM change_records WHERE interface = 'REST')
WHERE namespace <> '' AND namespace NOT IN ({", ".join(sql_str(n) for n in STANDARD_NAMESPACES)}) GROUP BY namespace""")
def f8(t):
    """F8: REST namespaces seen in change URLs, WordPress' own excluded."""
    ns = (t["change_records"].filter(F.col("interface") == "REST")
          .select(F.regexp_extract("url", _NS_RE, 1).alias("namespace")))
    return (ns.filter((F.col("namespace") != "") & non_default_namespace("namespace"))
            .groupBy("namespace").agg(F.count(F.lit(1)).alias("n_changes")))


def _as_text(payload: str):
    """A map as sorted ``key=value`` lines, for comparison."""
    return F.array_join(F.sort_array(F.transform(F.map_entries(payload), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "&")


@query("m1_ajax_payloads", "M1 J8 J5", _J5 + f"""SELECT route_id, plugin_slug, method, 'arg' AS case_kind, arg_name || suffix || '=' || value AS payload
 FROM j5 CROSS JOIN {_TPL} WHERE arg_name IS NOT NULL
UNION ALL SELECT route_id, plugin_slug, m, 'all', payload FROM (
 SELECT route_id, plugin_slug, string_agg(arg_name || '=' || {sql_str(matrix.string.printable)}, '&' ORDER BY arg_name) AS payload
 FROM (SELECT DISTINCT route_id, plugin_slug, arg_name FROM j5 WHERE arg_name IS NOT NULL) GROUP BY route_id, plugin_slug)
 CROSS JOIN (VALUES ('POST'), ('GET')) AS v(m)
UNION ALL SELECT route_id, plugin_slug, 'POST', 'plain', 'action=' || action FROM j5 WHERE arg_name IS NULL""")
def m1_payloads(t):
    """M1: every AJAX case with its whole payload, the combined ones too."""
    r, a = _routes(t)
    cases = matrix.ajax_payloads(r, a)
    return cases.select("route_id", "plugin_slug", "method", "case_kind", _as_text("payload").alias("payload"))


_SITE = "http://localhost:8080/wp-json"
# Fixed values of the stand-in index: four arguments a route; every 7th route
# has none; methods by the route's number.
_INDEX_SQL = cte("arg_specs") + f""", a AS (
 SELECT route_id // 4 AS r, route_id % 4 AS pos, 'a' || CAST(route_id % 4 AS VARCHAR) AS arg, {_valid_sql()} AS valid, {_invalid_sql()} AS invalid,
  route_id % 5 = 0 AS has_enum FROM arg_specs),
routes AS (SELECT DISTINCT r, '/shop/v1/r' || CAST(r AS VARCHAR) AS route, r % 7 = 0 AS bare FROM a),
methods AS (SELECT r, route, bare, unnest(CASE r % 3 WHEN 0 THEN ['GET'] WHEN 1 THEN ['POST', 'PUT'] ELSE ['GET', 'DELETE'] END) AS method FROM routes),
cases AS (
 SELECT r, 'enum' AS case_kind, arg || '=' || v AS entries FROM a CROSS JOIN (VALUES ('x y'), ('z')) AS e(v) WHERE has_enum
 UNION ALL SELECT r, 'valid', arg || '=' || valid FROM a UNION ALL SELECT r, 'invalid', arg || '=' || invalid FROM a
 UNION ALL SELECT r, 'all_valid', string_agg(arg || '=' || valid, '&' ORDER BY pos) FROM a GROUP BY r
 UNION ALL SELECT r, 'all_invalid', string_agg(arg || '=' || invalid, '&' ORDER BY pos) FROM a GROUP BY r
 UNION ALL SELECT r, 'none', '' FROM routes)
SELECT route, method, case_kind, '{_SITE}' || route || CASE WHEN method = 'GET' AND entries <> '' THEN '?' || entries ELSE '' END AS url,
 CASE WHEN method <> 'GET' THEN entries END AS data FROM methods JOIN cases USING (r) WHERE NOT bare
UNION ALL SELECT route, CASE r % 3 WHEN 1 THEN 'POST' ELSE 'GET' END, 'no_arguments', '{_SITE}' || route, NULL FROM routes WHERE bare"""


@query("m2_rest_index_cases", "M2 P12 P13 S4", _INDEX_SQL)
def m2_index(t):
    """M2 from REST index documents: enum, valid, invalid and combined cases in
    the url or the body, and routes without arguments."""
    path = scratch_path(t.spark, "m2-index")
    r = F.floor(F.col("route_id") / 4)
    spec = F.struct("type", "format", F.when(F.col("route_id") % 5 == 0, F.array(F.lit("x y"), F.lit("z"))).alias("enum"))
    # stand-in: one index document per line, its routes with their endpoints
    a = t["arg_specs"].select(r.alias("r"), F.struct(F.concat(F.lit("a"), (F.col("route_id") % 4).cast("string")).alias("k"), spec.alias("v")).alias("e"))
    in_order = F.array_sort(F.collect_list("e"), lambda x, y: F.when(x["k"] < y["k"], -1).otherwise(1))
    routes = a.groupBy("r").agg(F.map_from_entries(in_order).alias("m"))
    methods = F.when(F.col("r") % 3 == 0, F.array(F.lit("GET"))).when(F.col("r") % 3 == 1, F.array(F.lit("POST"), F.lit("PUT"))) \
        .otherwise(F.array(F.lit("GET"), F.lit("DELETE")))
    args = F.when(F.col("r") % 7 == 0, F.lit("[]")).otherwise(F.to_json("m"))
    text = F.concat(F.lit('{"routes": {"/shop/v1/r'), F.col("r").cast("string"), F.lit('": {"endpoints": [{"methods": '), F.to_json(methods),
                    F.lit(', "args": '), args, F.lit("}]}}}"))
    routes.select(text.alias("value")).write.text(path)
    calls = matrix.rest_index_cases(t.spark.read.schema(matrix.REST_INDEX).json(path), _SITE, NOW)
    data = F.array_join(F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return calls.select("route", "method", "case_kind", "url", data.alias("data"))

"""Test-case matrices for the dynamic runner and their coverage.

M1 (AJAX): J5 keeps routes without arguments; every argument gets the 12
payload templates (6 values x {``name``, ``name[]``}) by exploding a
literal array - a generator, not a join - plus two all-arguments cases
(POST, GET) per route with arguments and one plain POST for a route
without arguments.  Each case is sent twice (user and admin session).

M2 (REST): per route and method, enum / valid / invalid cases per
argument, then all-valid, all-invalid and a plain call (GET) or an empty
body (others); a route without arguments gets one call with its first
method.  Sample values come from P12/P13.

The all-arguments cases need the argument list of one endpoint; that list
is bounded by the endpoint's declaration (a handful of names), so it is
gathered with ``collect_list`` per (route, method) - never per plugin.
"""

from __future__ import annotations

import string
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaklens.functions.scalar import http_outcome, invalid_sample, valid_sample

# ---------------------------------------------------------------------------
# The runner's AJAX payload values, in its order, rendered as
# text; each is sent under the argument name and under ``name[]``.
# ---------------------------------------------------------------------------
AJAX_VALUES = [str(sys.maxsize), str(-sys.maxsize), string.printable, str(True), str(False), str(0.0123456789)]
AJAX_KEY_SUFFIXES = ["", "[]"]
ALL_ARGS_METHODS = ["POST", "GET"]
CALLS_PER_AJAX_CASE = 2


def routes_with_arguments(routes: DataFrame, args: DataFrame) -> DataFrame:
    """Every route with each of its arguments; routes without any keep
    one row with NULL method/argument."""
    return routes.join(args.select("route_id", "method", "arg_name"), "route_id", "left")


def ajax_cases(routes: DataFrame, args: DataFrame) -> DataFrame:
    """M1 + J8: the AJAX case matrix (route_id, plugin_slug, method,
    payload_key, payload_value, case_kind)."""
    j5 = routes_with_arguments(routes, args)
    templates = F.array(*[F.struct(F.lit(sfx).alias("suffix"), F.lit(v).alias("value"))
                          for sfx in AJAX_KEY_SUFFIXES for v in AJAX_VALUES])
    per_arg = (j5.filter(F.col("arg_name").isNotNull())
               .select("route_id", "plugin_slug", "method", "arg_name", F.explode(templates).alias("t"))
               .select("route_id", "plugin_slug", "method",
                       F.concat("arg_name", "t.suffix").alias("payload_key"),
                       F.col("t.value").alias("payload_value"), F.lit("arg").alias("case_kind")))
    with_args = args.select("route_id").distinct().join(routes.select("route_id", "plugin_slug"), "route_id")
    all_args = with_args.select(
        "route_id", "plugin_slug", F.explode(F.array(*[F.lit(m) for m in ALL_ARGS_METHODS])).alias("method"),
        F.lit("*").alias("payload_key"), F.lit(string.printable).alias("payload_value"),
        F.lit("all").alias("case_kind"))
    plain = j5.filter(F.col("arg_name").isNull()).select(
        "route_id", "plugin_slug", F.lit("POST").alias("method"), F.lit("action").alias("payload_key"),
        F.col("action").alias("payload_value"), F.lit("plain").alias("case_kind"))
    return per_arg.unionByName(all_args).unionByName(plain)


def ajax_payloads(routes: DataFrame, args: DataFrame) -> DataFrame:
    """M1 with whole payloads: (route_id, plugin_slug, method, case_kind,
    payload map) of every AJAX case.

    A route's arguments are gathered once (bounded by its declaration); all
    its cases, the two with every argument too, are exploded from them."""
    each = args.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("arg_name", "method"))).alias("args"))
    templates = F.array(*[F.struct(F.lit(sfx).alias("suffix"), F.lit(v).alias("value"))
                          for sfx in AJAX_KEY_SUFFIXES for v in AJAX_VALUES])

    def case(method, kind: str, payload):
        return F.named_struct(F.lit("method"), method, F.lit("case_kind"), F.lit(kind), F.lit("payload"), payload)

    single = F.flatten(F.transform("args", lambda a: F.transform(templates, lambda t: case(
        a["method"], "arg", F.create_map(F.concat(a["arg_name"], t["suffix"]), t["value"])))))
    names = F.array_distinct(F.transform("args", lambda a: a["arg_name"]))
    everything = F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.lit(string.printable))))
    combined = F.array(*[case(F.lit(m), "all", everything) for m in ALL_ARGS_METHODS])
    plain = F.array(case(F.lit("POST"), "plain", F.create_map(F.lit("action"), F.col("action"))))
    cases = F.when(F.col("args").isNull(), plain).otherwise(F.concat(single, combined))
    return (routes.join(each, "route_id", "left").select("route_id", "plugin_slug", F.explode(cases).alias("c"))
            .select("route_id", "plugin_slug", "c.*"))


# What the REST index says of a route and of an argument.
REST_ARGUMENT = "map<string, struct<type: string, format: string, enum: array<string>>>"
REST_INDEX = "routes map<string, struct<endpoints: array<struct<methods: array<string>, args: string>>>>"


def rest_index_cases(index: DataFrame, site: str, now_iso: str) -> DataFrame:
    """M2 from the REST index: (route, method, case_kind, url, data) of every call.

    ``index`` has ``routes`` (REST_INDEX).  The arguments of an endpoint are an
    object, or an empty list where it has none: then its first method is called
    once.  GET calls carry arguments in the url, the others in ``data``, a map.
    Per argument each enum value, a valid and an invalid sample; per method all
    valid, all invalid and none."""
    endpoints = (index.select(F.explode("routes").alias("route", "details"))
                 .select("route", F.posexplode("details.endpoints").alias("place", "e"))
                 .select("route", "place", F.col("e.methods").alias("methods"),
                         F.from_json("e.args", REST_ARGUMENT).alias("args"),
                         F.ltrim(F.coalesce("e.args", F.lit("[]"))).startswith("[").alias("bare")))
    url = F.concat(F.lit(site), F.col("route"))
    no_data = F.lit(None).cast("map<string,string>")
    bare = endpoints.filter("bare").select(
        "route", F.element_at("methods", 1).alias("method"), F.lit("no_arguments").alias("case_kind"), url.alias("url"), no_data.alias("data"))
    # samples of every argument, then every case of the endpoint from them
    each = (endpoints.filter(~F.col("bare")).select("route", "place", "methods", F.posexplode_outer(F.map_entries("args")).alias("at", "a"))
            .select("route", "place", "methods", "at", F.col("a.key").alias("arg"), F.coalesce("a.value.type", F.lit("string")).alias("type"),
                    F.col("a.value.format").alias("format"), F.col("a.value.enum").alias("enum")))
    each = each.withColumn("valid", valid_sample("type", "format", now_iso)).withColumn("invalid", invalid_sample("type"))
    gathered = each.groupBy("route", "place").agg(
        F.first("methods").alias("methods"),
        F.sort_array(F.collect_list(F.when(F.col("arg").isNotNull(), F.struct("at", "arg", "valid", "invalid", "enum")))).alias("args"))

    def entry(name, value):
        return F.named_struct(F.lit("k"), name, F.lit("v"), value)

    def case(kind: str, entries):
        return F.named_struct(F.lit("case_kind"), F.lit(kind), F.lit("entries"), entries)

    def one(kind: str, name, value):
        return case(kind, F.array(entry(name, value)))

    enums = F.flatten(F.transform("args", lambda a: F.transform(
        F.coalesce(a["enum"], F.array().cast("array<string>")), lambda v: one("enum", a["arg"], v))))
    samples = F.flatten(F.transform("args", lambda a: F.array(one("valid", a["arg"], a["valid"]), one("invalid", a["arg"], a["invalid"]))))

    def whole(kind: str):
        return case(f"all_{kind}", F.transform("args", lambda a: entry(a["arg"], a[kind])))

    nothing = case("none", F.array().cast("array<struct<k:string,v:string>>"))
    cases = F.concat(enums, samples, F.array(whole("valid"), whole("invalid"), nothing))
    calls = (gathered.select("route", F.explode("methods").alias("method"), cases.alias("cases"))
             .select("route", "method", F.explode("cases").alias("c")).select("route", "method", "c.*"))
    is_get, none = F.col("method") == "GET", F.size("entries") == 0
    # without arguments a body has no case with all of them
    calls = calls.filter(is_get | ~none | (F.col("case_kind") == "none"))
    pairs = F.array_join(F.transform("entries", lambda e: F.concat(e["k"], F.lit("="), e["v"])), "&")
    query = F.when(is_get & ~none, F.concat(F.lit("?"), pairs)).when(is_get & (F.col("case_kind") != "none"), F.lit("?")).otherwise(F.lit(""))
    data = F.when(~is_get, F.map_from_entries("entries"))
    return calls.select("route", "method", "case_kind", F.concat(url, query).alias("url"), data.alias("data")).unionByName(bare)


def rest_cases(specs: DataFrame, now_iso: str, routes: DataFrame | None = None) -> DataFrame:
    """M2: REST cases from flat argument specs (route_id, method, arg, type,
    format[, enum array]) -> (route_id, method, case_kind, arg, value).

    ``routes`` (route_id, methods array), when given, adds one plain call
    with the first declared method for every route without arguments."""
    s = specs.withColumn("valid", valid_sample("type", "format", now_iso)) \
        .withColumn("invalid", invalid_sample("type"))
    has_enum = "enum" in specs.columns
    per_arg_cases = [F.struct(F.lit("valid").alias("k"), F.col("valid").alias("v")),
                     F.struct(F.lit("invalid").alias("k"), F.col("invalid").alias("v"))]
    arr = F.array(*per_arg_cases)
    if has_enum:
        enum_cases = F.transform(F.coalesce("enum", F.array().cast("array<string>")),
                                 lambda e: F.struct(F.lit("enum").alias("k"), e.alias("v")))
        arr = F.concat(enum_cases, arr)
    per_arg = s.select("route_id", "method", "arg", F.explode(arr).alias("c")).select(
        "route_id", "method", F.col("c.k").alias("case_kind"), "arg", F.col("c.v").alias("value"))
    grouped = s.groupBy("route_id", "method").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat("arg", F.lit("="), "valid"))), "&").alias("all_valid"),
        F.array_join(F.sort_array(F.collect_list(F.concat("arg", F.lit("="), "invalid"))), "&").alias("all_invalid"))
    combined = grouped.select(
        "route_id", "method", F.explode(F.array(
            F.struct(F.lit("all_valid").alias("k"), F.col("all_valid").alias("v")),
            F.struct(F.lit("all_invalid").alias("k"), F.col("all_invalid").alias("v")),
            F.struct(F.when(F.col("method") == "GET", F.lit("plain")).otherwise(F.lit("empty")).alias("k"),
                     F.lit(None).cast("string").alias("v")))).alias("c")).select(
        "route_id", "method", F.col("c.k").alias("case_kind"), F.lit("*").alias("arg"), F.col("c.v").alias("value"))
    out = per_arg.unionByName(combined)
    if routes is not None:
        no_args = routes.join(specs.select("route_id").distinct(), "route_id", "left_anti")
        out = out.unionByName(no_args.select(
            "route_id", F.element_at("methods", 1).alias("method"), F.lit("plain").alias("case_kind"),
            F.lit(None).cast("string").alias("arg"), F.lit(None).cast("string").alias("value")))
    return out


def coverage(cases: DataFrame, attempts: DataFrame, interface: str = "AJAX") -> DataFrame:
    """M3: per plugin, expected calls from the case matrix vs attempted calls."""
    expected = cases.groupBy("plugin_slug").agg(
        (F.count(F.lit(1)) * CALLS_PER_AJAX_CASE).alias("expected_calls"))
    tried = (attempts.filter(F.col("interface") == interface)
             .groupBy("plugin_slug").agg(F.count(F.lit(1)).alias("attempted_calls")))
    return expected.join(tried, "plugin_slug", "left").select(
        "plugin_slug", "expected_calls", F.coalesce("attempted_calls", F.lit(0)).alias("attempted_calls"))


def attempt_metrics(attempts: DataFrame) -> DataFrame:
    """Per plugin, REST calls / ok (status < 400, as ``response.ok``) /
    other, AJAX calls / ok (status == 200), in one aggregation pass."""
    rest = F.col("interface") == "REST"
    ajax = F.col("interface") == "AJAX"
    s = F.col("status")
    return attempts.groupBy("plugin_slug").agg(
        F.count_if(rest).alias("num_rest_endpoints_called"),
        F.count_if(rest & (s < 400)).alias("num_rest_endpoints_http_ok"),
        F.count_if(ajax).alias("num_ajax_endpoints_called"),
        F.count_if(ajax & (s == 200)).alias("num_ajax_endpoints_http_ok"),
    ).withColumn("num_rest_endpoints_http_other",
                 F.col("num_rest_endpoints_called") - F.col("num_rest_endpoints_http_ok"))


def run_metrics(log: DataFrame) -> DataFrame:
    """A23 in full, from a log of all calls (attempt_id, plugin_slug, ts,
    interface, method, route, url, data, status): one row per plugin.

    ``num_unique_rest_endpoints`` and ``num_ajax_endpoints`` count distinct
    (method, url, data).  The runner's own count holds only the cases of the
    route it tested last: ``last_route_cases``.  A POST with a body is one
    case though the runner sends it twice.  ``time_spend`` is the time in
    seconds from the first call to the last.  NULL status: the call failed.

    Calls are combined by case, then by route, then by plugin, each before its
    shuffle, so a plugin with most of the calls is not one task.
    """
    case = ["plugin_slug", "interface", "route", "method", "url", "data"]
    rest = F.col("interface") == "REST"
    ajax = F.col("interface") == "AJAX"
    ok = (rest & (F.col("status") < 400)) | (ajax & (F.col("status") == 200))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cases = log.groupBy(*case).agg(
        F.count(F.lit(1)).alias("called"), F.count_if(ok).alias("ok"), F.min(micros).alias("first"), F.max(micros).alias("last"),
        F.max(F.struct(micros.alias("at"), F.col("attempt_id"))).alias("newest"))
    by_route = cases.groupBy("plugin_slug", "interface", "route").agg(
        F.count(F.lit(1)).alias("cases"), F.sum("called").alias("called"), F.sum("ok").alias("ok"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("newest").alias("newest"))

    def total(which: Column, col: str) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col(col))), F.lit(0))

    return by_route.groupBy("plugin_slug").agg(
        total(rest, "cases").alias("num_unique_rest_endpoints"),
        F.coalesce(F.max_by(F.when(rest, F.col("cases")), F.when(rest, F.col("newest"))), F.lit(0)).alias("last_route_cases"),
        total(rest, "called").alias("num_rest_endpoints_called"),
        total(rest, "ok").alias("num_rest_endpoints_http_ok"),
        total(ajax, "cases").alias("num_ajax_endpoints"),
        total(ajax, "called").alias("num_ajax_endpoints_called"),
        total(ajax, "ok").alias("num_ajax_endpoints_http_ok"),
        ((F.max("last") - F.min("first")) / 1e6).alias("time_spend"))


def outcome_counts(attempts: DataFrame) -> DataFrame:
    """P11 applied: calls per interface and outcome class."""
    return attempts.groupBy("interface", http_outcome("status").alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_calls"))
